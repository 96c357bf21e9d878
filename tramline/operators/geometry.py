"""Nearest places and segments, and places along lines, over a pyramid of grid cells.

Coordinates are metres on a plane (`flat` makes them). Cells of a first size are counted and their counts added up into cells of twice the size, again and
again. A point's level is the least one at which its own cell holds enough others: so many then lie within the cell's diagonal, and whatever is nearer lies in the cells
around the point at a level whose cells are at least that wide. Which cells meet is found from cells alone, and cells farther apart than that diagonal
are left out; then points meet others once, by an equi join on pairs of cells. Dense areas use small cells and sparse ones large cells, without any
choice by hand and without a loop.

Segments are cut into pieces no wider than a first cell and stand in the cell of their middle. Rows with a null coordinate or key are near nothing."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.operators.lineage import written

#: Metres of a degree of latitude.
DEGREE = 111_320.0
#: Width of the first cells; levels, the last of which holds the earth in nine cells.
FIRST, LEVELS = 50.0, 21
# A stop may lie as much farther than its nearest place on the line, and fall back as much behind the stop before.
SLACK, BACK = 25.0, 5.0
#: Segments or boxes under one box of a line; places that are looked for at once, and pairs of them and segments, about.
FAN, PLACES, PAIRS = 64, 128, 1_000_000


def flat(lat: Column, lon: Column, lat0: float) -> tuple[Column, Column]:
    """x and y in metres of a place, on a plane that touches the earth at latitude lat0."""
    return lon * (DEGREE * math.cos(math.radians(lat0))), lat * DEGREE


def _met(points: DataFrame, others: DataFrame, by: Sequence[str], enough: int, extra: float, wide: float, first: float, stretch: float = 1.0) -> DataFrame:
    """points (x, y) paired with others (o_x, o_y; keys named as in `by`): at least all whose distance is within `extra` of the `enough`-th nearest one's.

    wide: how far an other may reach beyond its place; stretch: how much the true distance may differ from the plane's, as a factor."""
    fine = lambda x, y: {"_fx": F.floor(F.col(x) / first).cast("long"), "_fy": F.floor(F.col(y) / first).cast("long")}
    p = points.where("x IS NOT NULL AND y IS NOT NULL").withColumns(fine("x", "y"))
    o = others.where("o_x IS NOT NULL AND o_y IS NOT NULL").withColumns(fine("o_x", "o_y"))
    cell, top = [*by, "_fx", "_fy"], LEVELS + max(0, math.ceil(math.log2(FIRST / first)))
    levels = F.explode(F.sequence(F.lit(0), F.lit(top - 1))).alias("_l")
    up = lambda level: [F.call_function("shiftright", F.col(c), level).alias(n) for c, n in (("_fx", "_cx"), ("_fy", "_cy"))]
    held = o.groupBy(*cell).agg(F.count("*").alias("_n"))
    raised = held.select(*cell, "_n", levels).select("*", *up(F.col("_l")))
    counts = raised.groupBy(*by, "_l", "_cx", "_cy").agg(F.sum("_n").alias("_n"))
    asked = p.select(*cell).distinct().select(*cell, levels).select("*", *up(F.col("_l")))
    own = asked.join(counts.hint("merge"), [*by, "_l", "_cx", "_cy"], "left").groupBy(*cell).agg(F.coalesce(F.min(F.when(F.col("_n") >= enough, F.col("_l"))), F.lit(top)).alias("_l"))
    # All that counts has its place within `bound`; at level _s a cell is at least that wide.
    bound = math.sqrt(2) * stretch * stretch * first * F.pow(2.0, F.col("_l")) + extra + wide
    own = own.withColumn("_bound", bound).withColumn("_s", F.least(F.lit(top - 1), F.greatest(F.lit(0), F.ceil(F.log2(F.col("_bound") / first)).cast("int"))))
    beside = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    search = own.select(*by, F.col("_fx").alias("_px"), F.col("_fy").alias("_py"), "_bound", F.col("_s").alias("_l"), *up(F.col("_s")))
    search = search.withColumn("_dx", beside).withColumn("_dy", beside).withColumns({"_cx": F.col("_cx") + F.col("_dx"), "_cy": F.col("_cy") + F.col("_dy")})
    gap = lambda a, b: F.greatest(F.lit(0), F.abs(F.col(a) - F.col(b)) - 1) * first
    # Only levels that are looked at.
    raised = raised.join(F.broadcast(own.select(F.col("_s").alias("_l")).distinct()), "_l")
    pairs = search.join(raised.hint("merge"), [*by, "_l", "_cx", "_cy"]).where(F.pow(gap("_px", "_fx"), 2) + F.pow(gap("_py", "_fy"), 2) <= F.pow("_bound", 2))
    pairs = pairs.select(*by, "_px", "_py", "_fx", "_fy")
    left = p.withColumnsRenamed({"_fx": "_px", "_fy": "_py"})
    return left.join(pairs.hint("merge"), [*by, "_px", "_py"]).join(o.hint("merge"), [*by, "_fx", "_fy"]).drop("_px", "_py", "_fx", "_fy")


def nearest(points: DataFrame, others: DataFrame, k: int = 3, by: Sequence[str] = (), self_: bool = False, first: float = FIRST, measure: Column | None = None, stretch: float = 1.05) -> DataFrame:
    """id, other, r (1 to k) and m: the k nearest others (id, x, y) of each point (id, x, y) of the same key; of equally near ones the least id first.

    With self_ a point is not its own neighbour. Where a key has fewer others, all are given. measure, where given, is the distance by the columns of the point
    and, with o_ before their names, of the other; it may differ from that on the plane by the factor `stretch`."""
    o = others.select(*by, F.col("id").alias("other"), *[F.col(c).alias(f"o_{c}") for c in others.columns if c not in (*by, "id")])
    pairs = _met(points, o, by, k + self_, 0.0, 0.0, first, 1.0 if measure is None else stretch)
    pairs = pairs.where("id <> other") if self_ else pairs
    m = F.sqrt(F.pow(F.col("x") - F.col("o_x"), 2) + F.pow(F.col("y") - F.col("o_y"), 2)) if measure is None else measure
    place = F.row_number().over(Window.partitionBy(*by, "id").orderBy("m", "other"))
    return pairs.withColumn("m", m).withColumn("r", place).where(F.col("r") <= k).select(*by, "id", "other", "r", "m")


def segments(vertices: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, seg, ax, ay, bx, by_, start and length of the segments between the vertices (seq, x, y) of lines; start is the way along the line before it."""
    order = Window.partitionBy(*by).orderBy("seq")
    ends = vertices.select(*by, F.col("seq").alias("seg"), F.lag("x").over(order).alias("ax"), F.lag("y").over(order).alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by_"))
    ends = ends.withColumn("length", F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by_") - F.col("ay"), 2)))
    upto = F.sum("length").over(Window.partitionBy(*by).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1))
    return ends.where("length IS NOT NULL").withColumn("start", F.coalesce(upto, F.lit(0.0)))


def _fit(points: DataFrame, segs: DataFrame, by: Sequence[str], slack: float) -> float:
    """The width of first cells, FIRST or a part of it, by which segments in pieces and pairs of points and pieces are fewest: lines that lie close want small cells.

    It is guessed from the segments' number, length and extent, and changes cost alone."""
    sizes = [FIRST / 2**i for i in range(8)]
    wide = lambda a, b: F.greatest(F.max(a), F.max(b)) - F.least(F.min(a), F.min(b))
    lines = segs.groupBy(*by).agg(F.count("*").alias("_n"), F.sum("length").alias("_long"), wide("ax", "bx").alias("_w"), wide("ay", "by_").alias("_h"))
    held = lines.join(points.groupBy(*by).agg(F.count("*").alias("_p")), [*by])

    def cost(first: float) -> Column:
        pieces = F.col("_n") + F.col("_long") / first
        area = F.greatest("_w", F.lit(first)) * F.greatest("_h", F.lit(first))
        return F.sum(3 * pieces + F.col("_p") * pieces * (4 * first + 2 * slack) ** 2 / area)

    found = held.agg(*[cost(first).alias(str(i)) for i, first in enumerate(sizes)]).first()
    return min(zip(found, sizes, strict=True), key=lambda x: (x[0], -x[1]))[1] if found[0] is not None else FIRST


def _distances(points: DataFrame, segs: DataFrame, by: Sequence[str], slack: float, first: float) -> DataFrame:
    """points with seg, d and along of at least all segments of the same key that are at most `slack` farther than the nearest one; a segment of several pieces may come several times."""
    parts = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by_") - F.col("ay"))) / first)).cast("int")
    pieces = segs.withColumn("_parts", parts).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    middle = (F.col("_i") + 0.5) / F.col("_parts")
    pieces = pieces.withColumns({"o_x": F.col("ax") + (F.col("bx") - F.col("ax")) * middle, "o_y": F.col("ay") + (F.col("by_") - F.col("ay")) * middle}).drop("_i", "_parts")
    met = _met(points, pieces, by, 1, slack, first * math.sqrt(0.5), first)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")
    at = F.when(F.col("length") > 0, ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / (F.col("length") * F.col("length"))).otherwise(0.0)
    met = met.withColumn("_t", F.least(F.lit(1.0), F.greatest(F.lit(0.0), at)))
    d = F.sqrt(F.pow(F.col("ax") + F.col("_t") * dx - F.col("x"), 2) + F.pow(F.col("ay") + F.col("_t") * dy - F.col("y"), 2))
    met = met.withColumns({"d": d, "along": F.col("start") + F.col("_t") * F.col("length")})
    return met.select(*points.columns, "seg", "d", "along")


def _nearest_segment(points: DataFrame, segs: DataFrame, by: Sequence[str], first: float) -> DataFrame:
    """points with seg, d and along of the nearest segment. Each task keeps the best of its pairs, so pairs are not dealt again."""
    met = _distances(points, segs, by, 0.0, first)
    rest = [c for c in points.columns if c not in (*by, "id")]
    best = met.groupBy(*by, "id").agg(F.min(F.struct("d", "along", "seg")).alias("_best"), *[F.first(c).alias(c) for c in rest])
    return best.select(*points.columns, *[F.col("_best")[c].alias(c) for c in ("seg", "d", "along")])


def beside(points: DataFrame, segs: DataFrame, by: Sequence[str], slack: float = 0.0, first: float | None = None) -> DataFrame:
    """points (id, x, y and others) with seg, d and along for every segment of the same key that is at most `slack` farther than the nearest one; and near, the way along to that.

    first is the width of first cells, fitted where not given. The nearest is found first, in small cells, so that pairs farther than it and the slack go where they are met."""
    points, segs = written(points), written(segs)
    near = written(_nearest_segment(points, segs, by, first or _fit(points, segs, by, 0.0)).drop("seg").withColumnsRenamed({"d": "_best", "along": "near"}))
    met = _distances(near, segs, by, slack, first or _fit(near, segs, by, slack)).where(F.col("d") <= F.col("_best") + slack)
    return met.dropDuplicates([*by, "id", "seg"]).select(*points.columns, "seg", "d", "along", "near")


def on_line(points: DataFrame, segs: DataFrame, by: Sequence[str], first: float | None = None) -> DataFrame:
    """points with seg, d and along of the nearest segment of the same key; of equally near ones the earliest along the line."""
    points, segs = written(points), written(segs)
    return _nearest_segment(points, segs, by, first or _fit(points, segs, by, 0.0))


def _measured(segs: np.ndarray, x: np.ndarray | float, y: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """How far x and y are from each segment (start, ax, ay, bx, by_ and length), and the way along to its nearest point."""
    start, ax, ay, bx, by, length = segs.T
    dx, dy = bx - ax, by - ay
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(length > 0, ((x - ax) * dx + (y - ay) * dy) / (length * length), 0.0)
    part = np.minimum(1.0, np.maximum(0.0, part))
    return np.sqrt((ax + part * dx - x) ** 2 + (ay + part * dy - y) ** 2), start + part * length


class _Line:
    """The segments (start, ax, ay, bx, by_ and length) of one line in order, under boxes around FAN of them, boxes around FAN boxes, and so on."""

    def __init__(self, segs: np.ndarray) -> None:
        self.segs, self.levels = segs, []
        low, high = np.minimum(segs[:, 1:3], segs[:, 3:5]), np.maximum(segs[:, 1:3], segs[:, 3:5])
        while len(low) > FAN or not self.levels:
            at = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append(np.hstack((low, high)))

    @staticmethod
    def _near(boxes: np.ndarray, x: np.ndarray | float, y: np.ndarray | float, limit: np.ndarray | float) -> np.ndarray:
        """Whether boxes are within the limit of x and y; of a little more than it, as the gap and the distance are rounded apart."""
        x0, y0, x1, y1 = boxes.T
        gap_x, gap_y = np.maximum(np.maximum(x0 - x, x - x1), 0.0), np.maximum(np.maximum(y0 - y, y - y1), 0.0)
        return gap_x * gap_x + gap_y * gap_y <= (limit * (1 + 1e-9) + 1e-6) ** 2

    def nearest(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far each place is from its nearest segment, and the way along to it; of equally near ones the earliest.

        The first segment of each box bounds the distance; only boxes that are nearer are opened. Places are halved where they open too many."""
        some, best = np.arange(len(x)), np.full(len(x), np.inf)
        top = len(self.levels[-1])
        place, box = np.repeat(some, top), np.tile(np.arange(top), len(x))
        for level in range(len(self.levels) - 1, -1, -1):
            found = _measured(self.segs[box * FAN ** (level + 1)], x[place], y[place])[0]
            best = np.minimum(best, np.minimum.reduceat(found, np.searchsorted(place, some)))
            open_ = self._near(self.levels[level][box], x[place], y[place], best[place])
            place, box = place[open_], box[open_]
            if len(box) * FAN > PAIRS and len(x) > 1:
                half = len(x) // 2
                return tuple(np.concatenate(both) for both in zip(self.nearest(x[:half], y[:half]), self.nearest(x[half:], y[half:]), strict=True))
            many = np.minimum(FAN, len(self.levels[level - 1] if level else self.segs) - box * FAN)
            within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            place, box = np.repeat(place, many), np.repeat(box * FAN, many) + within
        found, ways = _measured(self.segs[box], x[place], y[place])
        first = np.searchsorted(place, some)
        best = np.minimum.reduceat(found, first)
        return best, np.minimum.reduceat(np.where(found == best[place], ways, np.inf), first)

    def first_way(self, far: float, limit: float, x: float, y: float) -> float | None:
        """The least way along that is `far` at least and within `limit` of x and y. Only boxes as near are opened, in order, so what is passed over is not measured."""
        return self._within(len(self.levels) - 1, 0, max(0, int(np.searchsorted(self.segs[:, 0], far)) - 1), far, limit, x, y)

    def _within(self, level: int, begin: int, first: int, far: float, limit: float, x: float, y: float) -> float | None:
        """That of the boxes `begin` and after of a level (of the segments, at -1) that are in one box; what lies before segment `first` is left out."""
        end = begin + FAN
        if level < 0:
            found, ways = _measured(self.segs[max(begin, first) : end], x, y)
            fits = (ways >= far) & (found <= limit)
            return float(ways[fits].min()) if fits.any() else None
        begin = max(begin, first // FAN ** (level + 1))
        for i in np.flatnonzero(self._near(self.levels[level][begin:end], x, y, limit)).tolist():
            way = self._within(level - 1, (begin + i) * FAN, first, far, limit, x, y)
            if way is not None:
                return way
        return None


def along(stops: DataFrame, segs: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, id, seq and along of the stops (id, seq, x, y) of lines, projected so that they follow each other along the line.

    Of the places within SLACK of a stop's nearest one, the earliest counts that is not more than BACK behind the places before; where there is
    none, the nearest place of all. So a stop that a line passes twice gets the pass that fits its turn. A stop's places are neither listed nor all measured:
    stops stream in turn past their line, which is searched for the nearest place, and for the one that counts ahead of the way so far, through boxes around its
    segments. A line is one task, which holds its segments (48 bytes each) and boxes."""
    names = ["a", "b", "c", "d", "e", "f"]
    as_ = lambda columns: [F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=False)]
    kind_of, present = dict(stops.dtypes), [F.col(c).isNotNull() for c in by]
    lines = segs.select(*by, F.lit(0).alias("kind"), F.col("seg").cast(kind_of["seq"]).alias("seq"), F.lit(None).cast(kind_of["id"]).alias("id"), *as_(("start", "ax", "ay", "bx", "by_", "length")))
    placed = stops.where("x IS NOT NULL AND y IS NOT NULL").select(*by, F.lit(1).alias("kind"), "seq", "id", *as_(("x", "y")))
    both = lines.unionByName(placed, allowMissingColumns=True).fillna(0.0, names)
    for test in present:
        both = both.where(test)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, far, parts, line = None, -math.inf, [], None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in by], strict=True))
            kinds, values = batch.column("kind").to_pylist(), np.column_stack([batch.column(n).to_numpy() for n in names])
            cuts = [0, *(i for i in range(1, len(keys)) if (keys[i], kinds[i]) != (keys[i - 1], kinds[i - 1])), len(keys)]
            ways, stood = [], np.zeros(len(keys), bool)
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if begin == end:
                    continue
                if keys[begin] != key:
                    key, far, parts, line = keys[begin], -math.inf, [], None
                if not kinds[begin]:
                    parts.append(values[begin:end])
                    continue
                if line is None and not parts:
                    continue  # a line without segments
                if line is None:
                    line, parts = _Line(np.concatenate(parts)), []
                stood[begin:end] = True
                for at in range(begin, end, PLACES):
                    x, y = values[at : min(end, at + PLACES), :2].T
                    for spot in zip(x.tolist(), y.tolist(), *[v.tolist() for v in line.nearest(x, y)], strict=True):
                        way = line.first_way(far - BACK, spot[2] + SLACK, spot[0], spot[1])
                        way = spot[3] if way is None else way
                        far = max(far, way)
                        ways.append(way)
            kept = batch.filter(pa.array(stood))
            yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in (*by, "id", "seq")], pa.array(ways, pa.float64())], names=[*by, "id", "seq", "along"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stops.select(*by, "id", "seq").schema.fields)
    # By a number of tasks, as a line takes long for its bytes.
    dealt = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    return dealt.sortWithinPartitions(*by, "kind", "seq", "id").mapInArrow(run, f"{kind}, along double")
