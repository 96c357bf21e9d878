"""Vehicle tracks: cleaned segments, stale links, shared trips, bunching, standing, frozen and jumping positions, fleet changes.

All but the ordered fold are windows, running values and equi joins. Whether another vehicle is near in time is read off the nearest point of
another one on each side, and how many run on a route off a running sum: rows of a key are never paired."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.operators.cuts import running
from tramline.operators.lineage import written

# Limits of a usable segment (seconds, metres, metres a second).
MAX_SEGMENT_S, MIN_RUN_S, MAX_SPEED, CITY_M, MAX_SPEED_CITY = 1800, 3, 30.0, 2000, 20.0
# A shared trip, a bunch, a frozen run, a jump, a lasting change (seconds, metres, metres a second).
SHARED_TRIP_S, BUNCH_S = 2700, 120
FROZEN_N, FROZEN_S, FROZEN_GAP_S, FROZEN_MPS = 5, 300, 600, 3.0
JUMP_MPS, JUMP_M, JUMP_MERGE_S = 35.0, 500.0, 300
LASTING_S = 1800


def within(*by: str, t: str = "t", before: int, after: int) -> Window:
    """The frame of a key's rows from `before` seconds earlier to `after` seconds later."""
    return Window.partitionBy(*by).orderBy(F.col(t).cast("long")).rangeBetween(-before, after)


def previous_dwell(rows: DataFrame) -> DataFrame:
    """rows (id, trip, stop, t, prev_stop, prev_t, dwell) with prev_dwell: the dwell of the row at the previous stop of the trip.

    Of rows with one (trip, stop, t) that with the largest id counts; rows without a dwell do not."""
    dwells = rows.where("dwell IS NOT NULL").groupBy("trip", F.col("stop").alias("prev_stop"), F.col("t").alias("prev_t")).agg(F.max_by("dwell", "id").alias("prev_dwell"))
    return rows.join(dwells, ["trip", "prev_stop", "prev_t"], "left")


def segments(rows: DataFrame, city: bool = True) -> DataFrame:
    """Usable segments of rows (t, prev_t, prev_stop, dist, speed, prev_dwell, ...) with seg, dwell_before, run and pace.

    A segment lasts over 0 and at most MAX_SEGMENT_S seconds and has a length. What the vehicle stood at the stop before is
    prev_dwell if it is less than the segment, else what the logged speed leaves, else unknown (null, and counted as 0).
    Runs under MIN_RUN_S or faster than MAX_SPEED go, and under CITY_M those faster than MAX_SPEED_CITY."""
    seg = F.col("t") - F.col("prev_t")
    known = F.col("prev_dwell").between(0, seg - 1e-9)
    by_speed = F.when(F.col("speed") > 0, F.greatest(F.lit(0.0), seg - F.col("dist") / F.col("speed")))
    out = rows.where((seg > 0) & (seg <= MAX_SEGMENT_S) & F.col("prev_stop").isNotNull() & (F.col("dist") > 0))
    out = out.withColumns({"seg": seg, "dwell_before": F.when(known, F.col("prev_dwell").cast("double")).otherwise(by_speed)})
    out = out.withColumn("run", F.col("seg") - F.coalesce("dwell_before", F.lit(0.0))).where(F.col("run") >= MIN_RUN_S)
    out = out.withColumn("pace", F.col("dist") / F.col("run")).where(F.col("pace") <= MAX_SPEED)
    return out.where(~((F.col("dist") < CITY_M) & (F.col("pace") > MAX_SPEED_CITY))) if city else out


def stale_links(rows: DataFrame) -> DataFrame:
    """rows (id, veh, t, prev_t) with `between`: how many rows of the vehicle lie strictly between prev_t and t (null without prev_t)."""
    both = F.array(
        F.struct(F.col("t").alias("at"), F.lit(1).alias("n"), F.lit(0).alias("kind")),
        F.struct(F.col("t").alias("at"), F.lit(0).alias("n"), F.lit(1).alias("kind")),
        F.struct(F.col("prev_t").alias("at"), F.lit(0).alias("n"), F.lit(2).alias("kind")),
    )
    points = rows.select("id", "veh", F.explode(both).alias("p")).select("id", "veh", "p.*").where("at IS NOT NULL")
    order = Window.partitionBy("veh").orderBy("at")
    upto = F.sum("n").over(order)
    here = F.sum("n").over(Window.partitionBy("veh", "at"))
    counted = points.withColumns({"upto": upto, "here": here})
    per = counted.groupBy("id").agg(
        F.max(F.when(F.col("kind") == 1, F.col("upto") - F.col("here"))).alias("before"), F.max(F.when(F.col("kind") == 2, F.col("upto"))).alias("until")
    )
    between = F.when(F.col("until").isNotNull(), F.greatest(F.lit(0), F.col("before") - F.col("until")))
    return rows.join(per.select("id", between.alias("between")), "id", "left")


def another_near(rows: DataFrame, by: Sequence[str], before: int, after: int, name: str = "near", veh: str = "veh", t: str = "t", width: int = 86_400) -> DataFrame:
    """rows with a boolean: whether a row of the same key and another vehicle lies from `before` seconds earlier to `after` later.

    A key's rows at one second are one point, of one vehicle or of several. The latest earlier point of another vehicle is the one before the run of points of the same vehicle that
    holds a point; so it is carried along as a running maximum, and so is the earliest later one from the other end, in blocks of `width` seconds. Rows without vehicle or time have none near."""
    key = F.struct(F.lit(0).alias("_"), *by)
    points = rows.where(F.col(veh).isNotNull() & F.col(t).isNotNull()).groupBy(key.alias("_k"), F.col(t).cast("long").alias("_t")).agg(F.min(veh).alias("_lo"), F.max(veh).alias("_hi"))

    def other(points: DataFrame, sign: int, out: str) -> DataFrame:
        """points with the time of the nearest point of another vehicle on one side."""
        turned = points.withColumn("_at", sign * F.col("_t"))
        block = F.floor(F.col("_at") / width)
        seen = running(turned, ["_k"], ["_at"], block, "max", F.struct("_at", "_lo", "_hi"), "_last", inclusive=False)
        same = (F.col("_last._lo") == F.col("_last._hi")) & (F.col("_last._lo") == F.col("_lo"))
        begun = F.when(F.col("_last").isNotNull() & ~same, F.col("_last._at"))
        return running(seen, ["_k"], ["_at"], block, "max", begun, out).drop("_at", "_last")

    both = other(written(other(written(points), 1, "_before")), -1, "_after")
    near = (F.col("_lo") != F.col("_hi")) | (F.col("_t") - F.col("_before") <= before) | (-F.col("_after") - F.col("_t") <= after)
    marked = both.select("_k", "_t", F.coalesce(near, F.lit(False)).alias(name))
    own = F.when(F.col(veh).isNotNull(), F.col(t).cast("long"))
    found = rows.withColumns({"_k": key, "_t": own}).join(marked, ["_k", "_t"], "left").drop("_k", "_t")
    return found.select(*rows.columns, F.coalesce(name, F.lit(False)).alias(name))


def frozen_runs(rows: DataFrame, by: Sequence[str] = ("veh",)) -> DataFrame:
    """by, a, b and n of runs of FROZEN_N reports at the same place (six decimals) over FROZEN_S seconds, without a gap over FROZEN_GAP_S,
    in which a speed of FROZEN_MPS was reported. rows have id, t, lat, lon and speed."""
    order = Window.partitionBy(*by).orderBy("t", "id")
    y, x = F.round("lat", 6), F.round("lon", 6)
    same = (F.lag(y).over(order) == y) & (F.lag(x).over(order) == x) & (F.col("t") - F.lag("t").over(order) <= FROZEN_GAP_S)
    runs = rows.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    per = runs.groupBy(*by, "run").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"), F.max(F.coalesce("speed", F.lit(0.0))).alias("top"))
    return per.where((F.col("n") >= FROZEN_N) & (F.col("b") - F.col("a") >= FROZEN_S) & (F.col("top") >= FROZEN_MPS)).select(*by, "a", "b", "n")


def jumps(rows: DataFrame, metres: Callable[[Column, Column], Column], by: Sequence[str] = ("veh",)) -> DataFrame:
    """by, a, b, n and far of episodes of position jumps: JUMP_M or more at over JUMP_MPS, merged where JUMP_MERGE_S apart at most.

    metres(row, row before) gives the distance of two structs of the rows (id, t and a position)."""
    order = Window.partitionBy(*by).orderBy("t", "id")
    here, last = F.struct("*"), F.lag(F.struct("*")).over(order)
    steps = rows.select(*by, "id", "t", here.alias("r"), last.alias("l")).where("l IS NOT NULL")
    steps = steps.select(*by, "id", "t", metres(F.col("r"), F.col("l")).alias("far"), (F.col("r.t") - F.col("l.t")).alias("took"))
    hit = steps.where((F.col("far") >= JUMP_M) & (F.col("took") > 0) & (F.col("far") / F.col("took") > JUMP_MPS))
    new = F.when(F.col("t") - F.lag("t").over(order) <= JUMP_MERGE_S, 0).otherwise(1)
    hit = hit.withColumn("new", new).withColumn("episode", F.sum("new").over(order))
    return hit.groupBy(*by, "episode").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"), F.max("far").alias("far")).drop("episode")


def silent(rows: DataFrame, by: Sequence[str], t: str, least: int) -> DataFrame:
    """by, a and b of gaps of `least` seconds or more between a key's rows; rows at one time count once."""
    times = rows.select(*by, F.col(t).alias("b")).distinct()
    return times.withColumn("a", F.lag("b").over(Window.partitionBy(*by).orderBy("b"))).where(F.col("b") - F.col("a") >= least).select(*by, "a", "b")


def fillers(rows: DataFrame, by: Sequence[str], most: int = 3) -> DataFrame:
    """rows (seq, predicted) with kind: filler (0 to `most` seconds after the entry before it), head (such a one follows), else normal."""
    order = Window.partitionBy(*by).orderBy("seq")
    close = lambda a, b: F.coalesce((b - a).between(0, most), F.lit(False))
    follows = close(F.lag("predicted").over(order), F.col("predicted"))
    leads = close(F.col("predicted"), F.lead("predicted").over(order))
    return rows.withColumn("kind", F.when(follows, "filler").when(leads, "head").otherwise("normal"))


def drops(sightings: DataFrame, end: int | Column, gone: int = 600) -> DataFrame:
    """route, veh, t, before, after, lasting and returned_s: vehicles that left a route which others kept running.

    sightings have route, veh and t. A vehicle leaves at its last sighting if none follows for `gone` seconds. Others run if they were
    seen in the `gone` seconds before the leave is certain. lasting is 1 if it stays away for LASTING_S seconds, 0 if it comes back
    sooner, and null (unknown) as long as the log, which ends at `end`, does not reach so far.

    A vehicle counts from a sighting until `gone` seconds after the last one that follows closely: a change of +1 and one of -1. Changes are summed by route and second, and
    their running sum, cut into days, is read where a leave is certain. So a route's sightings never meet each other."""
    order = Window.partitionBy("route", "veh").orderBy("t")
    end = F.lit(end) if isinstance(end, int) else end
    rows = sightings.select("route", "veh", "t").where("veh IS NOT NULL AND t IS NOT NULL").distinct()
    rows = rows.withColumns({"next": F.lead("t").over(order), "last": F.lag("t").over(order), "log_end": end})
    opens, closes = F.coalesce(F.col("t") - F.col("last") >= gone, F.lit(True)), F.coalesce(F.col("next") - F.col("t") >= gone, F.lit(True))
    leaves = F.coalesce("next", "log_end") - F.col("t") >= gone
    change = lambda when, at, d: F.when(when, F.struct(at.alias("at"), F.lit(d).alias("d")))
    sure = F.col("t") + gone
    steps = rows.select("route", F.explode(F.array(change(opens, F.col("t"), 1), change(closes, sure, -1), change(leaves, sure, 0))).alias("c")).where("c IS NOT NULL")
    steps = steps.groupBy("route", "c.at").agg(F.sum("c.d").alias("d"))
    alive = running(steps, ["route"], ["at"], F.floor(F.col("at") / 86_400), "sum", F.col("d"), "n").select("route", F.col("at").alias("sure"), "n")
    left = rows.where(leaves).withColumn("sure", sure)
    # A vehicle that is back at that very second is no other.
    after = F.col("n") - F.coalesce(F.col("next") == F.col("sure"), F.lit(False)).cast("int")
    away = F.col("next") - F.col("t")
    lasting = F.when(away < LASTING_S, 0).when((away >= LASTING_S) | (F.col("log_end") - F.col("t") >= LASTING_S), 1)
    out = left.join(alive, ["route", "sure"]).withColumns({"after": after, "lasting": lasting}).where("after > 0")
    return out.select("route", "veh", "t", (F.col("after") + 1).alias("before"), "after", "lasting", away.alias("returned_s"))


def folded(rows: DataFrame, by: Sequence[str], order: Sequence[str], start: Callable[[], object], step: Callable[[object, tuple], tuple], outputs: str, reads: Sequence[str]) -> DataFrame:
    """rows with the columns `outputs` of an ordered fold of each key: step(state, values of `reads`) gives (state, outputs).

    Rows are dealt by key and sorted, and stream through; a task holds one state and one batch, however long a key's history."""
    names = [part.split()[0] for part in outputs.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, start()
        for batch in batches:
            out = []
            for k, values in zip(zip(*[batch[c] for c in by], strict=True), zip(*[batch[c] for c in reads], strict=True), strict=True):
                if k != key:
                    key, state = k, start()
                state, result = step(state, values)
                out.append(result)
            yield batch.assign(**dict(zip(names, zip(*out, strict=True), strict=True))) if out else batch.assign(**{n: [] for n in names})

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, f"{kind}, {outputs}")


def standing_since(rows: DataFrame, by: Sequence[str], radius: float, distance: Callable[[tuple, tuple], float], place: Sequence[str], t: str = "t", id_: str = "id") -> DataFrame:
    """rows with `since`: the time of the anchor, a row that stays the anchor until one is over `radius` away from it."""

    def step(anchor: tuple | None, values: tuple) -> tuple:
        now, here = values[0], values[1:]
        if anchor is None or distance(anchor[1], here) > radius:
            anchor = (now, here)
        return anchor, (anchor[0],)

    return folded(rows, by, [t, id_], lambda: None, step, "since long", [t, *place])
