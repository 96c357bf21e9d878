"""Alignment of planned stops with live times, and the times of all stops that follow from it.

An alignment is the largest set of pairs (planned stop, live time) that keeps both orders, of stop and of time; of equally large ones that of least
cost. A key's pairs are cut where the alignment is certain: between two planned stops, where every live time that fits before lies before every one that fits after.
No pair crosses such a cut, so the parts are aligned apart, by tasks of their own, and a key of any length is spread over tasks. A part is as long as
delays let its pairs cross.

Which of several best alignments is taken depends on where the live times of the part before end, by one bit: whether a part's first fitting time is the very next one.
Parts are solved for both, and the bits are carried along the parts as running values."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.operators.cuts import numbered, running
from tramline.operators.joins import asof, near
from tramline.operators.lineage import written

#: Costs are compared in units of this size, and a pair more outweighs any cost.
UNIT, PAIR = 1e-9, 1 << 60
#: Planned stops of a block of running values.
BLOCK = 4096


def best_pairs(pairs: Sequence[tuple[int, int, int]], adjacent: bool) -> list[tuple[int, int]]:
    """The alignment of a part's pairs (stop, time, cost), as pairs of stop and time.

    Of the best alignments: if one uses the very next live time, that with the earliest stop for it; else that whose next stop is the latest
    one, at the earliest time. `adjacent`: the part's first time is the very next one at its begin."""
    last = max(q for _, q, _ in pairs)
    first = min(q for _, q, _ in pairs)
    tree = [0] * (last - first + 2)

    def after(q: int) -> int:
        """Best value of pairs of later times, among those entered."""
        i, value = last - q, 0
        while i > 0:
            value = max(value, tree[i])
            i -= i & -i
        return value

    def enter(q: int, value: int) -> None:
        i = last - q + 1
        while i < len(tree):
            tree[i] = max(tree[i], value)
            i += i & -i

    by_value: dict[int, list[tuple[int, int, int]]] = {}
    top = 0
    for _, group in groupby(sorted(pairs, reverse=True), key=lambda p: p[0]):
        whole = [(PAIR - cost + after(q), k, q, cost) for k, q, cost in group]
        for value, k, q, cost in whole:
            enter(q, value)
            by_value.setdefault(value, []).append((k, q, cost))
            top = max(top, value)
    out, k0, q0 = [], min(k for k, _, _ in pairs), first if adjacent else first - 1
    while top:
        open_ = [p for p in by_value[top] if p[0] >= k0 and p[1] >= q0]
        here = [p for p in open_ if p[1] == q0]
        k, q, cost = min(here) if here else min(open_, key=lambda p: (-p[0], p[1]))
        out.append((k, q))
        top -= PAIR - cost
        k0, q0 = k + 1, q + 1
    return out


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of parts in order; a part's rows may come in several batches."""
    held: list[tuple[int, int, int, int]] = []

    def closed(rows: list[tuple[int, int, int, int]]) -> list[tuple[int, bool, int, int]]:
        pairs = [r[1:] for r in rows]
        return [(rows[0][0], entry, k, q) for entry in (False, True) for k, q in best_pairs(pairs, entry)]

    for batch in batches:
        held += zip(batch.part.tolist(), batch.pos.tolist(), batch.q.tolist(), batch.cost.tolist(), strict=True)
        groups = [list(g) for _, g in groupby(held, key=lambda r: r[0])]
        held = groups.pop() if groups else []
        yield pd.DataFrame([r for g in groups for r in closed(g)], columns=["part", "entry", "pos", "q"])
    yield pd.DataFrame(closed(held) if held else [], columns=["part", "entry", "pos", "q"])


def _parts(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, pos and block: the number of the part that a planned stop with pairs belongs to, along its key."""
    ends = pairs.groupBy(*by, "pos").agg(F.min("q").alias("low"), F.max("q").alias("high"))
    cut = F.floor(F.col("pos") / BLOCK)
    seen = running(ends, by, ["pos"], cut, "max", F.col("high"), "before", inclusive=False)
    seen = written(running(seen.withColumn("back", -F.col("pos")), by, ["back"], F.floor(F.col("back") / BLOCK), "max", -F.col("low"), "rest"))
    new = F.when(F.col("before").isNull() | (F.col("before") < -F.col("rest")), 1).otherwise(0)
    return running(seen, by, ["pos"], cut, "sum", new, "block").select(*by, "pos", F.col("block").cast("long").alias("block"))


def aligned(planned: DataFrame, live: DataFrame, by: Sequence[str], before: int, after: int, cost: Column | None = None, may: Column | None = None) -> DataFrame:
    """by, pos, id and t: the live time of each planned stop that gets one.

    planned: by, pos (its number along the key), stop, due. live: by, id (unique in its key), stop, t. A live time fits a planned stop of the same name if it is
    from `before` seconds ahead of due to `after` seconds behind it, and `may` holds; cost (0 at least) and may see planned columns and live ones with r_ before
    their names. Rows with a null stop or time fit nothing; live times at one second are ordered by id."""
    rest = [c for c in live.columns if c not in (*by, "t", "id")]
    entries = numbered(live.where("t IS NOT NULL"), by, "t", "id", "q", keep=rest).where("stop IS NOT NULL")
    price = F.lit(0.0) if cost is None else F.when(cost > 0, cost).otherwise(0.0)
    pairs = near(planned.withColumnRenamed("due", "t").where("stop IS NOT NULL"), entries, [*by, "stop"], "t", before, after).withColumnRenamed("t", "due")
    pairs = pairs if may is None else pairs.where(may)
    pairs = written(pairs.select(*by, "pos", F.col("r_q").alias("q"), F.col("r_id").alias("id"), F.col("r_t").alias("t"), F.round(price / UNIT).cast("long").alias("cost")))
    parts = pairs.join(_parts(pairs, by), [*by, "pos"])
    key = F.struct(F.lit(0).alias("_"), *by)
    named = written(parts.withColumn("part", F.xxhash64(key, "block")))
    solved = named.select("part", "pos", "q", "cost").repartition("part").sortWithinPartitions("part", "pos", "q").mapInPandas(_solved, "part long, entry boolean, pos long, q long")
    both = written(solved.join(named.select(*by, "block", "part", "pos", "q", "id", "t"), ["part", "pos", "q"]))
    # The bit of each part: whether the live time that ends the part before is the one just before its first.
    ends = named.groupBy(*by, "block").agg(F.min("q").alias("first"))
    lasts = both.groupBy(*by, "block").agg(F.max(F.when(~F.col("entry"), F.col("q"))).alias("no"), F.max(F.when(F.col("entry"), F.col("q"))).alias("yes"))
    links = ends.join(lasts, [*by, "block"])
    follow = ends.select(*by, (F.col("block") - 1).alias("block"), F.col("first").alias("next"))
    links = links.join(follow, [*by, "block"], "left").withColumns({"no": (F.col("no") + 1 == F.col("next")).cast("int"), "yes": (F.col("yes") + 1 == F.col("next")).cast("int")})
    cut = F.floor(F.col("block") / BLOCK)
    links = written(running(links, by, ["block"], cut, "sum", (F.col("no") > F.col("yes")).cast("int"), "turns", inclusive=False))
    sure = F.when(F.col("no") == F.col("yes"), F.col("block") * 4 + F.col("no") * 2 + F.pmod("turns", F.lit(2)))
    start = F.when(F.col("block") == 1, F.lit(0) + (F.col("first") == 1).cast("int") * 2)
    links = running(links, by, ["block"], cut, "max", sure, "known", inclusive=False)
    links = running(links, by, ["block"], cut, "max", start, "begun")
    base = F.coalesce("known", "begun")
    entry = F.pmod(F.shiftright(base, 1) + F.col("turns") + base, F.lit(2)) == 1
    chosen = links.select(*by, "block", entry.alias("entry"))
    return both.join(chosen, [*by, "block", "entry"]).select(*by, "pos", "id", "t")


def stop_times(stops: DataFrame, by: Sequence[str]) -> DataFrame:
    """stops with `at` and `est`: a time for every stop of a bus, live or estimated.

    stops: by, pos, ride (scheduled seconds from where the bus is), live (null where none), now. Between two live times an estimate shares their span out as the rides
    do; after the last it adds the ride; before the first it shares out the span from now (or, if that lies behind now, counts back). No time is before now, nor an
    estimate before any stop ahead of it on the way."""
    anchors = stops.where("live IS NOT NULL").select(*by, "pos", F.col("pos").alias("id"), F.col("live").alias("a"), F.col("ride").alias("c"))
    rows = stops.withColumn("id", F.col("pos"))
    back = asof(rows, anchors, by, "pos", "id", ["a", "c"], width=BLOCK).withColumnsRenamed({"at": "_j", "a": "_ja", "c": "_jc"})
    both = asof(written(back), anchors, by, "pos", "id", ["a", "c"], forward=True, width=BLOCK).withColumnsRenamed({"at": "_m", "a": "_ma", "c": "_mc"})
    live, ride, now = F.col("live"), F.col("ride"), F.col("now")
    ja, jc, ma, mc = (F.col(c) for c in ("_ja", "_jc", "_ma", "_mc"))
    shared = (mc > jc) & (ma > ja)
    raw = (
        F.when(live.isNotNull(), live.cast("double"))
        .when(ja.isNotNull() & F.coalesce(shared, F.lit(False)), ja + (ma - ja) * ((ride - jc) / (mc - jc)))
        .when(ja.isNotNull(), ja + (ride - jc))
        .when(ma.isNotNull() & (ma > now) & (mc > 0), now + (ma - now) * F.least(F.lit(1.0), ride / mc))
        .when(ma.isNotNull(), ma - (mc - ride))
        .otherwise(now + ride)
    )
    both = written(both.withColumn("_raw", raw))
    floored = running(both, by, ["pos"], F.floor(F.col("pos") / BLOCK), "max", F.col("_raw"), "_floor", inclusive=False)
    at = F.when(live.isNotNull(), F.greatest(live.cast("double"), now.cast("double"))).otherwise(F.greatest("_raw", "_floor", now.cast("double")))
    return floored.select(*stops.columns, at.alias("at"), live.isNull().alias("est"))


def board(times: DataFrame, live: DataFrame, by: Sequence[str]) -> DataFrame:
    """stop, by, at, kind (live or est) and away: the times at every stop, of all buses.

    times: by, pos, stop, at, est (of stop_times); live: by, id, stop, t. A bus's live row stays unless it is earlier than its own way allows; where none of its rows at a stop
    agrees with its time there (within a second), that time is shown. At a stop that a bus meets twice its first time counts."""
    first = Window.partitionBy(*by, "stop").orderBy("pos")
    own = times.withColumn("_o", F.row_number().over(first)).where("_o = 1").select(*by, "stop", "at", "est", F.col("pos").alias("away"))
    rows = live.join(own, [*by, "stop"], "left")
    stays = rows.where(F.col("at").isNull() | (F.col("t") >= F.col("at") - 1)).withColumn("kept", F.coalesce(F.abs(F.col("t") - F.col("at")) <= 1, F.lit(False)))
    agreed = stays.where("kept").select(*by, "stop").distinct()
    shown = stays.select(*by, "stop", F.col("t").cast("double").alias("at"), F.lit("live").alias("kind"), F.lit(None).cast("long").alias("away"))
    more = own.join(agreed, [*by, "stop"], "left_anti").select(*by, "stop", "at", F.when(F.col("est"), "est").otherwise("live").alias("kind"), F.col("away").cast("long").alias("away"))
    return shown.unionByName(more)
