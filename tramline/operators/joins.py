"""Temporal joins: as-of, nearest, tolerance, horizon and validity, over equi keys and whole seconds.

None of them crosses all pairs: as-of joins are one union and one window by key; range joins meet on a time
bin as wide as the range, so each row goes to two bins and a hot key is spread over its bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.operators.tracks import another_near


def asof(
    left: DataFrame, right: DataFrame, by: Sequence[str], t: str, id_: str, keep: Sequence[str], forward: bool = False, max_age: int | None = None, width: int = 86_400, tasks: int | None = None, times: DataFrame | None = None
) -> DataFrame:
    """left with the columns `keep` (and `at`) of the latest right row at or before t (or the earliest at or after it).

    Rows of both sides have unique `id_`s within their side; of right rows at one time that with the larger
    id counts (the smaller when looking forward). Rows older than max_age are dropped after the choice; a left row
    without a time finds none. A key is cut into blocks of `width` along t, and each block's last (first) right
    row is carried to the blocks after (before) it, as a row before all of theirs, so a key of any number of rows is spread over tasks
    and each task sorts once. With `tasks` the blocks are dealt to so many tasks, whatever their bytes. `times` (by and t) may tell
    where left has rows, one row for each of its blocks at least, where left itself is costly to make."""
    r = right.where(F.col(t).isNotNull()).select(*by, t, F.col(id_).alias("_rid"), F.struct(F.col(t).alias("at"), *keep).alias("_r"))
    both = left.withColumn("_side", F.lit(1)).unionByName(r.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    block, cut = F.floor(F.col(t) / width).alias("_block"), [*by, "_block"]
    nearest, direction = (F.min_by, F.desc) if forward else (F.max_by, F.asc)
    ends = r.groupBy(*by, block).agg(nearest("_r", F.struct(t, "_rid")).alias("_end"))
    asked = (left if times is None else times).where(F.col(t).isNotNull()).select(*by, block).distinct().withColumn("_asked", F.lit(True))
    # A block may have a row of each side here; the frame holds the blocks before only.
    blocks = Window.partitionBy(*by).orderBy(direction("_block")).rangeBetween(Window.unboundedPreceding, -1)
    carried = asked.unionByName(ends, allowMissingColumns=True).withColumn("_r", F.last("_end", ignorenulls=True).over(blocks))
    carried = carried.where("_asked AND _r IS NOT NULL").select(*cut, "_r", F.lit(-1).alias("_side"))
    both = both.select("*", block).unionByName(carried, allowMissingColumns=True)
    if tasks:
        both = both.repartition(tasks, *cut)
    if forward:
        order = Window.partitionBy(*cut).orderBy(F.col(t).desc_nulls_first(), "_side", F.col("_rid").desc())
    else:
        order = Window.partitionBy(*cut).orderBy(F.col(t).asc_nulls_first(), "_side", "_rid")
    here = F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("_r", here).where("_side = 1").drop("_side", "_rid", "_block")
    age = F.abs(F.col(t) - F.col("_r.at"))
    ok = F.col(t).isNotNull() if max_age is None else age <= max_age
    return rows.withColumn("_r", F.when(ok, F.col("_r"))).select("*", *[F.col(f"_r.{c}").alias(c if c not in left.columns else f"r_{c}") for c in ("at", *keep)]).drop("_r")


def near(left: DataFrame, right: DataFrame, by: Sequence[str], t: str, before: int, after: int, how: str = "inner", prefix: str = "r_", id_: str = "event_id") -> DataFrame:
    """Pairs with right.t in [left.t - before, left.t + after]; right columns get a prefix. Inner, or semi or anti by the left rows' id."""
    width = before + after + 1
    r = right.select(*[F.col(c).alias(prefix + c) for c in right.columns])
    low, high = F.floor((F.col(t) - before) / width), F.floor((F.col(t) + after) / width)
    bins = left.withColumn("_bin", F.explode(F.array_distinct(F.array(low, high))))
    keyed = r.withColumn("_rbin", F.floor(F.col(prefix + t) / width))
    on = [F.col(c).eqNullSafe(F.col(prefix + c)) for c in by] + [F.col("_bin") == F.col("_rbin"), F.col(prefix + t).between(F.col(t) - before, F.col(t) + after)]
    test: Column = on[0]
    for x in on[1:]:
        test = test & x
    if how == "inner":
        return bins.join(keyed, test).drop("_bin", "_rbin")
    hit = bins.join(keyed, test, "left_semi").select(id_).distinct()
    return left.join(hit, id_, how)


def on_display(left: DataFrame, shown: DataFrame, by: Sequence[str], t: str, grace: int) -> DataFrame:
    """left with the newest shown row seen at or before t, if it was still shown at t - grace.

    shown has seen, last and event_id. The newest row is chosen first and tested then: filtering first would
    bring back what was withdrawn."""
    found = asof(left, shown.withColumn(t, F.col("seen")), by, t, "event_id", ["seen", "last"])
    alive = F.col("last") >= F.col(t) - grace
    return found.withColumns({"seen": F.when(alive, F.col("seen")), "last": F.when(alive, F.col("last"))}).drop("at")


def shown_to_bus(left: DataFrame, shown: DataFrame, by: Sequence[str], t: str, grace: int, alone: int = 600) -> DataFrame:
    """left (with veh) and the newest row shown for its key: the bus's own or, where no other bus of left has that key
    within `alone` seconds, one that names no bus; the own one where both are as new.

    As in on_display the newest is chosen first, and is then tested for being shown still at t - grace."""
    rows = another_near(left, by, alone, alone, "_others", "veh", t)
    dated = shown.withColumn(t, F.col("seen"))
    own = asof(rows, dated.where(F.col("veh").isNotNull()), [*by, "veh"], t, "event_id", ["seen", "last"]).drop("at")
    both = asof(own, dated.where(F.col("veh").isNull()).drop("veh"), by, t, "event_id", ["seen", "last"]).drop("at")
    nameless = ~F.col("_others") & F.col("r_seen").isNotNull() & (F.col("seen").isNull() | (F.col("r_seen") > F.col("seen")))
    both = both.withColumns({c: F.when(nameless, F.col(f"r_{c}")).otherwise(F.col(c)) for c in ("seen", "last")})
    alive = F.col("last") >= F.col(t) - grace
    return both.withColumns({c: F.when(alive, F.col(c)) for c in ("seen", "last")}).drop("r_seen", "r_last", "_others")


def overlaps(left: DataFrame, right: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """Pairs of half-open intervals (a, b) and (ra, rb) that overlap, met once, on bins of `width` seconds."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    x = left.where("b > a").withColumn("_bin", bins("a", "b"))
    y = right.where("rb > ra").withColumn("_bin", bins("ra", "rb"))
    first = F.col("_bin") == F.floor(F.greatest("a", "ra") / width)
    return x.join(y, [*by, "_bin"]).where((F.col("a") < F.col("rb")) & (F.col("ra") < F.col("b")) & first).drop("_bin")
