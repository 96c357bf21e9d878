"""What a feed showed at each poll of a past day, rebuilt from a log of changes.

Every entry of the log counts from the first poll that saw it until a newer one takes its place or the last poll that showed it is too long ago. So entries become spans, and
what a vehicle's trip showed changes only where one of its spans begins or ends. A snapshot is one row for all polls between two changes, however many there are; polls meet
snapshots only where they are asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.operators.lineage import written
from tramline.operators.tracks import folded

#: Seconds between polls, and how long an entry counts after the last poll that showed it.
GRID_S, SLACK_S = 30, 90


def _up(t: Column, grid: int) -> Column:
    return F.ceil(t / grid) * grid


def spans(log: DataFrame, by: Sequence[str], keep: Sequence[str], grid: int = GRID_S, slack: int = SLACK_S) -> DataFrame:
    """by, keep, a and b: each entry that ever counted, with the first and last poll at which it did.

    log: by, id, seen and last (first and last poll that showed the entry), made and keep. Entries are taken in the order in which they were seen. One that was made before
    the entry that counts is out of date and passed over, unless that one has lapsed by then. Entries seen between the same two polls count as of the later one, the last of them."""
    rows = log.select(*by, "id", "seen", F.greatest("last", "seen").alias("last"), "made", *keep).withColumn("a", _up(F.col("seen"), grid).cast("long"))

    def step(held: tuple | None, values: tuple) -> tuple:
        made, last, at = values
        lapsed = held is not None and held[1] + slack < at - grid
        if held is None or lapsed or made >= held[0]:
            return (made, last), (True,)
        return held, (False,)

    marked = folded(rows, by, ["seen", "made", "id"], lambda: None, step, "_counts boolean", ["made", "last", "a"]).where("_counts").drop("_counts")
    following = F.lead("a").over(Window.partitionBy(*by).orderBy("seen", "made", "id"))
    lapse = F.floor((F.col("last") + slack) / grid) * grid
    out = marked.withColumn("b", F.least(lapse, F.coalesce(following - grid, lapse)).cast("long"))
    return out.where("b >= a").select(*by, *keep, "a", "b")


def snapshots(held: DataFrame, group: Sequence[str], order: str, shown: Sequence[str], grid: int = GRID_S) -> DataFrame:
    """group, a, b and entries (structs of order and shown, sorted): what a group (a vehicle's trip) showed at all polls from a to b.

    held: spans of the group's keys. Neighbouring stretches that show the same are one."""
    held = written(held)
    ends = held.select(*group, F.explode(F.array(F.col("a"), F.col("b") + grid)).alias("from")).distinct()
    along = Window.partitionBy(*group).orderBy("from")
    parts = ends.withColumn("to", F.lead("from").over(along) - grid).where("`to` IS NOT NULL")
    # A span is dealt to the stretches that begin within it.
    names = [*group]
    left = held.select(*names, "a", "b", F.struct(order, *shown).alias("e"))
    numbered = parts.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy("from")))
    starts = numbered.select(*names, F.col("from").alias("a"), F.col("n").alias("first"))
    stops = numbered.select(*names, F.col("to").alias("b"), F.col("n").alias("until"))
    dealt = left.join(starts, [*names, "a"]).join(stops, [*names, "b"]).withColumn("n", F.explode(F.sequence("first", "until")))
    whole = dealt.groupBy(*names, "n").agg(F.array_sort(F.collect_list("e")).alias("entries")).join(numbered, [*names, "n"])
    line = Window.partitionBy(*names).orderBy("from")
    same = (F.lag("entries").over(line) == F.col("entries")) & (F.lag("to").over(line) + grid == F.col("from"))
    runs = whole.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("new").over(line))
    return runs.groupBy(*names, "run").agg(F.min("from").alias("a"), F.max("to").alias("b"), F.first("entries").alias("entries")).drop("run")


def shown_at_polls(polls: DataFrame, snaps: DataFrame, grid: int = GRID_S, width: int = 3600) -> DataFrame:
    """t and the columns of the snapshots that counted at it, for polls (t, on the grid): an equi join on bins of `width` seconds."""
    bins = F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.col("b") / width)))
    met = polls.select("t", F.floor(F.col("t") / width).alias("_bin")).join(snaps.withColumn("_bin", bins), "_bin")
    return met.where(F.col("t").between(F.col("a"), F.col("b"))).drop("_bin", "a", "b")
