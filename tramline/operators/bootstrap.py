"""Intervals of shares by drawing whole days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drawn(draw: Column, slot: Column, days: Column) -> Column:
    """The place (from 1) of the day that a slot of a draw takes; by a hash, so reruns agree."""
    u = F.xxhash64(draw, slot).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    return F.floor(u * days).cast("int") + 1


def day_shares(days: DataFrame, by: Sequence[str], draws: int = 200, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """by, share, low and high: the share of hits over all days, and the ends of the middle `draws` shares of as many whole days, drawn with replacement.

    days: by, day, n and hit, one row a day. Draws without rows are left out; a key of one day has no ends, one without rows no share. Only the days' sums are drawn, so
    the work is days times draws, however many rows a day has."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("day")).cast("int")
    many = F.count("*").over(Window.partitionBy(*by)).cast("int")
    held = days.withColumns({"_place": place, "_days": many})
    slots = held.where("_days > 1").select(*by, "_days", F.col("_place").alias("_slot"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_draw"))
    picks = slots.withColumn("_place", drawn(F.col("_draw"), F.col("_slot"), F.col("_days"))).drop("_days", "_slot")
    sums = picks.join(held.select(*by, "_place", "n", "hit"), [*by, "_place"]).groupBy(*by, "_draw").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).where("n > 0")
    sims = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.col("hit") / F.col("n"))).alias("_s"))
    size = F.size("_s")
    ends = sims.select(*by, F.get("_s", F.floor(size * low).cast("int")).alias("low"), F.get("_s", F.greatest(F.lit(0), F.floor(size * high).cast("int") - 1)).alias("high"))
    whole = days.groupBy(*by).agg((F.sum("hit") / F.nullif(F.sum("n"), F.lit(0))).alias("share"))
    return whole.join(ends, list(by), "left")
