"""Ordered folds: three kinds of duplicate removal, islands, interval algebra and recurrences."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.operators.cuts import running
from tramline.operators.tracks import folded


def chained(rows: DataFrame, by: Sequence[str], t: str, gap: int, id_: str) -> DataFrame:
    """rows with `repeat`: within gap of the row before it, kept or not."""
    w = Window.partitionBy(*by).orderBy(t, id_)
    return rows.withColumn("repeat", F.coalesce(F.col(t) - F.lag(t).over(w) <= gap, F.lit(False)))


def anchored(rows: DataFrame, by: Sequence[str], t: str, gap: int, id_: str) -> DataFrame:
    """rows that are kept when each within gap of the last *kept* row of its key is dropped.

    A fold over a key's sorted rows; keys here are a vehicle's or visitor's, cut at silences longer than gap
    first (no fold crosses one), so that an array is a stretch of activity and not a whole history."""
    w = Window.partitionBy(*by).orderBy(t, id_)
    cut = F.coalesce(F.col(t) - F.lag(t).over(w) > gap, F.lit(True)).cast("int")
    rows = rows.withColumn("_stretch", F.sum(cut).over(w))
    packed = rows.groupBy(*by, "_stretch").agg(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(id_).alias("id")))).alias("x"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<long>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        keep = acc["last"].isNull() | (x["t"] - acc["last"] > gap)
        yes = F.struct(x["t"].alias("last"), F.concat(acc["kept"], F.array(x["id"])).alias("kept"))
        return F.when(keep, yes).otherwise(acc)

    kept = packed.select(F.explode(F.aggregate("x", start, step, lambda a: a["kept"])).alias(id_))
    return rows.drop("_stretch").join(kept, id_, "left_semi")


def _first_hits(fields: Sequence[str], gap: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The fold of `ranked_merge` over the rows of stretches, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, times, places, done = None, [], [], []
        for batch in batches:
            columns = [batch[c].tolist() for c in fields]
            for k, t, rank, event in zip(zip(*columns, strict=True), batch["t"].tolist(), batch["rank"].tolist(), batch["event_id"].tolist(), strict=True):
                if k != key:
                    done += [p[2] for p in places]
                    key, times, places = k, [], []
                near = range(bisect_left(times, (t - gap, -1)), bisect_left(times, (t + gap + 1, -1)))
                hit = min((times[i][1] for i in near), default=None)
                if hit is None:
                    insort(times, (t, len(places)))
                    places.append((t, rank, event))
                elif rank > places[hit][1]:
                    places[hit] = (places[hit][0], rank, event)
            # One table a batch: stretches are far more than batches.
            yield pd.DataFrame({"event_id": done}, dtype="int64")
            done = []
        yield pd.DataFrame({"event_id": [p[2] for p in places]}, dtype="int64")

    return run


def ranked_merge(rows: DataFrame, by: Sequence[str], gap: int) -> DataFrame:
    """First-hit merge: a row within gap of one already kept takes its place if its rank is higher, else it goes.

    rows have t, rank and event_id, whole numbers, and come in order of event_id. A row that takes a place leaves that place at the time of
    the row that opened it, so chains do not drift. Keys are cut at silences longer than gap, over which nothing is near; the
    places of a stretch are kept in order of time and found by bisection, the earliest opened first."""
    w = Window.partitionBy(*by).orderBy("t", "event_id")
    new = F.coalesce(F.col("t") - F.lag("t").over(w) > gap, F.lit(True)).cast("int")
    cut = rows.withColumn("_stretch", F.sum(new).over(w)).select(*by, "_stretch", "t", "rank", "event_id")
    fields = [*by, "_stretch"]

    dealt = cut.repartition(*fields).sortWithinPartitions(*fields, "event_id")
    return rows.join(dealt.mapInPandas(_first_hits(fields, gap), "event_id long"), "event_id", "left_semi")


def islands(rows: DataFrame, by: Sequence[str], t: str, gap: int, id_: str) -> DataFrame:
    """rows with `island`: a number that grows where the row before is more than gap away."""
    w = Window.partitionBy(*by).orderBy(t, id_)
    new = F.coalesce(F.col(t) - F.lag(t).over(w) > gap, F.lit(True)).cast("int")
    return rows.withColumn("island", F.sum(new).over(w))


def interval_unions(rows: DataFrame, by: Sequence[str], width: int = 86_400) -> DataFrame:
    """Unions of touching intervals (a, b) of each key, swept in blocks of `width` along a.

    A union is named by its start, which is the latest start of a union so far."""
    block = F.floor(F.col("a") / width)
    met = running(rows.select(*by, "a", "b"), by, ["a", "b"], block, "max", F.col("b"), "_reach", inclusive=False)
    start = F.when(F.coalesce(F.col("a") > F.col("_reach"), F.lit(True)), F.col("a"))
    named = running(met, by, ["a", "b"], block, "max", start, "_start")
    return named.groupBy(*by, "_start").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_start")


def decayed(rows: DataFrame, by: Sequence[str], tau: float, alpha: float = 0.5) -> DataFrame:
    """rows (t, event_id, value) with `level`: what is left, before each row, of an exponentially weighted mean that fades to 0.

    A row moves the faded level by alpha of what it misses; between rows the level fades by exp(-dt / tau). Without a row before it is 0."""

    def step(state: tuple | None, values: tuple) -> tuple:
        t, value = values
        level = state[0] * math.exp(-max(0.0, t - state[1]) / tau) if state else 0.0
        return (level + alpha * (value - level), t), (level,)

    return folded(rows, by, ["t", "event_id"], lambda: None, step, "level double", ["t", "value"])


def smoothed(rows: DataFrame, by: Sequence[str], noise: float = 25.0, drift: float = 1.0, gate: float = 9.0) -> DataFrame:
    """Constant-velocity Kalman filter of `value` over t for each key, with `estimate` and `rejected`.

    A measurement whose normalised squared innovation exceeds the gate is rejected; after three in a row the next one is used all the
    same, and velocity is kept. It is never below 0. State: position, velocity, their covariances, time, rejects in a row."""

    def step(state: tuple | None, values: tuple) -> tuple:
        t, z = values
        if state is None:
            return (z, 0.0, noise, 0.0, 100.0, t, 0), (z, 0)
        s, v, a, b, d, last, run = state
        dt = t - last
        s = s + v * dt
        a, b, d = a + 2 * dt * b + dt * dt * d + drift * dt**3 / 3, b + dt * d + drift * dt**2 / 2, d + drift * dt
        miss, width = z - s, a + noise
        if miss * miss / width > gate and run < 3:
            return (s, v, a, b, d, t, run + 1), (s, 1)
        gain, pull = a / width, b / width
        s, v = s + gain * miss, max(0.0, v + pull * miss)
        return (s, v, a - gain * a, b - gain * b, d - pull * b, t, 0), (s, 0)

    return folded(rows, by, ["t", "event_id"], lambda: None, step, "estimate double, rejected int", ["t", "value"])
