"""Exact quantiles, places and running values of keys of any size.

A key is cut along its order: values into bins of equal width between its least and greatest value, times into
blocks. The bins' or blocks' totals are few and carry over to the next ones, so a task holds one bin or block
and never a whole key. A bin that a value of many rows fills is counted by value before it is sorted. Where most of
a key's distinct values lie in one bin (a far outlier), that bin is sorted by one task, spilling to disk; results are the same.
Keys may be null, and count as one key."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a key at most, and rows that a bin is meant to hold.
BINS, BIN_ROWS = 1024, 8192
#: A bin of so many times its rows is crowded.
CROWDED = 16
_START = Window.unboundedPreceding


def _key(by: Sequence[str], *more: Column) -> Column:
    """One column for a key: structs are equal where both fields are null, so joins keep null keys."""
    return F.struct(F.lit(0).alias("_"), *by, *more)


def _spread(rows: DataFrame, by: Sequence[str], value: str, weight: str | None, bins: int, more: Mapping[str, str] | None = None) -> DataFrame:
    """_key, _v, _c, _n, _bin and the columns `more` (by their new names) of the rows with a value. A key has as many bins as its rows fill, `bins` at most, so small keys have one."""
    count, more = F.col(weight) if weight else F.lit(1), more or {}
    g = rows.where(F.col(value).isNotNull()).select(_key(by).alias("_key"), F.col(value).alias("_v"), count.cast("long").alias("_c"), *[F.col(c).alias(n) for n, c in more.items()])
    span = g.groupBy("_key").agg(F.min("_v").cast("double").alias("_lo"), F.max("_v").cast("double").alias("_hi"), F.sum("_c").alias("_n"))
    span = span.withColumn("_bins", F.least(F.lit(bins).cast("long"), F.ceil(F.col("_n") / BIN_ROWS)))
    wide = F.col("_hi") - F.col("_lo")
    share = (F.col("_v").cast("double") - F.col("_lo")) / F.nullif(wide, F.lit(0.0))
    bin_ = F.when((wide > 0) & (wide < float("inf")), F.least(F.col("_bins") - 1, F.floor(share * F.col("_bins")))).otherwise(F.lit(0).cast("long"))
    return g.join(span, "_key").select("_key", "_v", "_c", *more, "_n", bin_.alias("_bin"))


def at_ranks(rows: DataFrame, by: Sequence[str], value: str, ranks: Mapping[str, Callable[[Column], Column]], weight: str | None = None, bins: int = BINS) -> DataFrame:
    """_key, n and a column for each of ranks: the value at a rank (from 0) of the key's n rows in ascending order, ranks being given n.

    weight, where given, is how many rows a row stands for. Nulls of value are left out, n too; a key without a value has no row. Only the bins that hold a
    wanted rank are sorted; values of bins far fuller than meant are counted before."""
    g = _spread(rows, by, value, weight, bins)
    totals = g.groupBy("_key", "_bin").agg(F.sum("_c").alias("_held"), F.max("_n").alias("_n"))
    before = F.sum("_held").over(Window.partitionBy("_key").orderBy("_bin").rowsBetween(_START, -1))
    totals = totals.withColumn("_before", F.coalesce(before, F.lit(0)))
    at = {name: rank(F.col("_n")) for name, rank in ranks.items()}

    def holds(rank: Column, at: str, count: str) -> Column:
        return (rank >= F.col(at)) & (rank < F.col(at) + F.col(count))

    wanted = totals.where(reduce(Column.__or__, [holds(r, "_before", "_held") for r in at.values()])).select("_key", "_bin", "_before", "_held")
    crowded = F.col("_held") > CROWDED * BIN_ROWS
    columns = ["_key", "_bin", "_n", "_before", "_v", "_c"]
    inside = g.join(wanted if weight else wanted.where(~crowded), ["_key", "_bin"]).select(columns)
    if not weight:
        # Bins that a value of many rows fills are few.
        counted = g.join(F.broadcast(wanted.where(crowded)), ["_key", "_bin"]).groupBy(columns[:-1]).agg(F.sum("_c").alias("_c"))
        inside = inside.unionByName(counted)
    smaller = F.sum("_c").over(Window.partitionBy("_key", "_bin").orderBy("_v").rowsBetween(_START, -1))
    placed = inside.withColumn("_at", F.col("_before") + F.coalesce(smaller, F.lit(0)))
    return placed.groupBy("_key").agg(F.max("_n").alias("n"), *[F.max(F.when(holds(r, "_at", "_c"), F.col("_v"))).alias(name) for name, r in at.items()])


def quantiles(rows: DataFrame, by: Sequence[str], value: str, qs: Mapping[str, float], weight: str | None = None, bins: int = BINS) -> DataFrame:
    """by, n and a column for each of qs: exact quantiles between the two nearest values, by linear interpolation (rows and weight as for `at_ranks`)."""
    ranks = {f"_a_{name}": lambda n, q=q: F.floor((n - 1) * q) for name, q in qs.items()} | {f"_b_{name}": lambda n, q=q: F.ceil((n - 1) * q) for name, q in qs.items()}
    out = at_ranks(rows, by, value, ranks, weight, bins)
    last = F.col("n") - 1
    low, high = (lambda name, side=side: F.col(f"_{side}_{name}").cast("double") for side in "ab")
    between = [(low(name) + (high(name) - low(name)) * (last * q - F.floor(last * q))).alias(name) for name, q in qs.items()]
    return out.select(*[F.col("_key")[c].alias(c) for c in by], "n", *between)


def numbered(rows: DataFrame, by: Sequence[str], value: str, tie: str, name: str, bins: int = BINS, keep: Sequence[str] = ()) -> DataFrame:
    """by, value, tie, the columns `keep` and the row's number (from 1) in ascending order of value, then of tie.

    tie is a number, unique among the rows of a key and value. Rows without value or tie are left out. A bin that equal or crowded values make far
    fuller than the others is cut by value, and each value by tie."""
    g = _spread(rows.where(F.col(tie).isNotNull()), by, value, None, bins, {"_tie": tie} | {f"_keep_{c}": c for c in keep})
    full = g.groupBy("_key", "_bin").agg(F.count("*").alias("_held"), F.min("_tie").alias("_lo"), F.max("_tie").alias("_hi"), F.max("_n").alias("_n"))
    full = full.where(F.col("_held") > CROWDED * F.greatest(F.lit(BIN_ROWS), F.ceil(F.col("_n") / bins)))
    slices = F.ceil(F.col("_held") / BIN_ROWS)
    g = g.drop("_n", "_c").join(full.select("_key", "_bin", "_lo", ((F.col("_hi") - F.col("_lo") + 1) / slices).alias("_wide")), ["_key", "_bin"], "left")
    crowded = F.col("_wide").isNotNull()
    block = F.struct("_bin", F.when(crowded, F.col("_v")).alias("v"), F.when(crowded, F.floor((F.col("_tie") - F.col("_lo")) / F.col("_wide"))).alias("t"))
    placed = running(g.withColumn("_block", block), ["_key"], ["_v", "_tie"], F.col("_block"), "sum", F.lit(1), name)
    return placed.select(*[F.col("_key")[c].alias(c) for c in by], F.col("_v").alias(value), F.col("_tie").alias(tie), *[F.col(f"_keep_{c}").alias(c) for c in keep], name)


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str], block: Column, fold: str, x: Column, name: str, inclusive: bool = True) -> DataFrame:
    """rows with the running sum or max (fold) of x in the given order, cut into blocks that never fall along it.

    Without `inclusive` the row itself is left out; then the max of the leading order column is the row before's.
    A sum of nothing is 0, a max of nothing null."""
    if fold not in ("sum", "max"):
        raise ValueError(f"fold is sum or max, not {fold}")
    over = F.sum if fold == "sum" else F.max
    cut = rows.withColumn("_x", x).withColumn("_cut", F.struct(_key(by).alias("key"), block.alias("block")))
    totals = cut.groupBy("_cut").agg(over("_x").alias("_whole"))
    earlier = over("_whole").over(Window.partitionBy("_cut.key").orderBy("_cut.block").rowsBetween(_START, -1))
    here = over("_x").over(Window.partitionBy("_cut").orderBy(*order).rowsBetween(_START, 0 if inclusive else -1))
    both = cut.join(totals.select("_cut", earlier.alias("_earlier")), "_cut").withColumn("_here", here)
    if fold == "sum":
        value = F.coalesce(F.col("_here"), F.lit(0)) + F.coalesce(F.col("_earlier"), F.lit(0))
    else:
        value = F.greatest("_here", "_earlier")
    return both.withColumn(name, value).drop("_x", "_cut", "_here", "_earlier")


def trailing_median(rows: DataFrame, by: Sequence[str], t: str, value: str, id_: str, width: int, name: str, spans: int = 8) -> DataFrame:
    """id_, n and the exact median of the values of the key's rows in the `width` seconds before each row, the row's own second left out; rows with none before them have no row.

    A key is cut into blocks of `spans` widths, and the last rows of a block stand before the next one too. Blocks stream through in order of time; a task holds the values of
    one width, sorted, however many rows a key or block has. n counts rows without a value too."""
    long = spans * width
    last = F.floor(F.col(t) / long)
    blocks = F.array_distinct(F.array(last, F.floor((F.col(t) + width) / long)))
    cut = rows.where(F.col(t).isNotNull()).select(F.to_json(_key(by), {"ignoreNullFields": "false"}).alias("_key"), F.col(t).cast("long").alias("t"), F.col(value).cast("double").alias("v"), F.col(id_).cast("long").alias("id"), last.alias("_own"), F.explode(blocks).alias("_block"))
    cut = cut.select("_key", "_block", "t", "v", "id", (F.col("_own") == F.col("_block")).alias("asks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, now, fresh, window, values = None, None, [], deque(), []
        for batch in batches:
            out = []
            for *at, t, v, i, asks in zip(*[batch[c].tolist() for c in ("_key", "_block", "t", "v", "id", "asks")], strict=True):
                if at != block:
                    block, now, fresh, window, values = at, None, [], deque(), []
                if t != now:
                    for x in fresh:
                        window.append((now, x))
                        if x == x:
                            insort(values, x)
                    now, fresh = t, []
                    while window and window[0][0] < t - width:
                        x = window.popleft()[1]
                        if x == x:
                            del values[bisect_left(values, x)]
                fresh.append(v)
                if asks and window:
                    many = len(values)
                    low, high = (values[(many - 1) // 2], values[many // 2]) if many else (None, None)
                    out.append((i, len(window), low + (high - low) * 0.5 if many else None))
            yield pd.DataFrame(out, columns=["id", "n", "mid"])

    found = cut.repartition("_key", "_block").sortWithinPartitions("_key", "_block", "t").mapInPandas(run, "id long, n long, mid double")
    return found.select(F.col("id").alias(id_), "n", F.col("mid").alias(name))


def expanding_median(rows: DataFrame, by: Sequence[str], step: str, value: str, name: str, bins: int = BINS) -> DataFrame:
    """by, step, n and the exact median of the values of all earlier steps of the key, for each step of a key with rows before it.

    Values are counted by step and bin, and the counts added up along the steps; only the bins that then hold a step's middle are looked into, with the values counted there."""
    g = rows.where(F.col(step).isNotNull() & F.col(value).isNotNull()).groupBy(*by, step, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    key = _key(by)
    g = g.withColumn("_k", key)
    span = g.groupBy("_k").agg(F.min("_v").cast("double").alias("_lo"), F.max("_v").cast("double").alias("_hi"))
    wide = F.col("_hi") - F.col("_lo")
    share = (F.col("_v").cast("double") - F.col("_lo")) / F.nullif(wide, F.lit(0.0))
    g = g.join(span, "_k").withColumn("_bin", F.when((wide > 0) & (wide < float("inf")), F.least(F.lit(bins - 1).cast("long"), F.floor(share * bins))).otherwise(F.lit(0).cast("long")))
    g = g.select("_k", step, "_v", "_c", "_bin")
    totals = g.groupBy("_k", "_bin", step).agg(F.sum("_c").alias("_c"))
    steps = rows.where(F.col(step).isNotNull()).select(key.alias("_k"), step).distinct()
    # Every bin of a key against every step of the key: counts, at most `bins` a step.
    grid = totals.select("_k", "_bin").distinct().join(steps, "_k").join(totals, ["_k", "_bin", step], "left")
    upto = F.coalesce(F.sum("_c").over(Window.partitionBy("_k", "_bin").orderBy(step).rowsBetween(_START, -1)), F.lit(0))
    cells = grid.select("_k", step, "_bin", upto.alias("_held")).where("_held > 0")
    along = Window.partitionBy("_k", step)
    cells = cells.withColumns({"n": F.sum("_held").over(along), "_before": F.coalesce(F.sum("_held").over(along.orderBy("_bin").rowsBetween(_START, -1)), F.lit(0))})
    low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    holds = lambda r, at, many: (r >= F.col(at)) & (r < F.col(at) + F.col(many))
    wanted = cells.where(holds(low, "_before", "_held") | holds(high, "_before", "_held")).withColumnRenamed(step, "_to")
    inside = wanted.join(g, ["_k", "_bin"]).where(F.col(step) < F.col("_to")).groupBy("_k", "_to", "_bin", "n", "_before", "_v").agg(F.sum("_c").alias("_c"))
    smaller = F.coalesce(F.sum("_c").over(Window.partitionBy("_k", "_to", "_bin").orderBy("_v").rowsBetween(_START, -1)), F.lit(0))
    placed = inside.withColumn("_at", F.col("_before") + smaller)
    pick = lambda r: F.max(F.when(holds(r, "_at", "_c"), F.col("_v"))).cast("double")
    out = placed.groupBy("_k", "_to").agg(F.max("n").alias("n"), ((pick(low) + pick(high)) / 2).alias(name))
    return out.select(*[F.col("_k")[c].alias(c) for c in by], F.col("_to").alias(step), "n", name)
