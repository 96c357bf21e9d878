"""One-dimensional clusters of bounded width, for times of day."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.operators.cuts import running
from tramline.operators.lineage import written


def _split(values: np.ndarray, width: float, least: float) -> list[tuple[int, int]]:
    """First and last place of each cluster of sorted distinct values: a span wider than `width` is cut at its largest gap (the last of equal ones) if that is `least` or more."""
    gaps, out, open_ = np.diff(values), [], [(0, len(values) - 1)]
    while open_:
        a, b = open_.pop()
        if b > a and values[b] - values[a] > width:
            inside = gaps[a:b][::-1]
            at = b - 1 - int(np.argmax(inside))
            if gaps[at] >= least:
                open_ += [(at + 1, b), (a, at)]
                continue
        out.append((a, b))
    return out


def clusters(rows: DataFrame, by: Sequence[str], value: str, gap: float, width: float, least: float, block: float = 3600.0) -> DataFrame:
    """by, a, b, n and cluster (numbered from 1 along the key) of values that lie together.

    Values more than `gap` apart part; a cluster wider than `width` is cut at its largest gap, and its parts again, as long as that gap is `least` or more. Equal
    values are counted before anything else, and a key is cut at its wide gaps by running values in blocks; so what one task holds is the distinct values
    between two wide gaps, which a day's clock bounds. Rows without a value are left out."""
    key = F.struct(F.lit(0).alias("_"), *by)
    g = rows.where(F.col(value).isNotNull()).groupBy(key.alias("_k"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    cut = F.floor(F.col("_v") / block)
    seen = running(g, ["_k"], ["_v"], cut, "max", F.col("_v"), "_last", inclusive=False)
    new = F.when(F.col("_last").isNull() | (F.col("_v") - F.col("_last") > gap), 1).otherwise(0)
    isles = running(seen, ["_k"], ["_v"], cut, "sum", new, "_isle").select("_k", F.col("_isle").cast("long").alias("_isle"), "_v", "_n")
    kind = f"_k {g.schema['_k'].dataType.simpleString()}, a double, b double, n long"

    def parted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_v")
        v, n = rows["_v"].to_numpy(), rows["_n"].to_numpy()
        found = _split(v, width, least)
        return pd.DataFrame({"_k": [rows["_k"].iloc[0]] * len(found), "a": [v[i] for i, _ in found], "b": [v[j] for _, j in found], "n": [int(n[i : j + 1].sum()) for i, j in found]})

    spans = written(isles.groupBy(F.struct("_k", "_isle").alias("_g")).applyInPandas(parted, kind))
    return running(spans, ["_k"], ["a"], F.floor(F.col("a") / block), "sum", F.lit(1), "cluster").select(*[F.col("_k")[c].alias(c) for c in by], "a", "b", "n", "cluster")
