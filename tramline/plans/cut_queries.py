"""Statistics and sweeps over few, large keys, by the operators of operators/cuts.py.

The SQL of each is its statement in statements.py (or the sweep's below); the code here shares no text with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators.cuts import expanding_median, numbered, quantiles, running, trailing_median
from tramline.operators.sequences import interval_unions
from tramline.plans.statements import STATEMENTS
from tramline.sources.tables import events, table

QUERIES = {}

DAY = 86_400


def _add(f):
    QUERIES[f.__name__] = f
    return f


def _rounded(digits: int, *names: str) -> list[Column]:
    return [F.round(c, digits).alias(c) for c in names]


def _spread(rows: DataFrame, key: str, value: str) -> DataFrame:
    """n, median (mid) and median distance from it (away) of each key."""
    mid = quantiles(rows, [key], value, {"mid": 0.5})
    apart = rows.join(mid.select(key, "mid"), key).withColumn("_apart", F.abs(F.col(value) - F.col("mid")))
    return mid.join(quantiles(apart, [key], "_apart", {"away": 0.5}).drop("n"), key)


@_add
def quantile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return q.select("l_returnflag", "l_linestatus", "n", *_rounded(4, "p10", "p50", "p90"))


@_add
def group_median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spread(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice"), "l_suppkey", "l_extendedprice")
    return s.select("l_suppkey", "n", F.round("mid", 4).alias("med"), F.round(1.4826 * F.col("away"), 4).alias("mad"))


@_add
def lognormal_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 100).alias("seg"), F.log(F.greatest(F.col("l_quantity"), F.lit(3))).alias("y"))
    sigma = F.when(F.col("n") >= 3, F.round(1.4826 * F.col("away"), 6))
    return _spread(times, "seg", "y").select("seg", "n", F.round("mid", 6).alias("mu"), sigma.alias("sigma"))


@_add
def late_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins may overlap: errors are counted by lead and value first, and the counts go to each bin of the lead."""
    price = F.round("o_totalprice").cast("long")
    f = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 2700).alias("lead"), (price % 900 - 450).alias("err"))
    bounds = [("0-10", 0, 600), ("0-6", 0, 360), ("6-10", 360, 600), ("10-15", 600, 900), ("15-20", 900, 1200), ("20-30", 1200, 1800), ("30-45", 1800, 2700)]
    bins = F.array(*[F.when((F.col("lead") >= lo) & (F.col("lead") < hi), F.lit(name)) for name, lo, hi in bounds])
    counts = f.select("err", F.explode(F.array_compact(bins)).alias("bin")).groupBy("bin", "err").agg(F.count("*").alias("c"))
    late = counts.groupBy("bin").agg(F.coalesce(F.sum(F.when(F.col("err") > 0, F.col("c"))), F.lit(0)).alias("late"))
    q = quantiles(counts, ["bin"], "err", {"med": 0.5, "p90": 0.9}, weight="c")
    return q.join(late, "bin").select("bin", "n", "late", *_rounded(4, "med", "p90"))


@_add
def multi_level_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values are counted at the finest level; the counts stand for the rows in the four levels."""
    part = F.floor(F.col("t") / 21_600).cast("long") % 4
    fine = events(spark, sf_dir).groupBy((F.col("veh") % 10).alias("route"), F.col("stop").alias("seg"), part.alias("dp"), "value").agg(F.count("*").alias("c"))
    route, seg, dp = F.col("route"), F.col("seg"), F.col("dp")

    def level(i: int, r: Column | None = None, s: Column | None = None, d: Column | None = None) -> Column:
        fields = [(r, route, "bigint", "route"), (s, seg, "string", "seg"), (d, dp, "bigint", "dp")]
        return F.struct(F.lit(i).alias("level"), *[(c if c is not None else F.lit(None)).cast(kind).alias(name) for c, _, kind, name in fields])

    levels = F.array(level(0, r=route, d=dp), level(1, s=seg), level(2, s=seg, d=dp), level(3))
    rows = fine.select("value", "c", F.inline(levels))
    q = quantiles(rows, ["level", "route", "seg", "dp"], "value", {"med": 0.5}, weight="c")
    return q.select("route", "seg", "dp", "n", *_rounded(4, "med"))


@_add
def shrunk_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stop's median, drawn to its route's and that to the median of all; counts of stops serve the levels above."""
    err = F.col("l_extendedprice") - 1000 * F.col("l_quantity")
    fine = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("route"), F.col("l_suppkey").alias("stop"), err.alias("err")).agg(F.count("*").alias("c"))
    stops = quantiles(fine, ["route", "stop"], "err", {"m": 0.5}, weight="c")
    routes = quantiles(fine, ["route"], "err", {"rm": 0.5}, weight="c").withColumnRenamed("n", "rn")
    whole = quantiles(fine, [], "err", {"m0": 0.5}, weight="c").select("m0")

    def drawn(n: str, own: Column, above: Column) -> Column:
        return F.col(n) / (F.col(n) + 20.0) * own + 20.0 / (F.col(n) + 20.0) * above

    r = routes.join(whole, F.lit(True)).select("route", drawn("rn", F.col("rm"), F.col("m0")).alias("rm"))
    return stops.join(r, "route").select("route", "stop", "n", F.round(drawn("n", F.col("m"), F.col("rm")), 4).alias("bias"))


@_add
def pinball_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", F.col("l_extendedprice").alias("y"))
    learnt = quantiles(rows.where("l_linenumber % 2 = 1"), ["l_suppkey"], "y", {"lo": 0.1, "hi": 0.9}).drop("n")
    y, lo, hi = F.col("y"), F.col("lo"), F.col("hi")

    def loss(q: float, bound: Column) -> Column:
        return F.round(F.avg(F.greatest(q * (y - bound), (1 - q) * (bound - y))), 4)

    covered = F.round(F.avg(y.between(lo, hi).cast("double")), 4)
    tested = rows.where("l_linenumber % 2 = 0").join(learnt, "l_suppkey").groupBy("l_suppkey")
    return tested.agg(F.count("*").alias("n"), loss(0.1, lo).alias("pin10"), loss(0.9, hi).alias("pin90"), covered.alias("covered"))


@_add
def headways(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "stop", (F.col("veh") % 10).alias("line"), "t")
    before = running(e, ["stop", "line"], ["t", "event_id"], F.floor(F.col("t") / DAY), "max", F.col("t"), "before", inclusive=False)
    gaps = before.select("stop", (F.col("t") - F.col("before")).alias("gap"))
    found = gaps.groupBy("stop").agg(F.count("gap").alias("n"))
    return found.join(quantiles(gaps, ["stop"], "gap", {"headway": 0.5}).drop("n"), "stop", "left").select("stop", "n", *_rounded(1, "headway"))


@_add
def missing_slot_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = events(spark, sf_dir).select((F.col("veh") % 5).alias("line"), F.floor(F.col("t") / 600).cast("long").alias("slot")).distinct()
    n = running(slots, ["line"], ["slot"], F.floor(F.col("slot") / 1008), "max", F.col("slot"), "before", inclusive=False)
    missing = F.col("slot") - F.col("before") - 1
    return n.where(missing >= 2).select("line", (F.col("before") + 1).alias("first_slot"), missing.alias("missing"))


@_add
def interval_union_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = events(spark, sf_dir).select((F.col("veh") % 10).alias("line"), F.col("t").alias("a"), (F.col("t") + 900 + F.col("k")).alias("b"))
    u = interval_unions(x, ["line"], DAY)
    return u.groupBy("line").agg(F.count("*").alias("spans"), F.sum(F.col("b") - F.col("a")).alias("covered"), (F.max("b") - F.min("a")).alias("total"))


@_add
def rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = {"n": F.count("*"), "total": F.round(F.sum("value"), 6), "top": F.max("value")}
    g = events(spark, sf_dir).groupBy("veh").agg(*[(-m).alias(name) for name, m in measures.items()])
    places = [numbered(g.select("veh", name), [], name, "veh", "place").select("veh", "place") for name in measures]
    return places[0].union(places[1]).union(places[2]).groupBy("veh").agg(F.sum("place").alias("ranks"))


@_add
def trailing_30m_log_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of a line's log values in the half hour before each row, from a window that slides along the line."""
    rows = events(spark, sf_dir).select("event_id", (F.col("veh") % 20).alias("line"), "t", F.log(F.col("value") + 1).alias("y"))
    return trailing_median(rows, ["line"], "t", "y", "event_id", 1800, "mid").select("event_id", "n", *[F.round("mid", 6).alias("med")])


ORACLES = {name: STATEMENTS[name].oracle() for name in QUERIES}


@_add
def rolling_origin_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each week's median of all weeks before, from counts by week and value."""
    f = events(spark, sf_dir).select(F.floor(F.col("t") / 604_800).alias("wk"), "stop", "value")
    return expanding_median(f, ["stop"], "wk", "value", "bias").where("n >= 5").select("wk", "stop", "n", F.round("bias", 4).alias("bias"))


@_add
def numeric_aware_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of ids in natural order, as a running count over blocks of ids that begin alike."""
    name = F.when(F.col("veh") % 3 == 0, F.concat(F.lit("R"), F.col("veh").cast("string"))).otherwise(F.col("veh").cast("string"))
    x = events(spark, sf_dir).select(name.alias("id")).distinct()
    x = x.withColumns({"lettered": F.startswith("id", F.lit("R")).cast("int"), "number": F.when(F.startswith("id", F.lit("R")), F.lit(0)).otherwise(F.col("id").try_cast("long"))})
    digits = F.col("number").cast("string")
    block = F.struct("lettered", F.length(digits).alias("size"), F.substring(digits, 1, 2).alias("head"), F.when(F.col("lettered") == 1, F.substring("id", 1, 3)).alias("begin"))
    return running(x, [], ["lettered", "number", "id"], block, "sum", F.lit(1), "o").select("id", "o")
