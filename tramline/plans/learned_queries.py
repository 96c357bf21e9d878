"""Queries over operators/learned.py, with SQL of other words for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators import learned
from tramline.plans.statements import LOG
from tramline.sources.tables import events, table

QUERIES, ORACLES = {}, {}


def _add(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH {LOG}, {sql}"
        return f

    return put


@_add(
    "a AS (SELECT veh, veh % 2 AS route, t // 86400 AS day, t // 1000 AS t, value * 10 AS x, k * 4.0::DOUBLE AS y, k AS off, stop <> 'error' AS ok, row_number() OVER (PARTITION BY veh ORDER BY t // 1000, event_id) AS i FROM e), "
    "s AS (SELECT b.route, b.veh, b.day, p.t // 900 AS slot, p.x AS x0, p.y AS y0, b.x - p.x AS dx, b.y - p.y AS dy, sqrt((b.x - p.x) * (b.x - p.x) + (b.y - p.y) * (b.y - p.y)) AS far "
    "FROM a b JOIN a p ON p.veh = b.veh AND p.i = b.i - 1 WHERE b.ok AND p.ok AND b.t - p.t <= 40 AND (b.off > 40 OR p.off > 40)), "
    "q AS (SELECT *, greatest(1, CAST(floor(far / 10) AS BIGINT)) AS n FROM s WHERE far <= 400), "
    "c AS (SELECT DISTINCT route, CAST(floor((x0 + dx * i / n) / 25) AS BIGINT) AS cx, CAST(floor((y0 + dy * i / n) / 25) AS BIGINT) AS cy, veh, day, slot FROM (SELECT *, unnest(generate_series(0, n)) AS i FROM q)), "
    "o AS (SELECT DISTINCT route, cx, cy FROM c), d AS (SELECT route, count(DISTINCT day) AS nd FROM a WHERE ok GROUP BY route), "
    "u AS (SELECT o.route, o.cx, o.cy, count(DISTINCT c.day) AS days, count(DISTINCT (c.veh, c.day, c.slot)) AS passes FROM o JOIN c ON c.route = o.route AND c.cx IN (o.cx - 1, o.cx, o.cx + 1) AND c.cy IN (o.cy - 1, o.cy, o.cy + 1) GROUP BY ALL) "
    "SELECT route, cx, cy, days, passes FROM u JOIN d USING (route) WHERE nd >= 5 AND days >= 5 AND 3 * days >= 2 * nd AND passes >= 0.05 * nd * 40"
)
def corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(
        F.col("event_id").alias("id"), "veh", (F.col("veh") % 2).alias("route"), F.expr("t div 86400").alias("day"), F.expr("t div 1000").alias("t"), (F.col("value") * 10).alias("x"), (F.col("k") * 4.0).alias("y"), F.col("k").alias("off"), (F.col("stop") != "error").alias("ok")
    )
    return learned.corridor_cells(rows, rows.groupBy("route").agg(F.lit(40).alias("laps")))


@_add(
    "r AS (SELECT l_suppkey AS route, 3.5 + l_tax AS mu, 0.2 + l_discount AS sigma, l_linenumber AS dwell, l_extendedprice / 1000 + 1 AS y FROM lineitem), "
    "c AS (SELECT route, CASE WHEN y > dwell THEN abs(ln(y - dwell) - mu) / (1.2815515655446008 * sigma) ELSE 1e9 END AS c FROM r), "
    "n AS (SELECT route, c, row_number() OVER (PARTITION BY route ORDER BY c) AS i, count(*) OVER (PARTITION BY route) AS n FROM c) "
    "SELECT route, n, round(least(greatest(c, 0.3), 6.0), 4) AS scale FROM n WHERE i = (4 * n + 4) // 5"
)
def interval_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("route"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("id"), (3.5 + F.col("l_tax")).alias("mu"), (0.2 + F.col("l_discount")).alias("sigma"), F.col("l_linenumber").alias("dwell"), (F.col("l_extendedprice") / 1000 + 1).alias("y")
    )
    return learned.interval_scale(rows, ["route"]).select("route", "n", F.round("scale", 4).alias("scale"))


@_add(
    "l AS (SELECT c_custkey AS id, c_mktsegment || (c_custkey % 400) AS label, c_acctbal AS x, c_nationkey * 10 AS y, c_custkey % 3 = 0 AS hides FROM customer) "
    "SELECT a.id, b.id AS other, 'near' AS kind FROM l a JOIN l b ON a.id < b.id AND NOT a.hides AND NOT b.hides AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 225 "
    "UNION ALL SELECT id, first, 'name' FROM (SELECT id, min(id) OVER (PARTITION BY lower(label)) AS first FROM l) WHERE id > first"
)
def labels_in_the_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        key.alias("id"), F.concat("c_mktsegment", (key % 400).cast("string")).alias("label"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 10).alias("y"), F.when(key % 3 == 0, 15).alias("until")
    )
    return learned.label_clashes(rows)
