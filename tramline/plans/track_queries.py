"""Queries over vehicle tracks: each operator of operators/tracks.py on the event log, with SQL of other words for the oracle.

The log's clock is divided so that its vehicles report about as often as buses do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.operators import tracks
from tramline.plans.statements import LOG
from tramline.sources.tables import events

QUERIES, ORACLES = {}, {}


def _add(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH {LOG}, {sql}"
        return f

    return put


def _fast(spark: SparkSession, sf_dir: str, div: int) -> DataFrame:
    return events(spark, sf_dir).withColumn("t", F.expr(f"t div {div}"))


@_add(
    "a AS (SELECT event_id AS id, veh, stop, t // 20 AS t, 200 + 40 * k AS dist, CASE WHEN k % 3 = 0 THEN value / 10 END AS speed, CASE WHEN k % 2 = 0 THEN k END AS dwell FROM e), "
    "b AS (SELECT *, lag(stop) OVER w AS ps, lag(t) OVER w AS pt FROM a WINDOW w AS (PARTITION BY veh ORDER BY t, id)), "
    "c AS (SELECT b.*, (SELECT x.dwell FROM a x WHERE x.veh = b.veh AND x.stop = b.ps AND x.t = b.pt AND x.dwell IS NOT NULL ORDER BY x.id DESC LIMIT 1) AS pd FROM b), "
    "d AS (SELECT *, t - pt AS seg, CASE WHEN pd >= 0 AND pd < t - pt THEN pd WHEN speed > 0 THEN greatest(0, t - pt - dist / speed) ELSE 0 END AS stood FROM c WHERE t > pt AND t - pt <= 1800) "
    "SELECT id AS event_id, seg, round(seg - stood, 4) AS run, round(dist / (seg - stood), 4) AS pace FROM d WHERE seg - stood >= 3 AND dist / (seg - stood) <= CASE WHEN dist < 2000 THEN 20 ELSE 30 END"
)
def usable_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("trip").orderBy("t", "id")
    rows = _fast(spark, sf_dir, 20).select(
        F.col("event_id").alias("id"), F.col("veh").alias("trip"), "stop", "t", (200 + 40 * F.col("k")).alias("dist"),
        F.when(F.col("k") % 3 == 0, F.col("value") / 10).alias("speed"), F.when(F.col("k") % 2 == 0, F.col("k")).alias("dwell"),
    ).withColumns({"prev_stop": F.lag("stop").over(w), "prev_t": F.lag("t").over(w)})
    out = tracks.segments(tracks.previous_dwell(rows))
    return out.select(F.col("id").alias("event_id"), "seg", F.round("run", 4).alias("run"), F.round("pace", 4).alias("pace"))


@_add(
    "a AS (SELECT event_id, veh, t, lag(t) OVER (PARTITION BY veh, stop ORDER BY t, event_id) AS p FROM e) "
    "SELECT event_id, CASE WHEN p IS NOT NULL THEN (SELECT count(*) FROM e b WHERE b.veh = a.veh AND b.t > a.p AND b.t < a.t) END AS passed FROM a"
)
def stale_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("event_id").alias("id"), "veh", "t", F.lag("t").over(Window.partitionBy("veh", "stop").orderBy("t", "event_id")).alias("prev_t"))
    return tracks.stale_links(rows).select(F.col("id").alias("event_id"), F.col("between").alias("passed"))


def _exists(key: str, before: int, after: int, div: int) -> str:
    return (
        f"a AS (SELECT event_id, veh, {key} AS key, t // {div} AS t FROM e) SELECT event_id, EXISTS (SELECT 1 FROM a b WHERE b.key = a.key AND b.veh <> a.veh "
        f"AND b.t BETWEEN a.t - {before} AND a.t + {after}) AS near FROM a"
    )


@_add(_exists("veh % 40", tracks.SHARED_TRIP_S, tracks.SHARED_TRIP_S, 20))
def shared_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fast(spark, sf_dir, 20).withColumn("trip", F.col("veh") % 40)
    return tracks.another_near(rows, ["trip"], tracks.SHARED_TRIP_S, tracks.SHARED_TRIP_S).select("event_id", "near")


@_add(_exists("stop || (veh % 20)", tracks.BUNCH_S, tracks.BUNCH_S, 100))
def bunched_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fast(spark, sf_dir, 100).withColumn("route", F.col("veh") % 20)
    return tracks.another_near(rows, ["route", "stop"], tracks.BUNCH_S, tracks.BUNCH_S).select("event_id", "near")


@_add(
    "a AS (SELECT veh, event_id, t // 120 AS t, k // 50 AS place, value / 20 AS speed, lead(k // 50) OVER w AS np, lead(t // 120) OVER w AS nt, lag(k // 50) OVER w AS pp, lag(t // 120) OVER w AS pt "
    "FROM e WINDOW w AS (PARTITION BY veh ORDER BY t // 120, event_id)), "
    "s AS (SELECT veh, event_id, t, row_number() OVER (PARTITION BY veh ORDER BY t, event_id) AS i FROM a WHERE pp IS NULL OR pp <> place OR t - pt > 600), "
    "z AS (SELECT veh, event_id, t, row_number() OVER (PARTITION BY veh ORDER BY t, event_id) AS i FROM a WHERE np IS NULL OR np <> place OR nt - t > 600), "
    "r AS (SELECT veh, s.t AS a, z.t AS b, s.event_id AS first_id, z.event_id AS last_id FROM s JOIN z USING (veh, i)) "
    "SELECT r.veh, r.a, r.b, count(*) AS n FROM r JOIN a ON a.veh = r.veh AND (a.t, a.event_id) >= (r.a, first_id) AND (a.t, a.event_id) <= (r.b, last_id) "
    "WHERE r.b - r.a >= 300 GROUP BY r.veh, r.a, r.b, first_id HAVING count(*) >= 5 AND max(speed) >= 3"
)
def frozen_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fast(spark, sf_dir, 120).select(F.col("event_id").alias("id"), "veh", "t", F.expr("k div 50").alias("lat"), F.lit(0.0).alias("lon"), (F.col("value") / 20).alias("speed"))
    return tracks.frozen_runs(rows)


@_add(
    "a AS (SELECT veh, event_id, t // 60 AS t, abs(value - lag(value) OVER w) * 100 AS far, t // 60 - lag(t // 60) OVER w AS took FROM e WINDOW w AS (PARTITION BY veh ORDER BY t // 60, event_id)), "
    "h AS (SELECT * FROM a WHERE far >= 500 AND took > 0 AND far / took > 35), "
    "s AS (SELECT *, NOT EXISTS (SELECT 1 FROM h b WHERE b.veh = h.veh AND (b.t, b.event_id) < (h.t, h.event_id) AND b.t >= h.t - 300) AS starts FROM h), "
    "g AS (SELECT *, (SELECT count(*) FROM s b WHERE b.starts AND b.veh = s.veh AND (b.t, b.event_id) <= (s.t, s.event_id)) AS g FROM s) "
    "SELECT veh, min(t) AS a, max(t) AS b, count(*) AS n, round(max(far), 4) AS far FROM g GROUP BY veh, g"
)
def position_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fast(spark, sf_dir, 60).select(F.col("event_id").alias("id"), "veh", "t", "value")
    # Scaled after the difference: values a step of exactly JUMP_M apart would differ in the last bit otherwise.
    return tracks.jumps(rows, lambda r, l: F.abs(r["value"] - l["value"]) * 100).select("veh", "a", "b", "n", F.round("far", 4).alias("far"))


@_add(
    "a AS (SELECT DISTINCT veh, t FROM e) SELECT veh, max(b.t) AS a, x.t AS b FROM a x JOIN a b USING (veh) WHERE b.t < x.t GROUP BY veh, x.t HAVING x.t - max(b.t) >= 28800"
)
def feed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.silent(events(spark, sf_dir), ["veh"], "t", 28_800)


@_add(
    "a AS (SELECT event_id, veh, t // 3600 AS p, row_number() OVER (PARTITION BY veh ORDER BY t, event_id) AS i FROM e) "
    "SELECT a.event_id, CASE WHEN a.p - b.p BETWEEN 0 AND 3 THEN 'filler' WHEN c.p - a.p BETWEEN 0 AND 3 THEN 'head' ELSE 'normal' END AS kind "
    "FROM a LEFT JOIN a b ON b.veh = a.veh AND b.i = a.i - 1 LEFT JOIN a c ON c.veh = a.veh AND c.i = a.i + 1"
)
def filler_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "veh", F.struct("t", "event_id").alias("seq"), F.expr("t div 3600").alias("predicted"))
    return tracks.fillers(rows, ["veh"]).select("event_id", "kind")


@_add(
    "s AS (SELECT DISTINCT stop AS route, veh, t // 144 AS t FROM e), m AS (SELECT max(t) AS top FROM s), "
    "n AS (SELECT s.*, (SELECT min(x.t) FROM s x WHERE x.route = s.route AND x.veh = s.veh AND x.t > s.t) AS nxt, top FROM s, m), "
    "d AS (SELECT * FROM n WHERE coalesce(nxt, top) >= t + 600), "
    "o AS (SELECT d.route, d.veh, d.t, count(DISTINCT x.veh) AS others FROM d JOIN s x ON x.route = d.route AND x.veh <> d.veh AND x.t > d.t AND x.t <= d.t + 600 GROUP BY d.route, d.veh, d.t) "
    "SELECT route, veh, t, others + 1 AS before, others AS after, CASE WHEN nxt < t + 1800 THEN 0 WHEN nxt >= t + 1800 OR top >= t + 1800 THEN 1 END AS lasting, nxt - t AS returned_s FROM d JOIN o USING (route, veh, t)"
)
def fleet_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fast(spark, sf_dir, 144).select(F.col("stop").alias("route"), "veh", "t")
    return tracks.drops(rows, rows.agg(F.max("t")).scalar())
