"""Queries over operators/matching.py on the event log and the order tables, with SQL of other words for the oracle.

First-come choices (pairs, merged places) have no SQL; tests compare them with plain versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.operators import matching
from tramline.operators.joins import near
from tramline.operators.lineage import shared_folder
from tramline.plans.statements import LOG
from tramline.sources.tables import events, seconds, table
from tramline.streaming import detect

QUERIES, ORACLES = {}, {}


def _add(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {LOG}, {sql}"
        return f

    return put


@_add()
def paired_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each view paired with one click of the same user within six hours."""
    rows = events(spark, sf_dir).select("veh", "stop", "t", F.col("event_id").alias("id"))
    return matching.paired(rows.where("stop = 'view'"), rows.where("stop = 'click'"), ["veh"], 21_600)


_SHOWN = (
    "x AS (SELECT event_id, veh, stop, k, t // 40 AS t FROM e), "
    "s AS (SELECT veh, k % 3 AS trip, stop, k % 7 + 1 AS seq, t AS seen, t + 300 * (k % 5 + 2) AS until, t + 600 * (k % 9) AS pred FROM x), "
    "q AS (SELECT event_id AS id, veh, k % 3 AS trip, stop, t + 1800 AS arrival, t, lag(t, 4) OVER (PARTITION BY veh, stop ORDER BY t, event_id) AS visit FROM x)"
)


@_add(
    f"{_SHOWN} SELECT q.id, min(s.pred) AS pred FROM q JOIN s ON s.veh = q.veh AND s.stop = q.stop AND s.trip <> q.trip AND s.seen <= q.t AND q.t < s.until "
    "WHERE s.pred >= q.t - 30 AND abs(s.pred - q.arrival) < 3600 AND (q.visit IS NULL OR (s.seen > q.visit AND s.pred >= q.visit + 120)) "
    "AND NOT EXISTS (SELECT 1 FROM s y WHERE y.veh = q.veh AND y.trip = s.trip AND y.seen <= q.t AND q.t < y.until AND (y.seq = 1 OR (y.seq > s.seq AND y.pred < s.pred))) GROUP BY q.id"
)
def other_trip_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("t", F.expr("t div 40")).withColumn("trip", F.col("k") % 3)
    shown = rows.select(
        "veh", "trip", "stop", (F.col("k") % 7 + 1).alias("seq"), F.col("t").alias("seen"),
        (F.col("t") + 300 * (F.col("k") % 5 + 2)).alias("until"), (F.col("t") + 600 * (F.col("k") % 9)).alias("pred"),
    )
    visit = F.lag("t", 4).over(Window.partitionBy("veh", "stop").orderBy("t", "event_id"))
    asked = rows.select(F.col("event_id").alias("id"), "veh", "trip", "stop", (F.col("t") + 1800).alias("arrival"), "t", visit.alias("visit"))
    return matching.other_trip(asked, shown)


@_add(
    "a AS (SELECT veh, event_id, t // 6000 AS t, veh % 5 AS route, value / 10 AS x, k / 10 AS y, stop <> 'error' AS moving FROM e), "
    "f AS (SELECT *, t // 30 AS bin FROM a QUALIFY row_number() OVER (PARTITION BY veh, t // 30 ORDER BY t, event_id) = 1), "
    "m AS (SELECT p.veh, q.veh AS other, p.bin FROM f p JOIN f q ON p.bin = q.bin AND p.route = q.route AND p.veh < q.veh WHERE p.moving AND q.moving "
    "AND sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= 5), "
    "z AS (SELECT *, NOT EXISTS (SELECT 1 FROM m b WHERE b.veh = m.veh AND b.other = m.other AND b.bin IN (m.bin - 1, m.bin - 2)) AS starts FROM m), "
    "g AS (SELECT *, (SELECT count(*) FROM z b WHERE b.starts AND b.veh = z.veh AND b.other = z.other AND b.bin <= z.bin) AS g FROM z) "
    "SELECT veh, other, min(bin) * 30 AS a, (max(bin) + 1) * 30 AS b, count(*) AS bins FROM g GROUP BY veh, other, g HAVING count(*) >= 6"
)
def vehicles_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(
        "veh", F.col("event_id").alias("id"), F.expr("t div 6000").alias("t"), (F.col("veh") % 5).alias("route"), (F.col("value") / 10).alias("x"), (F.col("k") / 10).alias("y"), (F.col("stop") != "error").alias("moving")
    )
    return matching.side_by_side(rows, 5.0)


@_add(
    "a AS (SELECT veh, event_id, t // 120 AS t, veh % 2 AS route, value AS x, k, stop, row_number() OVER (PARTITION BY veh ORDER BY t // 120, event_id) AS i FROM e), "
    "r AS (SELECT veh, event_id, i, t, route, k, stop, t AS since, x AS x0 FROM a WHERE i = 1 UNION ALL "
    "SELECT a.veh, a.event_id, a.i, a.t, a.route, a.k, a.stop, CASE WHEN a.t - r.t <= 600 AND abs(a.x - r.x0) <= 20 THEN r.since ELSE a.t END, CASE WHEN a.t - r.t <= 600 AND abs(a.x - r.x0) <= 20 THEN r.x0 ELSE a.x END "
    "FROM r JOIN a ON a.veh = r.veh AND a.i = r.i + 1) "
    "SELECT event_id, since, CASE WHEN t - since < 180 THEN NULL WHEN t - since >= 5400 THEN 'parked' WHEN t - since >= 1800 AND k % 2 = 0 THEN 'idle' WHEN k < 10 THEN 'past' WHEN stop = 'error' THEN 'linger' END AS reason FROM r"
)
def idle_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("event_id").alias("id"), "veh", F.expr("t div 120").alias("t"), (F.col("veh") % 2).alias("route"), F.col("value").alias("x"), "k", "stop")
    out = matching.still_since(rows, 20.0, lambda a, b: abs(a[0] - b[0]), ["x"])
    reason = matching.hidden_reason(F.col("t") - F.col("since"), F.col("k") % 2 == 1, F.col("k") < 10, F.col("stop") == "error")
    return out.select(F.col("id").alias("event_id"), "since", reason.alias("reason"))


@_add(
    "p AS (SELECT veh AS feed, t // 1200 AS t, sum(CASE WHEN stop IN ('view', 'error') THEN 1 ELSE 0 END) AS n FROM e GROUP BY 1, 2) "
    "SELECT feed, t, CAST(n AS BIGINT) AS n, CASE WHEN n > 0 THEN t ELSE (SELECT max(b.t) FROM p b WHERE b.feed = p.feed AND b.t < p.t AND b.n > 0 AND b.t >= p.t - 30 "
    "AND NOT EXISTS (SELECT 1 FROM p c WHERE c.feed = p.feed AND c.t > b.t AND c.t < p.t)) END AS shown_t FROM p"
)
def empty_polls_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    polls = rows.groupBy(F.col("veh").alias("feed"), F.expr("t div 1200").alias("t")).agg(F.sum(F.col("stop").isin("view", "error").cast("long")).alias("n"))
    return matching.lists_held(polls, ["feed"])


@_add()
def merged_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation and segment as places of one name; account and key stand for metres."""
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.lit(" "), "c_nationkey").alias("name"), (F.col("c_custkey") % 3).alias("rank"), F.col("c_acctbal").alias("y"), (F.col("c_custkey") * 7 % 1000).cast("double").alias("x")
    )
    return matching.places_merged(rows, lambda a, b: ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5).select("id", "kept_id")


_LEGS = (
    "f AS (SELECT l_orderkey AS route, l_linenumber AS at, CAST(min(round(l_discount * 100)) AS BIGINT) AS walk, CAST(min(round(l_quantity)) AS BIGINT) AS wait, CAST(min(round(l_extendedprice / 1000)) AS BIGINT) AS ride FROM lineitem GROUP BY 1, 2), "
    "b AS (SELECT x.route, x.at AS board, y.at AS alight, x.walk + y.walk AS walk, x.wait, CAST(x.walk + x.wait + (SELECT sum(z.ride) FROM f z WHERE z.route = x.route AND z.at > x.at AND z.at <= y.at) + y.walk AS BIGINT) AS arr "
    "FROM f x JOIN f y ON x.route = y.route AND x.at < y.at)"
)


@_add(
    f"{_LEGS}, k AS (SELECT route, board, alight, arr, walk, wait, rank() OVER (PARTITION BY route ORDER BY arr, walk, board, alight) AS ra, rank() OVER (PARTITION BY route ORDER BY walk, arr, board, alight) AS rw, "
    "rank() OVER (PARTITION BY route ORDER BY wait, arr, board, alight) AS rt FROM b) SELECT route, board, alight, arr, walk, wait, CASE WHEN ra = 1 THEN 'arrival' WHEN rw = 1 THEN 'walk' ELSE 'wait' END AS best FROM k WHERE least(ra, rw, rt) = 1"
)
def direct_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per route the pairs of stops that are best by arrival, by walk and by wait; a pair best by several counts for the first."""
    along = Window.partitionBy("route").orderBy("at")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("at"))
    minutes = {"walk": F.col("l_discount") * 100, "wait": F.col("l_quantity"), "ride": F.col("l_extendedprice") / 1000}
    stops = rows.agg(*[F.min(F.round(m)).cast("long").alias(name) for name, m in minutes.items()])
    stops = stops.withColumn("upto", F.sum("ride").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    board = stops.select("route", F.col("at").alias("board"), F.col("walk").alias("walk_to"), "wait", F.col("upto").alias("upto_board"))
    alight = stops.select("route", F.col("at").alias("alight"), F.col("walk").alias("walk_from"), F.col("upto").alias("upto_alight"))
    walk = F.col("walk_to") + F.col("walk_from")
    arr = walk + F.col("wait") + F.col("upto_alight") - F.col("upto_board")
    trips = board.join(alight, "route").where("board < alight").select("route", "board", "alight", arr.alias("arr"), walk.alias("walk"), "wait")
    row = F.struct("board", "alight", "arr", "walk", "wait")
    best = trips.groupBy("route").agg(*[F.min_by(row, F.struct(*order)).alias(name) for name, order in (
        ("arrival", ["arr", "walk", "board", "alight"]), ("walk", ["walk", "arr", "board", "alight"]), ("wait", ["wait", "arr", "board", "alight"]),
    )])
    each = best.select("route", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("best"), F.col(n).alias("r")) for i, n in enumerate(("arrival", "walk", "wait"))])).alias("b"))
    return each.groupBy("route", "b.r").agg(F.min_by("b.best", "b.i").alias("best")).select("route", "r.*", "best")


@_add(
    "f AS (SELECT l_orderkey AS trip, l_suppkey AS seg, l_quantity AS plan, l_extendedprice / 1000 AS run FROM lineitem), "
    "m AS (SELECT seg, count(*) AS n, avg(run) AS mean, CASE WHEN count(*) > 1 THEN stddev_samp(run) END AS sd FROM f GROUP BY seg) "
    "SELECT trip, count(*) AS segments, round(sum((n * mean + 20 * plan) / (n + 20)), 3) AS ride, round(sqrt(sum(coalesce(sd * sd, 0))), 3) AS spread FROM f JOIN m USING (seg) GROUP BY trip"
)
def ride_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trip's time along its segments, each blended of timetable and learnt mean by n / (n + 20), and the root of its summed variances."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trip"), F.col("l_suppkey").alias("seg"), F.col("l_quantity").alias("plan"), (F.col("l_extendedprice") / 1000).alias("run"))
    model = rows.groupBy("seg").agg(F.count("*").alias("n"), F.avg("run").alias("mean"), F.var_samp("run").alias("var"))
    w = F.col("n") / (F.col("n") + 20)
    blended = w * F.col("mean") + (1 - w) * F.col("plan")
    out = rows.join(model, "seg").groupBy("trip").agg(F.count("*").alias("segments"), F.sum(blended).alias("ride"), F.sqrt(F.sum(F.coalesce("var", F.lit(0.0)))).alias("spread"))
    return out.select("trip", "segments", F.round("ride", 3).alias("ride"), F.round("spread", 3).alias("spread"))


@_add(
    "a AS (SELECT event_id, veh, t // 1200 AS t, veh % 2 AS route, value * 30 AS off, veh % 3 = 0 AS corridor, k % 10 = 0 AS detour FROM e), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY veh ORDER BY t) AS i FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY veh, t ORDER BY event_id) = 1)), "
    "l AS (SELECT x.*, y.off AS before, coalesce(y.route = x.route AND x.t - y.t <= 600, FALSE) AS linked FROM o x LEFT JOIN o y ON y.veh = x.veh AND y.i = x.i - 1), "
    "s AS (SELECT *, max(CASE WHEN off > 250 AND NOT (linked AND before > 250) THEN i END) OVER w AS f, max(CASE WHEN off > 500 AND NOT (linked AND before > 500) THEN i END) OVER w AS q, "
    "max(CASE WHEN off > 120 AND NOT (linked AND before > 120) THEN i END) OVER w AS n FROM l WINDOW w AS (PARTITION BY veh ORDER BY i)), "
    "h AS (SELECT s.veh, s.t, ((s.off > 250 AND s.i > s.f AND s.t - f.t >= 45) OR (s.off > 500 AND s.i > s.q) OR (s.corridor AND s.off > 120 AND s.i > s.n AND s.t - n.t >= 120)) AND NOT (s.detour AND s.off <= 3000) AS hidden "
    "FROM s LEFT JOIN o f ON f.veh = s.veh AND f.i = s.f LEFT JOIN o n ON n.veh = s.veh AND n.i = s.n) "
    "SELECT event_id, coalesce(hidden, FALSE) AS hidden FROM a JOIN h USING (veh, t)"
)
def off_route_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(
        F.col("event_id").alias("id"), "veh", F.expr("t div 1200").alias("t"), (F.col("veh") % 2).alias("route"), (F.col("value") * 30).alias("off"), (F.col("veh") % 3 == 0).alias("corridor"), (F.col("k") % 10 == 0).alias("detour")
    )
    return matching.off_route(rows).select(F.col("id").alias("event_id"), "hidden")


@_add(
    "s AS (SELECT stop AS feed, t // 1000 * 15 AS t, veh, min(k % 4) AS route FROM e GROUP BY 1, 2, 3), p AS (SELECT DISTINCT feed, t FROM s), "
    "g AS (SELECT s.*, (SELECT min(p.t) FROM p WHERE p.feed = s.feed AND p.t > s.t) AS gone, (SELECT min(b.t) FROM s b WHERE b.feed = s.feed AND b.veh = s.veh AND b.t > s.t) AS again FROM s), "
    "u AS (SELECT feed, t, route, veh FROM s UNION ALL SELECT p.feed, p.t, g.route, g.veh FROM p JOIN g ON p.feed = g.feed AND p.t BETWEEN g.gone AND g.gone + 45 AND (g.again IS NULL OR p.t < g.again)) "
    "SELECT feed, t, route, veh, rank() OVER (PARTITION BY feed, t, route ORDER BY veh) AS number FROM u"
)
def held_bus_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("stop").alias("feed"), F.expr("t div 1000 * 15").alias("t"), "veh", (F.col("k") % 4).alias("route"))
    return matching.held_numbers(rows)


@_add(
    "a AS (SELECT event_id, veh, stop, t, abs(value - 10) AS away FROM e), "
    "g AS (SELECT *, sum(CASE WHEN t - p <= 43200 THEN 0 ELSE 1 END) OVER (PARTITION BY veh, stop ORDER BY t, event_id) AS v FROM (SELECT *, lag(t) OVER (PARTITION BY veh, stop ORDER BY t, event_id) AS p FROM a)) "
    "SELECT event_id, veh, stop, t, away FROM g QUALIFY row_number() OVER (PARTITION BY veh, stop, v ORDER BY away, t, event_id) = 1"
)
def closest_approaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("event_id").alias("id"), "veh", "stop", "t", F.abs(F.col("value") - 10).alias("away"))
    return matching.closest_rows(rows, ["veh", "stop"], 43_200).select(F.col("id").alias("event_id"), "veh", "stop", "t", "away")


@_add("SELECT event_id FROM e g WHERE stop = 'view' AND NOT EXISTS (SELECT 1 FROM e r WHERE r.stop = 'click' AND r.veh = g.veh AND r.t BETWEEN g.t - 36000 AND g.t + 36000)")
def sweep_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swept rows that no row found by rule, of the same vehicle, lies near: what the sweep adds once its hold is over."""
    rows = events(spark, sf_dir)
    return near(rows.where("stop = 'view'"), rows.where("stop = 'click'"), ["veh"], "t", 36_000, 36_000, "anti").select("event_id")


@_add(
    "f AS (SELECT p_partkey AS id, p_name, p_partkey % 15 AS i, p_retailprice / 20 AS km, CASE p_size % 5 WHEN 0 THEN 'major' WHEN 1 THEN 'minor' ELSE 'other' END AS kind, p_size % 2 = 0 AS town FROM part), "
    "w AS (SELECT *, [w FOR w IN regexp_split_to_array(lower(p_name), '[^a-z0-9]+') IF w <> ''] AS words FROM f) "
    "SELECT id, round(CASE WHEN town AND array_to_string(words, ' ') = 'red widget' THEN -100 ELSE i + 8 * ((km > 3)::INT + (km > 20)::INT + (km > 80)::INT) + least(km, 20) / 5 "
    "+ least(3, len([w FOR w IN words IF NOT (starts_with(w, 'red') OR starts_with(w, 'widget'))])) + CASE kind WHEN 'major' THEN -2 WHEN 'minor' THEN 3 ELSE 0 END END, 4) AS score FROM w"
)
def places_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as places found for `red widget`."""
    size = F.col("p_size") % 5
    kind = F.when(size == 0, "major").when(size == 1, "minor").otherwise("other")
    score = matching.place_score(F.col("p_partkey") % 15, F.col("p_name"), kind, F.col("p_retailprice") / 20, F.col("p_size") % 2 == 0, ["red", "widget"])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(score, 4).alias("score"))


@_add(
    "l AS (SELECT event_id AS id, t, veh, k FROM e WHERE stop = 'view'), a AS (SELECT event_id AS id, t, veh FROM e WHERE stop = 'click'), "
    "s AS (SELECT * FROM l WHERE k >= 50 OR EXISTS (SELECT 1 FROM a WHERE a.veh = l.veh AND abs(a.t - l.t) <= 7200)) "
    "SELECT id, t, veh, 'live' AS source FROM s UNION ALL SELECT id, t, veh, 'replay' FROM a WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.veh = a.veh AND abs(a.t - s.t) <= 7200)"
)
def replay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("event_id").alias("id"), "t", "veh", "stop", "k")
    live = rows.where("stop = 'view'")
    return matching.replay_applied(live, rows.where("stop = 'click'"), live.where("k < 50").select("id"), ["veh"], 7200)


@_add("SELECT veh AS alert, sha256(CAST(k % 5 AS VARCHAR)) AS version, min(t) AS first_seen, max(t) AS last_seen, count(*) AS polls FROM e GROUP BY 1, 2")
def stream_alert_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of alerts, by content, over the stored log as a stream."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 8).parquet(sf_dir)
    content = F.get_json_object("props", "$.k").cast("int") % 5
    reports = source.select(F.col("user_id").alias("alert"), F.sha2(content.cast("string"), 256).alias("version"), seconds(F.col("ts")).alias("t"))
    return detect.versions_seen(spark, reports, shared_folder(spark))
