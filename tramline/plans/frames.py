"""Queries built from the operators of this package, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.functions.scalars import ZONE, daypart, hour_of_week, local, metres, service_day
from tramline.functions.spelling import spelling
from tramline.operators import geometry
from tramline.operators.bootstrap import day_shares
from tramline.operators.cuts import running
from tramline.operators.joins import asof, near, on_display, overlaps, shown_to_bus
from tramline.operators.lineage import shared_folder
from tramline.operators.sequences import anchored, chained, decayed, interval_unions, ranked_merge, smoothed
from tramline.plans.statements import LOG
from tramline.sources.tables import events, seconds, table
from tramline.streaming import detect

Query = Callable[[SparkSession, str], DataFrame]
FRAMES: dict[str, tuple[Query, str | None]] = {}

AGE, HORIZON, TOLERANCE = 86_400, 43_200, 3_600


def _add(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the function's query; the SQL may use the event log as `e`."""

    def put(f: Query) -> Query:
        FRAMES[f.__name__] = (f, sql and f"WITH RECURSIVE {LOG}, {sql}")
        return f

    return put


def _of(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("stop") == kind).drop("stop")


_SIDES = (
    "p AS (SELECT event_id, veh, t FROM e WHERE stop = 'purchase'), v AS (SELECT event_id AS vid, veh, t AS v_at, value AS seen FROM e WHERE stop = 'view'), "
)


@_add(
    _SIDES + "j AS (SELECT p.event_id, p.t, v_at, seen, row_number() OVER (PARTITION BY p.event_id ORDER BY v_at DESC, vid DESC) AS o FROM p LEFT JOIN v ON p.veh = v.veh AND v_at <= p.t) "
    f"SELECT event_id, CASE WHEN t - v_at <= {AGE} THEN v_at END AS \"at\", CASE WHEN t - v_at <= {AGE} THEN seen END AS seen FROM j WHERE o = 1"
)
def asof_backward_maxage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    views = _of(e, "view").withColumnRenamed("value", "seen")
    return asof(_of(e, "purchase").select("event_id", "veh", "t"), views, ["veh"], "t", "event_id", ["seen"], max_age=AGE).select("event_id", "at", "seen")


@_add(
    _SIDES + "j AS (SELECT vid, v_at, p.event_id, p.t, row_number() OVER (PARTITION BY vid ORDER BY p.t, p.event_id) AS o FROM v LEFT JOIN p ON p.veh = v.veh AND p.t >= v_at) "
    f"SELECT vid AS event_id, CASE WHEN t - v_at <= {HORIZON} THEN t END AS next_purchase FROM j WHERE o = 1"
)
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    found = asof(_of(e, "view").select("event_id", "veh", "t"), _of(e, "purchase"), ["veh"], "t", "event_id", [], forward=True, max_age=HORIZON)
    return found.select("event_id", F.col("at").alias("next_purchase"))


@_add(
    _SIDES + "j AS (SELECT p.event_id, v_at, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.t - v_at), v_at) AS o "
    f"FROM p JOIN v ON p.veh = v.veh AND abs(p.t - v_at) <= {HORIZON}) SELECT event_id, v_at AS \"at\" FROM j WHERE o = 1"
)
def nearest_either_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    left, views = _of(e, "purchase").select("event_id", "veh", "t"), _of(e, "view")
    before = asof(left, views, ["veh"], "t", "event_id", [], max_age=HORIZON).withColumnRenamed("at", "before")
    both = asof(before, views, ["veh"], "t", "event_id", [], forward=True, max_age=HORIZON)
    later = F.col("before").isNull() | (F.col("at") - F.col("t") < F.col("t") - F.col("before"))
    return both.select("event_id", F.when(F.col("at").isNotNull() & later, F.col("at")).otherwise(F.col("before")).alias("at")).where("at IS NOT NULL")


@_add(
    _SIDES + f"j AS (SELECT vid, p.t - v_at AS lead FROM v JOIN p ON p.veh = v.veh AND p.t > v_at AND p.t <= v_at + {HORIZON}) "
    "SELECT vid AS event_id, count(*) AS n, min(lead) AS first_lead, max(lead) AS last_lead FROM j GROUP BY vid"
)
def horizon_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    pairs = near(_of(e, "view").select("event_id", "veh", "t"), _of(e, "purchase").select("event_id", "veh", "t"), ["veh"], "t", -1, HORIZON)
    lead = F.col("r_t") - F.col("t")
    return pairs.groupBy("event_id").agg(F.count("*").alias("n"), F.min(lead).alias("first_lead"), F.max(lead).alias("last_lead"))


@_add(_SIDES + f"j AS (SELECT DISTINCT event_id FROM p JOIN v ON p.veh = v.veh AND abs(p.t - v_at) <= {TOLERANCE}) SELECT event_id FROM j")
def tolerance_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return near(_of(e, "purchase").select("event_id", "veh", "t"), _of(e, "view"), ["veh"], "t", TOLERANCE, TOLERANCE, "left_semi").select("event_id")


@_add(
    _SIDES + f"j AS (SELECT event_id FROM p WHERE NOT EXISTS (SELECT 1 FROM v WHERE p.veh = v.veh AND abs(p.t - v_at) <= {TOLERANCE})) SELECT event_id FROM j"
)
def tolerance_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return near(_of(e, "purchase").select("event_id", "veh", "t"), _of(e, "view"), ["veh"], "t", TOLERANCE, TOLERANCE, "left_anti").select("event_id")


@_add(
    "s AS (SELECT event_id AS sid, veh, t AS seen, t + 1000 * k AS last FROM e WHERE stop = 'view'), q AS (SELECT event_id, veh, t FROM e WHERE stop = 'purchase'), "
    "j AS (SELECT q.event_id, t, seen, last, row_number() OVER (PARTITION BY q.event_id ORDER BY seen DESC, sid DESC) AS o FROM q LEFT JOIN s ON q.veh = s.veh AND seen <= t) "
    "SELECT event_id, CASE WHEN last >= t - 90 THEN seen END AS seen, CASE WHEN last >= t - 90 THEN last END AS last FROM j WHERE o = 1"
)
def shown_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    shown = _of(e, "view").select("event_id", "veh", F.col("t").alias("seen"), (F.col("t") + 1000 * F.col("k")).alias("last"))
    return on_display(_of(e, "purchase").select("event_id", "veh", "t"), shown, ["veh"], "t", 90).select("event_id", "seen", "last")


@_add(
    "s AS (SELECT event_id AS sid, veh % 40 AS trip, CASE WHEN k % 3 > 0 THEN veh END AS veh, t // 100 AS seen, t // 100 + 10 * k AS last FROM e WHERE stop = 'view'), "
    "q AS (SELECT event_id, veh % 40 AS trip, veh, t // 100 AS t FROM e WHERE stop = 'purchase'), "
    "o AS (SELECT q.*, EXISTS (SELECT 1 FROM q x WHERE x.trip = q.trip AND x.veh <> q.veh AND abs(x.t - q.t) <= 600) AS shared FROM q), "
    "j AS (SELECT o.event_id, t, seen, last, row_number() OVER (PARTITION BY o.event_id ORDER BY seen DESC, s.veh IS NULL, sid DESC) AS o FROM o LEFT JOIN s ON o.trip = s.trip AND seen <= t AND (s.veh = o.veh OR (s.veh IS NULL AND NOT shared))) "
    "SELECT event_id, CASE WHEN last >= t - 90 THEN seen END AS seen, CASE WHEN last >= t - 90 THEN last END AS last FROM j WHERE o = 1"
)
def shown_without_vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumns({"trip": F.col("veh") % 40, "t": F.expr("t div 100")})
    shown = _of(e, "view").select("event_id", "trip", F.when(F.col("k") % 3 > 0, F.col("veh")).alias("veh"), F.col("t").alias("seen"), (F.col("t") + 10 * F.col("k")).alias("last"))
    return shown_to_bus(_of(e, "purchase").select("event_id", "trip", "veh", "t"), shown, ["trip"], "t", 90).select("event_id", "seen", "last")


@_add(
    "x AS (SELECT event_id, veh % 10 AS line, t AS a, t + 60 * k AS b FROM e WHERE stop = 'view' AND k > 0), y AS (SELECT event_id AS rid, veh % 10 AS line, t AS ra, t + 30 * k AS rb FROM e WHERE stop = 'error' AND k > 0) "
    "SELECT event_id, rid, least(b, rb) - greatest(a, ra) AS shared FROM x JOIN y ON x.line = y.line AND a < rb AND ra < b"
)
def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("line", F.col("veh") % 10)
    x = _of(e, "view").select("event_id", "line", F.col("t").alias("a"), (F.col("t") + 60 * F.col("k")).alias("b"))
    y = _of(e, "error").select(F.col("event_id").alias("rid"), "line", F.col("t").alias("ra"), (F.col("t") + 30 * F.col("k")).alias("rb"))
    shared = F.least("b", "rb") - F.greatest("a", "ra")
    return overlaps(x, y, ["line"], 3600).select("event_id", "rid", shared.alias("shared"))


@_add(
    "s AS (SELECT veh, stop, min(t) AS t FROM e GROUP BY veh, stop), "
    "r AS (SELECT veh, stop, t FROM s UNION ALL (SELECT r.veh, r.stop, min(e.t) FROM r JOIN e ON e.veh = r.veh AND e.stop = r.stop AND e.t > r.t + 86400 GROUP BY r.veh, r.stop, r.t)) "
    "SELECT min(event_id) AS event_id FROM r JOIN e USING (veh, stop, t) GROUP BY veh, stop, t"
)
def anchored_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchored(events(spark, sf_dir), ["veh", "stop"], "t", 86_400, "event_id").select("event_id")


@_add(
    "s AS (SELECT event_id, t - lag(t) OVER (PARTITION BY veh, stop ORDER BY t, event_id) AS gap FROM e) SELECT event_id FROM s WHERE gap IS NULL OR gap > 86400"
)
def chained_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chained(events(spark, sf_dir), ["veh", "stop"], "t", 86_400, "event_id").where("NOT repeat").select("event_id")


@_add()
def first_hit_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "veh", "stop", "t", (F.col("k") % 3).alias("rank"))
    return ranked_merge(rows, ["veh", "stop"], 86_400).select("event_id")


@_add(
    "x AS (SELECT veh, t AS a, t + 60 * k AS b FROM e), m AS (SELECT *, max(b) OVER (PARTITION BY veh ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x), "
    "g AS (SELECT *, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY veh ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM m) SELECT veh, min(a) AS a, max(b) AS b FROM g GROUP BY veh, i"
)
def span_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("veh", F.col("t").alias("a"), (F.col("t") + 60 * F.col("k")).alias("b"))
    return interval_unions(rows, ["veh"]).select("veh", "a", "b")


@_add()
def decayed_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "veh", "t", "value")
    return decayed(rows, ["veh"], 86_400.0).select("event_id", F.round("level", 6).alias("level"))


@_add()
def kalman_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "veh", ((F.col("t") - 1704067200) / 3600).alias("t"), "value")
    return smoothed(rows, ["veh"]).select("event_id", F.round("estimate", 4).alias("estimate"), "rejected")


_WALL = f"w AS (SELECT event_id, timezone('{ZONE}', timezone('UTC', make_timestamp(t * 1000000))) AS wall FROM e) "


@_add(
    _WALL + "SELECT event_id, CAST(CAST(wall - INTERVAL 4 HOUR AS DATE) AS VARCHAR) AS day, CAST((isodow(wall) - 1) * 24 + hour(wall) AS INTEGER) AS how, "
    "CAST(CASE WHEN hour(wall) < 6 THEN 0 WHEN hour(wall) < 10 THEN 1 WHEN hour(wall) < 15 THEN 2 WHEN hour(wall) < 19 THEN 3 ELSE 4 END + CASE WHEN isodow(wall) > 5 THEN 5 ELSE 0 END AS INTEGER) AS part FROM w"
)
def local_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", local(F.col("t")).alias("wall"))
    wall = F.col("wall")
    return rows.select("event_id", service_day(wall).cast("string").alias("day"), hour_of_week(wall).alias("how"), daypart(wall).alias("part"))


_NATION_AT = "n AS (SELECT n_nationkey AS id, 41.7 + 0.01 * n_nationkey AS lat, -87.6 - 0.02 * n_regionkey AS lon FROM nation)"
_METRES = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2))))"


@_add(
    f"{_NATION_AT}, d AS (SELECT p.id AS id, q.id AS other, {_METRES} AS m FROM n p JOIN n q ON p.id <> q.id), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, other) AS r FROM d) SELECT id, other, CAST(r AS INTEGER) AS r, round(m, 3) AS m FROM o WHERE r <= 3"
)
def nearest_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest stops of each stop on the globe; those that may be are found on a plane, over a pyramid of cells."""
    at = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"), (41.7 + F.lit(0.01) * F.col("n_nationkey")).alias("lat"), (-87.6 - F.lit(0.02) * F.col("n_regionkey")).alias("lon")
    )
    x, y = geometry.flat(F.col("lat"), F.col("lon"), 41.8)
    places = at.withColumns({"x": x, "y": y})
    m = metres(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon"))
    return geometry.nearest(places, places, 3, self_=True, first=500.0, measure=m).select("id", "other", "r", F.round("m", 3).alias("m"))


@_add(
    "f AS (SELECT o_orderkey AS pattern, o_custkey % 8 AS route, (o_orderkey % 20) * 3600 AS first, (o_orderkey % 20) * 3600 + 7200 + (o_custkey % 3) * 3600 AS until, 600 + (o_custkey % 4) * 300 AS headway FROM orders), "
    "d AS (SELECT pattern, route, unnest(range(first, until, headway)) AS dep FROM f) SELECT pattern, route, dep, row_number() OVER (PARTITION BY pattern ORDER BY dep) AS trip FROM d"
)
def timetable_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departures of headway-run patterns, first inclusive and end exclusive; hours may pass 24."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    f = table(spark, sf_dir, "orders").select(key.alias("pattern"), (cust % 8).alias("route"), (key % 20 * 3600).alias("first"), (key % 20 * 3600 + 7200 + cust % 3 * 3600).alias("until"), (600 + cust % 4 * 300).alias("headway"))
    deps = f.select("pattern", "route", F.posexplode(F.sequence("first", F.col("until") - 1, "headway")).alias("i", "dep"))
    return deps.select("pattern", "route", "dep", (F.col("i") + 1).cast("long").alias("trip"))


@_add(
    "x AS (SELECT veh % 10 AS line, t AS a, t + 60 * k + 1 AS b FROM e), u AS (SELECT line, a AS t, 1 AS d FROM x UNION ALL SELECT line, b, -1 FROM x), "
    "g AS (SELECT line, t, sum(d) AS d FROM u GROUP BY line, t), s AS (SELECT line, t, sum(d) OVER (PARTITION BY line ORDER BY t) AS n FROM g) "
    "SELECT line, CAST(floor(t / 3600) AS BIGINT) AS hour, CAST(max(n) AS BIGINT) AS most FROM s GROUP BY line, CAST(floor(t / 3600) AS BIGINT)"
)
def concurrency_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most spans open at once, by line and the hour in which the count changes; changes are summed before the sweep."""
    x = events(spark, sf_dir).select((F.col("veh") % 10).alias("line"), F.col("t").alias("a"), (F.col("t") + 60 * F.col("k") + 1).alias("b"))
    change = x.select("line", F.explode(F.array(F.struct(F.col("a").alias("t"), F.lit(1).alias("d")), F.struct(F.col("b").alias("t"), F.lit(-1).alias("d")))).alias("c"))
    g = change.groupBy("line", "c.t").agg(F.sum("c.d").alias("d"))
    s = running(g, ["line"], ["t"], F.floor(F.col("t") / 86_400), "sum", F.col("d"), "n")
    return s.groupBy("line", F.floor(F.col("t") / 3600).cast("long").alias("hour")).agg(F.max("n").cast("long").alias("most"))


@_add(
    "s AS (SELECT event_id, veh, stop, t, lag(stop) OVER w AS from_stop, t - lag(t) OVER w AS gap FROM e WINDOW w AS (PARTITION BY veh ORDER BY t, event_id)) "
    f"SELECT event_id, veh, stop, t, from_stop FROM s WHERE from_stop IS NULL OR from_stop <> stop OR gap > {detect.SAME_VISIT}"
)
def stream_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful detector, replayed over the stored log as a stream."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 8).parquet(sf_dir)
    reports = source.select("event_id", F.col("user_id").alias("veh"), F.col("event_type").alias("stop"), seconds(F.col("ts")).alias("t"))
    return detect.replay(spark, detect.arrivals(reports), shared_folder(spark))


@_add(
    "s AS (SELECT event_id AS sid, veh, t AS seen, t + 1000 * k AS last FROM e WHERE stop = 'view'), q AS (SELECT event_id, veh, t FROM e WHERE stop = 'purchase'), "
    "n AS (SELECT q.event_id, q.veh, q.t, max(struct_pack(seen := seen, sid := sid, last := last)) AS top FROM q LEFT JOIN s ON s.veh = q.veh AND s.seen <= q.t GROUP BY ALL) "
    "SELECT veh, event_id, t, CASE WHEN top.last >= t - 90 THEN top.seen END AS seen, CASE WHEN top.last >= t - 90 THEN top.last END AS last FROM n"
)
def stream_displays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring of newest forecasts kept by a stream, replayed over the stored log; each question is answered as by the batch join."""
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 8).parquet(sf_dir)
    log = source.select("event_id", F.col("user_id").alias("veh"), F.col("event_type").alias("stop"), seconds(F.col("ts")).alias("t"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    rows = log.where("stop IN ('view', 'purchase')").select("veh", "event_id", "t", (F.col("stop") == "purchase").alias("asks"), (F.col("t") + 1000 * F.col("k")).alias("last"))
    return detect.replay(spark, detect.displays(rows), shared_folder(spark))


@_add()
def stream_fleet_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles that come to a route or leave it while others run there, from a stream replayed over the stored log."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 8).parquet(sf_dir)
    reports = source.select(F.col("event_type").alias("route"), F.col("user_id").alias("veh"), seconds(F.col("ts")).alias("s"))
    return detect.replay(spark, detect.fleet_changes(reports.select("route", "veh", F.expr("s div 144").alias("t"))), shared_folder(spark))


#: Misspelt names: a letter left out, neighbours swapped, a key beside, a letter doubled.
MISSPELT = ("patr 333", "smlal ring", "red widgt", "bkue bolt", "hott gear")


@_add(
    "r AS (SELECT l_suppkey, abs(l_extendedprice - 1000 * l_quantity) AS err FROM lineitem), n AS (SELECT l_suppkey, err, row_number() OVER (PARTITION BY l_suppkey ORDER BY err) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM r) "
    "SELECT l_suppkey, n, round(err, 4) AS bound FROM n WHERE i = least(n, CAST(ceil((n + 1) * 9 / 10) AS BIGINT))"
)
def conformal_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ceil(0.9 (n + 1))-th smallest absolute error of each stop, from counts of distinct errors."""
    r = table(spark, sf_dir, "lineitem").select("l_suppkey", F.abs(F.col("l_extendedprice") - 1000 * F.col("l_quantity")).alias("err"))
    g = r.groupBy("l_suppkey", "err").agg(F.count("*").alias("c"))
    n = g.groupBy("l_suppkey").agg(F.sum("c").alias("n"))
    upto = running(g, ["l_suppkey"], ["err"], F.floor(F.col("err") / 1000), "sum", F.col("c"), "upto").join(n, "l_suppkey")
    rank = F.least(F.col("n"), F.ceil((F.col("n") + 1) * 9 / 10))
    return upto.where(F.col("upto") >= rank).groupBy("l_suppkey").agg(F.max("n").alias("n"), F.round(F.min("err"), 4).alias("bound"))


@_add(
    "x AS (SELECT veh % 10 AS line, ln(value + 1) AS y, k / 100.0 AS a, (t % 86400) / 86400.0 AS b FROM e), "
    "s AS (SELECT line, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(y) AS sy, sum(a * y) AS ay, sum(b * y) AS byy FROM x GROUP BY line), "
    "m AS (SELECT line, n, aa - sa * sa / n + 1 AS p, ab - sa * sb / n AS q, bb - sb * sb / n + 1 AS r, ay - sa * sy / n AS u, byy - sb * sy / n AS v FROM s) "
    "SELECT line, n, round((u * r - v * q) / (p * r - q * q), 6) AS wa, round((v * p - u * q) / (p * r - q * q), 6) AS wb FROM m"
)
def ridge_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge regression (penalty 1, free intercept) of the log value on two measures, by normal equations."""
    x = events(spark, sf_dir).select(
        (F.col("veh") % 10).alias("line"), F.log(F.col("value") + 1).alias("y"), (F.col("k") / 100).alias("a"), (F.col("t") % 86400 / 86400).alias("b")
    )
    a, b, y = F.col("a"), F.col("b"), F.col("y")
    s = x.groupBy("line").agg(
        F.count("*").alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(y).alias("sy"), F.sum(a * a).alias("aa"), F.sum(a * b).alias("ab"),
        F.sum(b * b).alias("bb"), F.sum(a * y).alias("ay"), F.sum(b * y).alias("byy"),
    )
    m = s.selectExpr("line", "n", "aa - sa * sa / n + 1 AS p", "ab - sa * sb / n AS q", "bb - sb * sb / n + 1 AS r", "ay - sa * sy / n AS u", "byy - sb * sy / n AS v")
    return m.selectExpr("line", "n", "round((u * r - v * q) / (p * r - q * q), 6) AS wa", "round((v * p - u * q) / (p * r - q * q), 6) AS wb")


@_add()
def day_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of high values by line, with an interval over whole days drawn with replacement (200 draws)."""
    e = events(spark, sf_dir)
    days = e.groupBy((F.col("veh") % 10).alias("line"), F.floor(F.col("t") / 86400).alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("hit"))
    return day_shares(days, ["line"]).select("line", *[F.round(c, 6).alias(c) for c in ("share", "low", "high")])


@_add()
def spelling_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names nearest to misspelt queries; lengths differ by 5 at most, as a letter more costs 0.5 at least and the limit is 2.5.

    Names are compared once each, however many parts have them."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"))
    asked = spark.createDataFrame([(q,) for q in MISSPELT], "q string")
    names = parts.select("name").distinct()
    pairs = names.join(F.broadcast(asked), F.abs(F.length("name") - F.length("q")) <= 5).withColumn("cost", spelling(F.col("q"), F.col("name")))
    best = Window.partitionBy("q").orderBy("cost", "p_partkey")
    return pairs.where("cost <= 2.5").join(parts, "name").withColumn("o", F.row_number().over(best)).where("o <= 5").select("q", "p_partkey", F.round("cost", 4).alias("cost"), "o")
