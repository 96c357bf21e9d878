"""Queries over alignment, geometry, planning and corrections, with SQL of other words where SQL can express them.

The best alignment and a beam over words have none; tests compare them with the full table and with a search over the whole vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators import alignment, clusters, corrections, forecasts, geometry, planning, rebuilt, service
from tramline.operators.cuts import numbered
from tramline.operators.lineage import written
from tramline.plans.statements import LOG
from tramline.sources.tables import events, table

QUERIES, ORACLES = {}, {}
BEGIN = 1_704_067_200


def _add(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {LOG}, {sql}"
        return f

    return put


def _planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each vehicle's log as its planned stops, and the same log, late or early and with holes, as live times."""
    rows = events(spark, sf_dir).withColumns({"due": F.expr("t div 40"), "stop": F.col("k") % 6})
    planned = numbered(rows, ["veh"], "t", "event_id", "pos", keep=["stop", "due"]).select("veh", "pos", "stop", "due")
    late = F.col("event_id") * 37 % 900 - 300
    return planned, rows.where("k % 5 <> 0").select("veh", F.col("event_id").alias("id"), "stop", (F.col("due") + late).alias("t"))


@_add()
def visits_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live time of each planned stop, by the largest alignment in both orders that is nearest to the plan."""
    planned, live = _planned(spark, sf_dir)
    cost = F.abs(F.log((F.abs(F.col("r_t") - F.col("due")) + 60) / 60))
    return alignment.aligned(planned, live, ["veh"], 900, 1800, cost).select("veh", "pos", "id", "t")


@_add()
def station_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times at every stop of every vehicle: live rows that its own way allows, its aligned times, and estimates between them."""
    planned, live = _planned(spark, sf_dir)
    found = alignment.aligned(planned, live, ["veh"], 900, 1800).select("veh", "pos", F.col("t").alias("live"))
    begin = planned.groupBy("veh").agg(F.min("due").alias("now"))
    stops = planned.join(found, ["veh", "pos"], "left").join(begin, "veh")
    times = alignment.stop_times(stops.select("veh", "pos", "stop", (F.col("due") - F.col("now")).alias("ride"), "live", "now"), ["veh"])
    shown = alignment.board(times, live, ["veh"])
    return shown.select("stop", "veh", F.round("at", 3).alias("at"), "kind", "away")


_CUSTOMER_AT = "c AS (SELECT c_custkey AS id, CAST(c_custkey * 7919 % 100003 AS DOUBLE) AS x, CAST(c_custkey * 104729 % 99991 AS DOUBLE) AS y, c_nationkey AS nation FROM customer)"


@_add(
    f"{_CUSTOMER_AT}, d AS (SELECT p.id, q.id AS other, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS m FROM c p JOIN c q ON p.id <> q.id), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, other) AS r FROM d) SELECT id, other, CAST(r AS INTEGER) AS r, round(m, 3) AS m FROM o WHERE r <= 3"
)
def nearest_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest places of each place, over a pyramid of cells."""
    key = F.col("c_custkey")
    at = table(spark, sf_dir, "customer").select(key.alias("id"), (key * 7919 % 100003).cast("double").alias("x"), (key * 104729 % 99991).cast("double").alias("y"))
    return geometry.nearest(at, at, 3, self_=True).select("id", "other", "r", F.round("m", 3).alias("m"))


_TRACK = (
    f"v AS (SELECT veh % 10 AS line, row_number() OVER (PARTITION BY veh % 10 ORDER BY t, event_id) AS seq, (t - {BEGIN}) / 60.0 AS x, value AS y FROM e WHERE stop = 'view'), "
    "g0 AS (SELECT line, seq, lag(x) OVER w AS ax, lag(y) OVER w AS ay, x AS bx, y AS by_ FROM v WINDOW w AS (PARTITION BY line ORDER BY seq)), "
    "g1 AS (SELECT *, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS len FROM g0 WHERE ax IS NOT NULL), "
    "g AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY line ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM g1), "
    f"p AS (SELECT event_id AS id, veh % 10 AS line, (t - {BEGIN}) / 60.0 + k AS x, value + 10 AS y, row_number() OVER (PARTITION BY veh % 10 ORDER BY t, event_id) AS i FROM e WHERE stop = 'purchase'), "
    "w AS (SELECT p.*, g.seq, start, len, ax, ay, bx, by_, CASE WHEN len > 0 THEN least(1, greatest(0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / (len * len))) ELSE 0 END AS f FROM p JOIN g USING (line)), "
    "n AS (SELECT id, line, i, sqrt(pow(ax + f * (bx - ax) - x, 2) + pow(ay + f * (by_ - ay) - y, 2)) AS d, start + f * len AS along FROM w)"
)


def _tracks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Segments of ten lines, and places beside them."""
    rows = events(spark, sf_dir).select("event_id", (F.col("veh") % 10).alias("line"), "stop", "t", ((F.col("t") - BEGIN) / 60.0).alias("x"), F.col("value").alias("y"), "k")
    views = rows.where("stop = 'view'")
    order = numbered(views, ["line"], "t", "event_id", "seq", keep=["x", "y"])
    segs = geometry.segments(order.select("line", "seq", "x", "y"), ["line"])
    points = rows.where("stop = 'purchase'").select("line", F.col("event_id").alias("id"), "t", (F.col("x") + F.col("k")).alias("x"), (F.col("y") + 10).alias("y"))
    return points, segs


@_add(f"{_TRACK}, o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, along) AS o FROM n) SELECT id, round(d, 4) AS d, round(along, 2) AS along FROM o WHERE o = 1")
def places_on_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each place is from its line, and how far along the line its nearest point is."""
    points, segs = _tracks(spark, sf_dir)
    return geometry.on_line(points.select("line", "id", "x", "y"), segs, ["line"]).select("id", F.round("d", 4).alias("d"), F.round("along", 2).alias("along"))


@_add(
    f"{_TRACK}, b AS (SELECT id, min(d) AS best FROM n GROUP BY id), "
    "q AS (SELECT line, i, id, list_sort(list(along) FILTER (d <= best + 25)) AS ways, arg_min(along, d) AS near FROM n JOIN b USING (id) GROUP BY line, i, id), "
    "r AS (SELECT DISTINCT line, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, -1e18 AS far, CAST(NULL AS DOUBLE) AS spot FROM p UNION ALL "
    "SELECT line, i, id, greatest(far, spot), spot FROM (SELECT q.line, q.i, q.id, far, coalesce(list_filter(ways, lambda z: z >= far - 5)[1], near) AS spot FROM r JOIN q ON q.line = r.line AND q.i = r.i + 1)) "
    "SELECT id, round(spot, 2) AS along FROM r WHERE id IS NOT NULL"
)
def places_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places along their lines, each no farther back than the one before it in time."""
    points, segs = _tracks(spark, sf_dir)
    stops = numbered(points, ["line"], "t", "id", "seq", keep=["x", "y"])
    return geometry.along(stops, segs, ["line"]).select("id", F.round("along", 2).alias("along"))


_STOPS = 60


@_add(
    "s AS (SELECT l_orderkey AS trip, l_linenumber AS seq, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), "
    f"tt AS (SELECT trip, trip % 12 AS route, seq, p % {_STOPS} AS stop, trip * 97 % 80000 + 240 * seq + p % 120 AS dep FROM s), "
    "b AS (SELECT route, stop, dep, trip, seq FROM tt WHERE EXISTS (SELECT 1 FROM tt x WHERE x.trip = tt.trip AND x.seq > tt.seq)), "
    "bb AS (SELECT route, stop, dep, min(trip) AS trip FROM b GROUP BY route, stop, dep), bq AS (SELECT bb.*, min(seq) AS seq FROM bb JOIN b USING (route, stop, dep, trip) GROUP BY ALL), "
    f"wk AS (SELECT a, b, CASE WHEN a = b THEN 0 ELSE 150 END AS w FROM range({_STOPS}) AS x(a), range({_STOPS}) AS y(b) WHERE abs(a - b) <= 1), "
    f"ask AS (SELECT c_custkey AS ask, c_custkey % {_STOPS} AS origin, (c_custkey * 7 + 3) % {_STOPS} AS dest, c_custkey * 613 % 80000 AS t FROM customer), "
    "rt AS (SELECT DISTINCT route, stop FROM bq), r1 AS (SELECT ask, dest, w AS out, rt.route, b AS stop, t + w AS ready FROM ask JOIN wk ON a = origin JOIN rt ON rt.stop = b), "
    "f1 AS (SELECT r1.ask, r1.dest, r1.out, bq.* FROM r1 ASOF JOIN bq ON r1.route = bq.route AND r1.stop = bq.stop AND r1.ready <= bq.dep), "
    "a1 AS (SELECT ask, dest, f1.route, f1.dep - out AS leave, tt.stop, tt.dep - 20 AS arr FROM f1 JOIN tt ON tt.trip = f1.trip AND tt.seq > f1.seq), "
    "o1 AS (SELECT ask, 0 AS changes, route, NULL AS nxt, leave, arr + w AS arrive FROM a1 JOIN wk ON a = stop AND b = dest), "
    "m1 AS (SELECT * FROM a1 QUALIFY row_number() OVER (PARTITION BY ask, route, stop ORDER BY arr, leave DESC) = 1), "
    "q1 AS (SELECT ask, dest, route AS one, leave, b AS stop, arr + w + 60 AS ready FROM m1 JOIN wk ON a = stop QUALIFY row_number() OVER (PARTITION BY ask, route, b ORDER BY arr + w, leave DESC) = 1), "
    "r2 AS (SELECT q1.*, rt.route FROM q1 JOIN rt ON rt.stop = q1.stop AND rt.route <> one), "
    "f2 AS (SELECT r2.ask, r2.dest, r2.one, r2.leave, bq.route, bq.trip, bq.seq FROM r2 ASOF JOIN bq ON r2.route = bq.route AND r2.stop = bq.stop AND r2.ready <= bq.dep), "
    "o2 AS (SELECT ask, 1 AS changes, one AS route, f2.route AS nxt, leave, tt.dep - 20 + w AS arrive FROM f2 JOIN tt ON tt.trip = f2.trip AND tt.seq > f2.seq JOIN wk ON a = tt.stop AND b = dest), "
    "u AS (SELECT * FROM (SELECT * FROM o1 UNION ALL SELECT * FROM o2) x QUALIFY row_number() OVER (PARTITION BY ask, route, nxt ORDER BY arrive, leave DESC) = 1), "
    "k AS (SELECT *, min(arrive) OVER (PARTITION BY ask ORDER BY leave DESC, arrive, changes, route, nxt NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM u) "
    'SELECT ask, changes, route, nxt AS "then", leave, arrive FROM k WHERE least IS NULL OR arrive < least'
)
def clock_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct trips and trips with one change for every rider, on a timetable made of all order lines."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trip"), F.col("l_linenumber").alias("seq")).agg(F.min("l_partkey").alias("p"))
    dep = F.col("trip") * 97 % 80000 + 240 * F.col("seq") + F.col("p") % 120
    timetable = written(s.select("trip", (F.col("trip") % 12).alias("route"), "seq", (F.col("p") % _STOPS).alias("stop"), (dep - 20).alias("arr"), dep.alias("dep")))
    key = F.col("c_custkey")
    asks = table(spark, sf_dir, "customer").select(key.alias("ask"), (key % _STOPS).alias("origin"), ((key * 7 + 3) % _STOPS).alias("dest"), (key * 613 % 80000).alias("t"))
    stops = timetable.select("stop").distinct()
    step = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    walks = stops.select(F.col("stop").alias("a"), step.alias("d")).select("a", (F.col("a") + F.col("d")).alias("b"), F.when(F.col("d") == 0, 0).otherwise(150).alias("s"))
    return planning.trips(asks, timetable, walks.where(F.col("b").between(0, _STOPS - 1)))


@_add(
    "w AS (SELECT o_custkey % 20 AS line, CASE WHEN o_orderkey % 3 = 0 THEN 's' ELSE 'w' END AS service, o_orderkey % 4 AS part, o_orderkey % 4 * 25000 + min(o_custkey % 3000) AS first, "
    "o_orderkey % 4 * 25000 + 9000 + max(o_custkey % 9000) AS last FROM orders GROUP BY 1, 2, 3), d AS (SELECT DISTINCT t // 86400 AS day FROM e WHERE t // 86400 % 11 <> 0), "
    "s AS (SELECT line, day * 86400 + first AS a, day * 86400 + last AS b FROM d JOIN w ON service = CASE WHEN (day + 3) % 7 >= 5 THEN 's' ELSE 'w' END WHERE last > first), "
    "m AS (SELECT *, max(b) OVER (PARTITION BY line ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), "
    "i AS (SELECT *, sum(CASE WHEN reach >= a THEN 0 ELSE 1 END) OVER (PARTITION BY line ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isle FROM m), "
    "u AS (SELECT line, min(a) AS a, max(b) AS b FROM i GROUP BY line, isle), "
    "q AS (SELECT event_id AS ask, t FROM e WHERE stop = 'error'), "
    "x AS (SELECT ask, t, line, bool_or(a <= t) AS runs, bool_or(a <= t AND a // 86400 < t // 86400) AS tail, min(a) FILTER (a > t) AS nxt FROM q JOIN s ON b > t AND a // 86400 - 7 <= t // 86400 GROUP BY ask, t, line), "
    "y AS (SELECT x.*, CASE WHEN runs THEN u.b ELSE nxt END AS c FROM x LEFT JOIN u ON runs AND u.line = x.line AND u.a <= t AND t < u.b) "
    "SELECT ask, line, runs, tail, CASE WHEN c < (t // 86400 + 8) * 86400 THEN c END AS change FROM y"
)
def lines_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error in the log and each line: whether it runs then, whether that is the night's tail of the day before, and when that changes."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf_dir, "orders").select((cust % 20).alias("line"), F.when(key % 3 == 0, "s").otherwise("w").alias("service"), (key % 4 * 25000).alias("base"), "o_custkey")
    windows = orders.groupBy("line", "service", "base").agg(F.min(cust % 3000).alias("lo"), F.max(cust % 9000).alias("hi")).select("line", "service", (F.col("base") + F.col("lo")).alias("first"), (F.col("base") + 9000 + F.col("hi")).alias("last"))
    log = events(spark, sf_dir)
    days = log.select(F.expr("t div 86400").alias("day")).distinct().where("day % 11 <> 0")
    calendar = days.withColumn("service", F.when((F.col("day") + 3) % 7 >= 5, "s").otherwise("w"))
    spans = planning.on_days(windows, calendar, ["line"])
    return planning.status(log.where("stop = 'error'").select(F.col("event_id").alias("ask"), "t"), spans, ["line"])


#: Misspelt queries: swapped neighbours, keys beside, doubled letters, a space too few or too many, an unfinished word.
TYPED = ("smlal rign", "bkue bolt", "hott gear", "redwidget", "sma ll plate", "large widg", "olld rdo", "small ring", "coldd gea")


@_add()
def names_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best corrections of misspelt queries by the words of all part names."""
    asked = spark.createDataFrame([(q,) for q in TYPED], "q string")
    return corrections.corrected(asked, corrections.vocabulary(table(spark, sf_dir, "part"), "p_name"))


@_add(
    "c AS (SELECT stop, veh % 5 AS line, t % 86400 // 60 AS m, count(*) AS n FROM e GROUP BY 1, 2, 3), g AS (SELECT stop, line, m, lead(m) OVER (PARTITION BY stop, line ORDER BY m) AS nxt FROM c), "
    "b AS (SELECT stop, line, m, CASE WHEN lag(m) OVER w IS NULL OR m - lag(m) OVER w > 15 THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY stop, line ORDER BY m)), "
    "i AS (SELECT *, sum(new) OVER (PARTITION BY stop, line ORDER BY m ROWS UNBOUNDED PRECEDING) AS isle FROM b), "
    "r AS (SELECT stop, line, min(m) AS lo, max(m) AS hi FROM i GROUP BY stop, line, isle UNION ALL SELECT stop, line, unnest([lo, nxt]) AS lo, unnest([m, hi]) AS hi FROM ("
    "SELECT r.stop, r.line, lo, hi, g.m, g.nxt FROM r JOIN g ON g.stop = r.stop AND g.line = r.line AND g.m >= lo AND g.nxt <= hi WHERE hi - lo > 30 "
    "QUALIFY row_number() OVER (PARTITION BY r.stop, r.line, lo, hi ORDER BY g.nxt - g.m DESC, g.m DESC) = 1) x WHERE nxt - m >= 3), "
    "f AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.stop = r.stop AND g.line = r.line AND g.m >= lo AND g.nxt <= hi AND g.nxt - g.m >= 3 AND hi - lo > 30)) "
    "SELECT f.stop, f.line, CAST(lo AS DOUBLE) AS a, CAST(hi AS DOUBLE) AS b, CAST(sum(n) AS BIGINT) AS n, row_number() OVER (PARTITION BY f.stop, f.line ORDER BY lo) AS cluster "
    "FROM f JOIN c ON c.stop = f.stop AND c.line = f.line AND m BETWEEN lo AND hi GROUP BY f.stop, f.line, lo, hi"
)
def clock_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes of the day at which a line is seen at a stop, in clusters at most half an hour wide where a gap allows it."""
    rows = events(spark, sf_dir).select("stop", (F.col("veh") % 5).alias("line"), F.expr("t % 86400 div 60").alias("m"))
    return clusters.clusters(rows, ["stop", "line"], "m", 15, 30, 3)


_FORECASTS = (
    "x AS (SELECT event_id AS id, veh, k % 3 AS trip, veh % 4 AS route, k % 5 AS idx, t // 40 AS t, k, stop AS kind FROM e), "
    "ln AS (SELECT r AS route, i AS idx, CASE WHEN i = 4 AND r < 3 THEN 0 ELSE i END AS stop FROM range(4) AS a(r), range(5) AS b(i)), "
    "ar AS (SELECT id, veh, trip, x.route, ln.stop, x.idx, t FROM x JOIN ln ON ln.route = x.route AND ln.idx = x.idx WHERE kind <> 'view'), "
    "sh AS (SELECT id, veh, trip, ln.stop, CASE WHEN k % 4 > 0 THEN x.idx + 1 END AS seq, t - 900 AS seen, t - 900 + 60 * (k % 50) AS until, t - 900 - k % 7 * 30 AS made, t + 600 + k * 9 - 300 AS pred FROM x JOIN ln ON ln.route = x.route AND ln.idx = x.idx), "
    "pl AS (SELECT route, stop, count(*) > 1 AS loop, max(idx) AS last_idx FROM ln GROUP BY route, stop), tp AS (SELECT veh, trip, stop, max(seq) AS top FROM sh GROUP BY ALL), "
    "a1 AS (SELECT ar.*, loop, CASE WHEN loop AND ar.idx = last_idx AND top > 1 THEN top ELSE ar.idx + 1 END AS want FROM ar JOIN pl USING (route, stop) LEFT JOIN tp USING (veh, trip, stop)), "
    "a2 AS (SELECT a1.*, p.top.t AS pa, p.top.idx AS pa_idx FROM a1 LEFT JOIN (SELECT a1.id, max(struct_pack(t := y.t, id := y.id, idx := y.idx)) AS top FROM a1 JOIN ar y ON y.veh = a1.veh AND y.stop = a1.stop AND y.t < a1.t GROUP BY a1.id) p USING (id)), "
    "g AS (SELECT a2.*, a2.t AS actual, m * 300 AS q FROM a2, unnest(range(CAST(ceil((a2.t - 3600) / 300) AS BIGINT), CAST(ceil(a2.t / 300) AS BIGINT))) AS u(m)), "
    "h AS (SELECT *, row_number() OVER (PARTITION BY veh, q, trip, stop, CASE WHEN loop THEN idx END ORDER BY actual, id) AS rank FROM g), "
    "l AS (SELECT veh, q, max(struct_pack(t := ar.t, id := ar.id, trip := ar.trip, idx := ar.idx)) AS last FROM (SELECT DISTINCT veh, q FROM g) d JOIN ar USING (veh) WHERE ar.t <= q GROUP BY veh, q), "
    "v AS (SELECT h.id, q, max(y.t) AS pv FROM h JOIN ar y ON y.veh = h.veh AND y.trip = h.trip AND y.stop = h.stop AND y.t <= q WHERE rank = 1 GROUP BY h.id, q), "
    "n AS (SELECT h.id, q, max(struct_pack(seen := s.seen, id := s.id, until := s.until, made := s.made, pred := s.pred, seq := s.seq)) AS f FROM h JOIN sh s ON s.veh = h.veh AND s.trip = h.trip AND s.stop = h.stop AND s.seen <= q "
    "WHERE rank = 1 AND (NOT loop OR s.seq IS NULL OR s.seq = want) GROUP BY h.id, q), "
    "z AS (SELECT h.*, l.last, CASE WHEN rank > 1 OR f IS NULL OR f.until < q - 90 THEN 'none' WHEN (pv IS NOT NULL AND q - pv <= 7200 AND (f.made <= pv OR f.pred < pv + 120)) "
    "OR (pa IS NOT NULL AND actual - pa <= 7200 AND f.pred < pa + 120 AND NOT (loop AND f.seq IS NOT NULL AND f.seq = want AND pa_idx + 1 <> want)) THEN 'previous_lap' ELSE 'shown' END AS status, f "
    "FROM h LEFT JOIN l USING (veh, q) LEFT JOIN v USING (id, q) LEFT JOIN n USING (id, q)) "
    "SELECT id, q AS t, rank, coalesce(last.trip <> trip, FALSE) AS next_trip, CASE WHEN last.trip = trip AND idx > last.idx THEN idx - last.idx WHEN last.trip <> trip THEN 4 - last.idx + idx END AS stops_away, "
    "actual - q AS lead, status, CASE WHEN status = 'shown' THEN f.pred - actual END AS error FROM z"
)


@_add(_FORECASTS)
def forecast_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecast table of the whole log: four lines, three of which end where they begin, arrivals and forecasts of each vehicle."""
    k = F.col("k")
    rows = events(spark, sf_dir).withColumns({"id": F.col("event_id"), "trip": k % 3, "route": F.col("veh") % 4, "idx": k % 5, "at": F.expr("t div 40")})
    ends = (F.col("idx") == 4) & (F.col("route") < 3)
    rows = rows.withColumns({"place": F.when(ends, 0).otherwise(F.col("idx"))})
    arrivals = rows.where("stop <> 'view'").select("id", "veh", "trip", "route", F.col("place").alias("stop"), "idx", F.col("at").alias("t"))
    at = F.col("at")
    shown = rows.select(
        "id", "veh", "trip", F.col("place").alias("stop"), F.when(k % 4 > 0, F.col("idx") + 1).alias("seq"), (at - 900).alias("seen"), (at - 900 + 60 * (k % 50)).alias("last"),
        (at - 900 - k % 7 * 30).alias("made"), (at + 600 + k * 9 - 300).alias("pred"),
    )
    order = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("idx")
    lines = rows.select("route").distinct().select("route", order).withColumn("stop", F.when(ends, 0).otherwise(F.col("idx")))
    found = forecasts.forecast_table(arrivals, shown, lines, 300, 3600)
    return found.select("id", "t", "rank", "next_trip", "stops_away", "lead", "status", "error")


@_add(
    "p AS (SELECT event_id AS id, veh, k % 2 AS trip, stop, t // 40 AS seen, t // 40 + k * 10 AS last, (t // 40 + k * 10 + 90) // 30 * 30 AS lapse FROM e), "
    "q AS (SELECT *, CASE WHEN seen % 30 = 0 THEN seen ELSE (seen // 30 + 1) * 30 END AS a FROM p), "
    "n AS (SELECT *, lead(a) OVER (PARTITION BY veh, trip, stop ORDER BY seen, id) AS nxt FROM q), s AS (SELECT veh, trip, stop, a, least(lapse, coalesce(nxt - 30, lapse)) AS b, id FROM n), "
    "v AS (SELECT * FROM s WHERE b >= a), g AS (SELECT DISTINCT (CASE WHEN (t // 40) % 30 = 0 THEN t // 40 ELSE (t // 40 // 30 + 1) * 30 END) AS t FROM e WHERE stop = 'error') "
    "SELECT g.t, veh, trip, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM g JOIN v ON g.t BETWEEN a AND b GROUP BY g.t, veh, trip"
)
def feeds_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries each vehicle's trip showed at the poll after every error in the log, from the spans of all entries."""
    at = F.expr("t div 40")
    log = events(spark, sf_dir).select(F.col("event_id").alias("id"), "veh", (F.col("k") % 2).alias("trip"), "stop", at.alias("seen"), (at + F.col("k") * 10).alias("last"), at.alias("made"), F.col("event_id").alias("entry"), F.lit(1).alias("seq"))
    held = rebuilt.spans(log, ["veh", "trip", "stop"], ["entry", "seq"])
    snaps = rebuilt.snapshots(held, ["veh", "trip"], "seq", ["stop", "entry"])
    polls = events(spark, sf_dir).where("stop = 'error'").select((F.ceil(F.expr("t div 40") / 30) * 30).alias("t")).distinct()
    shown = rebuilt.shown_at_polls(polls, snaps)
    ids = F.aggregate("entries", F.lit(0).cast("long"), lambda n, x: n + x["entry"])
    return shown.select("t", "veh", "trip", F.size("entries").cast("long").alias("n"), ids.alias("ids"))


_SPANS = "sp AS (SELECT veh % 12 AS route, t // 3600 * 3600 AS a, t // 3600 * 3600 + 1800 + k * 30 AS b FROM e WHERE stop = 'click' AND veh % 12 < 10)"


def _spans(log: DataFrame) -> DataFrame:
    start = F.expr("t div 3600 * 3600")
    return log.where("stop = 'click'").select((F.col("veh") % 12).alias("route"), start.alias("a"), (start + 1800 + F.col("k") * 30).alias("b")).where("route < 10")


@_add(
    f"{_SPANS}, bu AS (SELECT event_id AS id, veh, k % 4 AS trip, veh % 13 AS route, t - k * 6 AS t, t AS now FROM e WHERE stop = 'view'), "
    "pr AS (SELECT k % 4 AS trip, CASE WHEN k % 3 > 0 THEN veh END AS veh, t AS at FROM e WHERE stop = 'error' AND veh < 20) "
    "SELECT id FROM bu WHERE now - t <= 300 AND route < 12 AND (EXISTS (SELECT 1 FROM sp WHERE sp.route = bu.route AND a <= now AND now < b) OR NOT EXISTS (SELECT 1 FROM sp WHERE sp.route = bu.route) "
    "OR EXISTS (SELECT 1 FROM pr WHERE pr.trip = bu.trip AND (pr.veh IS NULL OR pr.veh = bu.veh) AND pr.at >= now - 60))"
)
def operating_buses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The views of the log whose vehicle is in service: reporting, on a known line, and scheduled or still forecast."""
    log = events(spark, sf_dir)
    k = F.col("k")
    buses = log.where("stop = 'view'").select(F.col("event_id").alias("id"), "veh", (k % 4).alias("trip"), (F.col("veh") % 13).alias("route"), (F.col("t") - k * 6).alias("t"), F.col("t").alias("now"))
    predictions = log.where("stop = 'error' AND veh < 20").select((k % 4).alias("trip"), F.when(k % 3 > 0, F.col("veh")).alias("veh"), F.col("t").alias("at"))
    return service.operating(buses, log.select((F.col("veh") % 12).alias("route")), _spans(log), predictions).select("id")


@_add(
    f"{_SPANS}, q AS (SELECT event_id AS ask, t AS now, CASE WHEN k % 5 > 0 THEN t - k * 60 END AS last_seen, k % 3 > 0 AS feed_ok, CASE WHEN k > 95 THEN 1 ELSE 0 END AS buses FROM e WHERE stop = 'purchase'), "
    "v AS (SELECT DISTINCT a, b FROM sp WHERE b > a AND route = 3), w AS (SELECT q.*, CASE WHEN buses > 0 THEN 'live' WHEN now - last_seen < 1800 THEN 'seen' WHEN EXISTS (SELECT 1 FROM v WHERE a - 2700 <= now AND now < a + 1800) THEN 'starts' "
    "WHEN NOT feed_ok AND EXISTS (SELECT 1 FROM v WHERE a - 2700 <= now AND now < b + 1800) THEN 'feed_down' ELSE 'idle' END AS why FROM q) "
    "SELECT ask, why <> 'idle' AS collect, why, CASE WHEN why = 'idle' THEN (SELECT min(a) FROM v WHERE a - 2700 > now) - 2700 END AS wake FROM w"
)
def collection_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether to collect at each purchase of the log, by the spans of one line, and when to look again."""
    log, k = events(spark, sf_dir), F.col("k")
    asks = log.where("stop = 'purchase'").select(
        F.col("event_id").alias("ask"), F.col("t").alias("now"), F.when(k % 5 > 0, F.col("t") - k * 60).alias("last_seen"), (k % 3 > 0).alias("feed_ok"), F.when(k > 95, 1).otherwise(0).alias("buses")
    )
    return service.gate(asks, _spans(log).where("route = 3"))


@_add(
    "ln AS (SELECT r AS route, i AS idx, CASE WHEN i = 6 AND r % 2 = 0 THEN r * 10 ELSE r * 10 + i END AS stop FROM range(8) AS a(r), range(7) AS b(i)), "
    "bu AS (SELECT event_id AS id, veh % 8 AS route, veh % 8 * 10 + k % 8 AS nxt FROM e), o AS (SELECT route, stop, min(idx) AS idx FROM ln GROUP BY route, stop) "
    "SELECT id, o.stop, CASE WHEN o.idx >= x.idx THEN o.idx - x.idx ELSE o.idx - x.idx + 6 END AS away FROM bu JOIN o x ON x.route = bu.route AND x.stop = nxt JOIN o ON o.route = bu.route WHERE o.idx >= x.idx OR bu.route % 2 = 0"
)
def buses_stops_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many stops each vehicle is from every stop of its line; four of eight lines are loops."""
    log = events(spark, sf_dir)
    order = F.explode(F.sequence(F.lit(0), F.lit(6))).alias("idx")
    lines = log.select((F.col("veh") % 8).alias("route")).distinct().select("route", order)
    stop = F.col("route") * 10 + F.when((F.col("idx") == 6) & (F.col("route") % 2 == 0), 0).otherwise(F.col("idx"))
    buses = log.select(F.col("event_id").alias("id"), (F.col("veh") % 8).alias("route"), (F.col("veh") % 8 * 10 + F.col("k") % 8).alias("next"))
    return service.stops_away(buses, lines.withColumn("stop", stop))
