"""Further queries that are plain SQL in both engines; see statements.py for the form."""

from __future__ import annotations

from tramline.plans.statements import Statement

_DAY = "CAST(floor(t / 86400) AS BIGINT)"
_HOUR = "CAST(floor(t / 3600) AS BIGINT)"
#: Weekday of a number of days since 1970-01-01, Monday 0.
_DOW = f"({_DAY} + 3) % 7"
_FORECASTS = "f AS (SELECT o_orderkey AS id, o_custkey % 40 AS route, o_orderkey % 2700 + 1 AS lead, CAST(round(o_totalprice) AS BIGINT) % 900 - 450 AS err FROM {orders})"

MORE = {
    # Projections and predicates.
    "first_match_bins": Statement(
        "b AS (SELECT * FROM (VALUES (0, 120), (120, 300), (300, 600), (600, 1200)) AS v(lo, hi)), f AS (SELECT o_orderkey AS id, o_orderkey % 1500 AS lead FROM {orders})",
        "SELECT id, min(lo) AS lo FROM f LEFT JOIN b ON lead >= lo AND lead < hi GROUP BY id",
    ),
    "errors_by_source": Statement(
        "f AS (SELECT l_orderkey AS id, l_linenumber AS n, l_quantity + 1 AS lead, l_quantity AS actual, l_tax * 500 AS a, l_discount * 400 AS b, l_extendedprice / 1000 AS c FROM {lineitem}), "
        "u AS (SELECT id, n, 'a' AS source, a - actual AS err, lead FROM f UNION ALL SELECT id, n, 'b', b - actual, lead FROM f UNION ALL SELECT id, n, 'c', c - actual, lead FROM f)",
        "SELECT source, count(*) AS n, round(avg(err), 4) AS bias, round(avg(abs(err) / lead), 4) AS relative FROM u GROUP BY source",
    ),
    "miss_bands": Statement(
        f"{_FORECASTS}, g AS (SELECT *, err > 0.10 * lead AS early_bus, err < -0.10 * lead AS late_bus, abs(err) > greatest(600, 0.5 * lead) AS gross, "
        "abs(err) <= greatest(60, 0.05 * lead) AS band_b, abs(err) <= CASE WHEN lead >= 1800 THEN 180 WHEN lead >= 1200 THEN 120 ELSE 60 END AS pass FROM f)",
        "SELECT route, CASE WHEN gross THEN 'gross' WHEN early_bus THEN 'early' WHEN late_bus THEN 'late' ELSE 'fine' END AS direction, count(*) AS n, count_if(band_b) AS band_b, count_if(pass) AS passed "
        "FROM g GROUP BY route, CASE WHEN gross THEN 'gross' WHEN early_bus THEN 'early' WHEN late_bus THEN 'late' ELSE 'fine' END",
    ),
    "weather_flags": Statement(
        "w AS (SELECT event_id, stop AS code, value / 100 AS rain, k AS vis FROM {e})",
        "SELECT event_id, CASE WHEN rain > 0 OR contains(code, 'err') THEN 1 ELSE 0 END AS precip, CASE WHEN contains(upper(code), 'SIGN') THEN 1 ELSE 0 END AS snow, "
        "CASE WHEN rain >= 0.3 OR vis < 5 THEN 'heavy' WHEN rain >= 0.05 THEN 'light' ELSE 'dry' END AS class FROM w",
    ),
    "region_boxes": Statement(
        "b AS (SELECT * FROM (VALUES (1, 0, 30, 0, 50), (2, 20, 60, 0, 60), (3, 0, 100, 40, 100)) AS v(region, y0, y1, x0, x1)), p AS (SELECT event_id, value AS y, k AS x FROM {e})",
        "SELECT event_id, min(region) AS region FROM p LEFT JOIN b ON y >= y0 AND y < y1 AND x >= x0 AND x < x1 GROUP BY event_id",
    ),
    "staleness_levels": Statement(
        "a AS (SELECT veh, max(t) AS seen FROM {e} GROUP BY veh), m AS (SELECT max(seen) AS now FROM a)",
        "SELECT veh, CASE WHEN now - seen > 86400 THEN 'err' WHEN now - seen > 43200 THEN 'old' WHEN now - seen > 7200 THEN 'late' ELSE 'fresh' END AS level FROM a JOIN m ON TRUE",
    ),
    "outside_listed_hours": Statement(
        "h AS (SELECT * FROM (VALUES (0, 21600, 36000), (0, 54000, 68400), (1, 0, 43200), (2, 30000, 80000)) AS v(line, a, b)), "
        "c AS (SELECT event_id, veh % 3 AS line, t % 86400 AS clock FROM {e}), i AS (SELECT DISTINCT event_id FROM c JOIN h ON c.line = h.line AND clock >= a - 600 AND clock <= b + 900)",
        "SELECT c.event_id FROM c LEFT JOIN i ON c.event_id = i.event_id WHERE i.event_id IS NULL",
    ),
    "active_alerts": Statement(
        "a AS (SELECT event_id AS alert, CASE WHEN k % 4 > 0 THEN t END AS since, CASE WHEN k % 4 < 3 THEN t + 60 * k END AS until FROM {e} WHERE stop = 'error'), "
        "q AS (SELECT * FROM (VALUES (1704500000), (1705000000), (1706000000)) AS v(now))",
        "SELECT now, count(*) AS active FROM q JOIN a ON (since IS NULL OR since <= now) AND (until IS NULL OR until > now) GROUP BY now",
    ),
    # Joins.
    "hourly_context": Statement(
        f"g AS (SELECT {_HOUR} * 3600 AS hour, avg(value) AS mean FROM {{e}} WHERE stop = 'view' GROUP BY {_HOUR} * 3600), q AS (SELECT event_id, {_HOUR} * 3600 AS hour FROM {{e}} WHERE stop = 'purchase')",
        "SELECT event_id, round(mean, 4) AS mean FROM q LEFT JOIN g ON q.hour = g.hour",
    ),
    "typical_by_hour_of_week": Statement(
        f"x AS (SELECT event_id, veh % 10 AS region, {_DOW} AS dow, {_HOUR} % 24 AS hour, value FROM {{e}}), m AS (SELECT region, dow, hour, median(value) AS usual, count(*) AS n FROM x GROUP BY region, dow, hour)",
        "SELECT event_id, round(value / nullif(usual, 0), 4) AS ratio, n FROM x JOIN m ON x.region = m.region AND x.dow = m.dow AND x.hour = m.hour",
    ),
    "hidden_left_out": Statement(
        "h AS (SELECT veh FROM {e} GROUP BY veh HAVING count_if(stop = 'error') * 4 > count(*))",
        "SELECT e.event_id FROM {e} e LEFT JOIN h ON e.veh = h.veh WHERE h.veh IS NULL",
    ),
    "trip_chains": Statement(
        "s AS (SELECT event_id, veh, stop, t, lag(stop) OVER (PARTITION BY veh ORDER BY t, event_id) AS prev, lag(t) OVER (PARTITION BY veh ORDER BY t, event_id) AS prev_t FROM {e}), "
        "u AS (SELECT veh, stop, t, max(event_id) AS event_id FROM s GROUP BY veh, stop, t)",
        "SELECT b.event_id, a.event_id AS before FROM s b JOIN u a ON a.veh = b.veh AND a.stop = b.prev AND a.t = b.prev_t",
    ),
    "common_rows_of_three": Statement(
        "a AS (SELECT veh, stop, avg(value) AS va FROM {e} WHERE k < 40 GROUP BY veh, stop), b AS (SELECT veh, stop, avg(value) AS vb FROM {e} WHERE k >= 30 AND k < 80 GROUP BY veh, stop), c AS (SELECT veh, stop, avg(value) AS vc FROM {e} WHERE k >= 60 GROUP BY veh, stop)",
        "SELECT a.stop, count(*) AS n, round(avg(abs(va - vc)), 4) AS a_off, round(avg(abs(vb - vc)), 4) AS b_off FROM a JOIN b ON a.veh = b.veh AND a.stop = b.stop JOIN c ON a.veh = c.veh AND a.stop = c.stop GROUP BY a.stop",
    ),
    # Statistics.
    "offset_stability": Statement(
        f"h AS (SELECT veh, stop, {_DAY} % 2 AS half, value FROM {{e}}), m AS (SELECT veh, stop, half, median(value) AS med, count(*) AS n FROM h GROUP BY veh, stop, half), "
        "p AS (SELECT a.stop, a.med AS x, b.med AS y FROM m a JOIN m b ON a.veh = b.veh AND a.stop = b.stop WHERE a.half = 0 AND b.half = 1 AND a.n >= 3 AND b.n >= 3)",
        "SELECT stop, count(*) AS n, round(corr(x, y), 4) AS r FROM p GROUP BY stop HAVING count(*) >= 3",
    ),
    "ratio_bias": Statement(
        "x AS (SELECT l_suppkey AS route, (l_extendedprice / 1000) / l_quantity AS ratio FROM {lineitem} WHERE l_quantity >= 1), m AS (SELECT route, count(*) AS n, median(ratio) AS m FROM x GROUP BY route)",
        "SELECT route, n, round(m, 4) AS m FROM m WHERE n >= 30 AND m BETWEEN 0.5 AND 2",
    ),
    "clocks_by_day_type": Statement(
        f"x AS (SELECT stop, CASE WHEN {_DOW} >= 5 THEN 'weekend' ELSE 'weekday' END AS type, t % 86400 AS clock, {_DAY} AS day FROM {{e}})",
        "SELECT stop, type, count(DISTINCT day) AS days, round({p}(clock, 0.1), 1) AS p10, round({p}(clock, 0.5), 1) AS p50, round({p}(clock, 0.9), 1) AS p90 FROM x GROUP BY stop, type",
    ),
    "weekday_spread": Statement(
        f"x AS (SELECT stop, {_DOW} AS dow, value FROM {{e}}), d AS (SELECT stop, dow, median(value) AS med, {{p}}(value, 0.25) AS lo, {{p}}(value, 0.75) AS hi FROM x GROUP BY stop, dow), "
        "r AS (SELECT k.stop, k.dow, median(x.value) AS med, {p}(x.value, 0.25) AS lo, {p}(x.value, 0.75) AS hi FROM d k JOIN x ON x.stop = k.stop AND x.dow <> k.dow GROUP BY k.stop, k.dow)",
        "SELECT d.stop, d.dow, round(d.med - r.med, 4) AS apart, CASE WHEN d.lo > r.hi OR d.hi < r.lo THEN 'separate' WHEN abs(d.med - r.med) > (r.hi - r.lo) / 4 THEN 'shifted' ELSE 'alike' END AS verdict "
        "FROM d JOIN r ON d.stop = r.stop AND d.dow = r.dow",
    ),
    "trend_labels": Statement(
        f"w AS (SELECT veh % 20 AS line, CAST(floor(t / 604800) AS BIGINT) AS wk, avg(CASE WHEN value > 50 THEN 1e2 ELSE 0e0 END) AS share, count(*) AS n FROM {{e}} GROUP BY veh % 20, CAST(floor(t / 604800) AS BIGINT))",
        "SELECT a.line, a.wk, round(a.share, 4) AS share, CASE WHEN b.share IS NULL OR a.n < 20 OR b.n < 20 THEN 'unknown' WHEN a.share - b.share >= 2 AND a.share >= 1.2 * b.share THEN 'worse' "
        "WHEN b.share - a.share >= 2 AND a.share <= 0.8 * b.share THEN 'better' ELSE 'steady' END AS trend FROM w a LEFT JOIN w b ON b.line = a.line AND b.wk = a.wk - 1",
    ),
    "densest_shift": Statement(
        "x AS (SELECT DISTINCT veh % 30 AS route, CAST(round(value) AS BIGINT) AS s FROM {e}), c AS (SELECT veh % 30 AS route, CAST(round(value) AS BIGINT) AS s, count(*) AS n FROM {e} GROUP BY veh % 30, CAST(round(value) AS BIGINT)), "
        "d AS (SELECT x.route, x.s, sum(c.n) AS held FROM x JOIN c ON c.route = x.route AND c.s BETWEEN x.s AND x.s + 10 GROUP BY x.route, x.s), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY held DESC, abs(s), s) AS o FROM d)",
        "SELECT route, s AS shift, CAST(held AS BIGINT) AS held FROM r WHERE o = 1",
    ),
    "table_profile": Statement(
        "",
        f"SELECT stop, count(*) AS n, count(DISTINCT veh) AS vehicles, count(DISTINCT {_DAY}) AS days, min(t) AS first_t, max(t) AS last_t, count_if({_HOUR} % 24 < 6) AS night, count_if({_DOW} >= 5) AS weekend FROM {{e}} GROUP BY stop",
    ),
    "leads_covered": Statement(
        "a AS (SELECT event_id, veh, t FROM {e} WHERE stop = 'purchase'), p AS (SELECT veh, t AS made, t + 300 * k AS predicted FROM {e} WHERE stop = 'view'), "
        "j AS (SELECT DISTINCT a.event_id, CAST(floor((a.t - made) / 3600) AS BIGINT) AS lead FROM a JOIN p ON a.veh = p.veh AND made <= a.t AND abs(predicted - a.t) <= 3600)",
        "SELECT event_id, count(*) AS leads, min(lead) AS least FROM j GROUP BY event_id",
    ),
    # Order and sets.
    "visit_ranks": Statement(
        f"x AS (SELECT event_id, veh, stop, t, {_DAY} AS day FROM {{e}})",
        "SELECT event_id, row_number() OVER (PARTITION BY day, veh, stop ORDER BY t, event_id) AS visit FROM x",
    ),
    "order_on_line": Statement(
        f"x AS (SELECT veh % 20 AS line, {_DAY} AS day, veh, min(t) AS first_t FROM {{e}} GROUP BY veh % 20, {_DAY}, veh)",
        "SELECT line, day, veh, row_number() OVER (PARTITION BY line, day ORDER BY first_t, veh) AS place FROM x",
    ),
    "expanding_folds": Statement(
        f"x AS (SELECT event_id, {_DAY} AS day FROM {{e}}), b AS (SELECT min(day) AS lo, max(day) AS hi FROM x), k AS (SELECT * FROM (VALUES (1), (2), (3)) AS v(fold)), "
        "c AS (SELECT fold, lo + CAST(floor((hi - lo) * fold / 4) AS BIGINT) AS cut, lo + CAST(floor((hi - lo) * (fold + 1) / 4) AS BIGINT) AS until FROM b JOIN k ON TRUE)",
        "SELECT fold, count_if(day <= cut) AS train, count_if(day > cut AND day <= until) AS test FROM c JOIN x ON TRUE GROUP BY fold",
    ),
    "archive_and_log": Statement(
        "u AS (SELECT event_id, veh, t, 0 AS origin FROM {e} WHERE k < 60 UNION ALL SELECT event_id, veh, t, 1 FROM {e} WHERE k >= 40), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY origin DESC) AS o FROM u)",
        "SELECT event_id, origin FROM r WHERE o = 1",
    ),
    "days_missing_somewhere": Statement(
        f"a AS (SELECT DISTINCT {_DAY} AS day, veh FROM {{e}} WHERE stop = 'view'), b AS (SELECT DISTINCT {_DAY} AS day, veh FROM {{e}} WHERE stop = 'click'), "
        "x AS (SELECT day, veh FROM a EXCEPT SELECT day, veh FROM b), y AS (SELECT day, veh FROM b EXCEPT SELECT day, veh FROM a), z AS (SELECT day, veh FROM a INTERSECT SELECT day, veh FROM b)",
        "SELECT 'first' AS side, count(*) AS n FROM x UNION ALL SELECT 'second', count(*) FROM y UNION ALL SELECT 'both', count(*) FROM z",
    ),
    "service_calendar": Statement(
        f"d AS (SELECT DISTINCT {_DAY} AS day, {_DOW} AS dow FROM {{e}}), s AS (SELECT * FROM (VALUES ('week', 0, 4), ('sat', 5, 5), ('sun', 6, 6)) AS v(service, lo, hi)), "
        "x AS (SELECT day, CASE WHEN day % 9 = 0 THEN 'week' ELSE 'sun' END AS service, CASE WHEN day % 9 = 0 THEN 2 ELSE 1 END AS kind FROM d WHERE day % 9 = 0 OR day % 11 = 0), "
        "b AS (SELECT day, service FROM d JOIN s ON dow BETWEEN lo AND hi UNION SELECT day, service FROM x WHERE kind = 1)",
        "SELECT b.day, b.service FROM b LEFT JOIN x ON x.day = b.day AND x.service = b.service AND x.kind = 2 WHERE x.day IS NULL",
    ),
    "registry_merge": Statement(
        "o AS (SELECT veh, min(t) AS first_flagged, count(*) AS n FROM {e} WHERE k < 30 GROUP BY veh, stop HAVING count(*) >= 3), p AS (SELECT veh, min(first_flagged) AS first_flagged FROM o GROUP BY veh), "
        "c AS (SELECT veh, min(t) AS first_flagged FROM {e} WHERE k >= 80 AND value > 20 GROUP BY veh)",
        "SELECT coalesce(p.veh, c.veh) AS veh, coalesce(p.first_flagged, c.first_flagged) AS first_flagged, CASE WHEN c.veh IS NULL THEN 'resolved' WHEN p.veh IS NULL THEN 'new' ELSE 'open' END AS status FROM p FULL OUTER JOIN c ON p.veh = c.veh",
    ),
    # Boards, options, places and models.
    "delta_departures": Statement(
        f"x AS (SELECT veh, {_DAY} AS day, t, event_id, t - lag(t) OVER (PARTITION BY veh, {_DAY} ORDER BY t, event_id) AS step, first_value(t) OVER (PARTITION BY veh, {_DAY} ORDER BY t, event_id) AS origin FROM {{e}}), "
        "y AS (SELECT event_id, t, origin + sum(coalesce(step, 0)) OVER (PARTITION BY veh, day ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS decoded, step FROM x)",
        "SELECT event_id, step, CASE WHEN decoded = t THEN 1 ELSE 0 END AS same FROM y",
    ),
    "stop_board": Statement(
        "q AS (SELECT * FROM (VALUES (1704500000), (1705500000)) AS v(now)), a AS (SELECT now, stop, veh % 20 AS route, t, event_id FROM q JOIN {e} ON t >= now - 30 AND t <= now + 86400), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY now, stop ORDER BY t, route, event_id) AS place FROM a)",
        "SELECT now, stop, route, t - now AS due, place FROM r WHERE place <= 8",
    ),
    "options_pruned": Statement(
        "o AS (SELECT o_custkey AS trip, o_orderkey AS id, o_orderkey % 4 AS legs, CAST(round(o_totalprice / 1000) AS BIGINT) AS arrives, o_custkey % 17 AS walk FROM {orders}), "
        "s AS (SELECT *, row_number() OVER (PARTITION BY trip, legs, arrives, walk ORDER BY id) AS copy FROM o), u AS (SELECT * FROM s WHERE copy = 1), "
        "b AS (SELECT DISTINCT x.id FROM u x JOIN u y ON x.trip = y.trip AND y.legs <= x.legs AND y.arrives <= x.arrives AND y.walk <= x.walk AND (y.legs < x.legs OR y.arrives < x.arrives OR y.walk < x.walk)), "
        "k AS (SELECT u.* FROM u LEFT JOIN b ON u.id = b.id WHERE b.id IS NULL)",
        "SELECT trip, id, row_number() OVER (PARTITION BY trip ORDER BY arrives, legs, walk, id) AS place FROM k",
    ),
    "names_resolved": Statement(
        "q AS (SELECT * FROM (VALUES ('red bolt'), ('12'), ('gizmo'), ('small r')) AS v(q)), n AS (SELECT DISTINCT lower(p_name) AS name FROM {part}), "
        "m AS (SELECT q, name, CASE WHEN name = q THEN 0 WHEN {sw}(name, q) THEN 1 WHEN contains(name, q) THEN 2 END AS tier FROM q JOIN n ON contains(name, q)), "
        "t AS (SELECT q, min(tier) AS tier FROM m GROUP BY q), c AS (SELECT m.q, count(*) AS n, min(name) AS name FROM m JOIN t ON m.q = t.q AND m.tier = t.tier GROUP BY m.q)",
        "SELECT q.q, CASE WHEN n = 1 THEN name END AS found, coalesce(n, 0) AS matches FROM q LEFT JOIN c ON q.q = c.q",
    ),
    "covered_places": Statement(
        "s AS (SELECT n_nationkey AS id, 100 * n_nationkey AS x, 40 * n_regionkey AS y FROM {nation}), p AS (SELECT c_custkey AS id, c_custkey * 37 % 3000 AS x, c_custkey * 11 % 400 AS y FROM {customer}), "
        "d AS (SELECT p.id, s.id AS stop, sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) AS m FROM p JOIN s ON s.x BETWEEN p.x - 150 AND p.x + 150), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, stop) AS o FROM d WHERE m <= 150)",
        "SELECT p.id, stop, coalesce(CASE WHEN m <= 60 THEN 'at stop' ELSE 'near' END, 'away') AS zone FROM p LEFT JOIN r ON p.id = r.id AND o = 1",
    ),
    "spots": Statement(
        f"x AS (SELECT CAST(floor(value / 10) AS BIGINT) AS cell, stop, value, t % 86400 AS clock, {_DAY} AS day FROM {{e}})",
        "SELECT cell, count(*) AS n, count(DISTINCT day) AS days, round(avg(value), 4) AS centre, count_if(stop = 'error') AS errors, count_if(stop = 'view') AS views, round({p}(clock, 0.5), 1) AS usual FROM x GROUP BY cell HAVING count(DISTINCT day) >= 3",
    ),
    "listed_minutes_unseen": Statement(
        "h AS (SELECT * FROM (VALUES (0, 28800, 30600), (1, 36000, 37800)) AS v(line, a, b)), m AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS v(i)), "
        "g AS (SELECT line, a + 180 * i AS minute FROM h JOIN m ON a + 180 * i < b), "
        f"d AS (SELECT DISTINCT veh % 2 AS line, {_DAY} AS day FROM {{e}}), r AS (SELECT veh % 2 AS line, {_DAY} AS day, CAST(floor((t % 86400) / 180) AS BIGINT) AS bin, t % 86400 AS clock FROM {{e}}), "
        "q AS (SELECT d.line, day, minute, CAST(floor(minute / 180) AS BIGINT) AS bin FROM d JOIN g ON d.line = g.line), z AS (SELECT line, day, minute, bin FROM q UNION ALL SELECT line, day, minute, bin - 1 FROM q UNION ALL SELECT line, day, minute, bin + 1 FROM q), "
        "f AS (SELECT DISTINCT z.line, z.day, minute FROM z JOIN r ON r.line = z.line AND r.day = z.day AND r.bin = z.bin AND abs(clock - minute) <= 180)",
        "SELECT q.line, q.day, count(*) AS listed, count(*) - count(f.minute) AS unseen FROM q LEFT JOIN f ON f.line = q.line AND f.day = q.day AND f.minute = q.minute GROUP BY q.line, q.day",
    ),
    "collector_holes": Statement(
        "r AS (SELECT CAST(floor(event_id / 500) AS BIGINT) AS run, min(t) AS a, max(t) AS b FROM {e} GROUP BY CAST(floor(event_id / 500) AS BIGINT)), "
        "n AS (SELECT run, a, b, lead(a) OVER (ORDER BY a, run) AS next_a FROM r)",
        "SELECT run, b - a AS length, next_a - b AS hole, CASE WHEN next_a IS NULL THEN 'edge' WHEN next_a <= b THEN 'overlap' WHEN next_a - b <= 600 THEN 'hand-over' ELSE 'hole' END AS kind FROM n",
    ),
    "shrinkage_k": Statement(
        "x AS (SELECT l_suppkey AS s, l_orderkey % 4 AS fold, l_quantity AS y FROM {lineitem}), k AS (SELECT * FROM (VALUES (1), (5), (20), (80)) AS v(k)), g AS (SELECT fold, count(*) AS n, sum(y) AS y FROM x GROUP BY fold), "
        "a AS (SELECT sum(n) AS n, sum(y) AS y FROM g), o AS (SELECT fold, (a.y - g.y) / (a.n - g.n) AS m0 FROM g JOIN a ON TRUE), "
        "p AS (SELECT s, fold, count(*) AS n, sum(y) AS y FROM x GROUP BY s, fold), w AS (SELECT s, sum(n) AS n, sum(y) AS y FROM p GROUP BY s), "
        "c AS (SELECT p.s, p.fold, w.n - p.n AS n, w.y - p.y AS y FROM p JOIN w ON p.s = w.s), "
        "f AS (SELECT k, c.s, c.fold, (c.y + k * m0) / (c.n + k) AS guess FROM c JOIN o ON c.fold = o.fold JOIN k ON TRUE), "
        "z AS (SELECT k, round(avg(abs(x.y - guess)), 6) AS mae FROM x JOIN f ON x.s = f.s AND x.fold = f.fold GROUP BY k), r AS (SELECT *, row_number() OVER (ORDER BY mae, k) AS o FROM z)",
        "SELECT k, mae, CASE WHEN o = 1 THEN 1 ELSE 0 END AS chosen FROM r",
    ),
    "stop_hotspots": Statement(
        "x AS (SELECT stop, veh % 20 AS line, CASE WHEN value > 60 THEN 1 ELSE 0 END AS miss FROM {e}), l AS (SELECT line, avg(miss) AS rate FROM x GROUP BY line)",
        "SELECT stop, x.line, count(*) AS n, CAST(sum(miss) AS BIGINT) AS misses, round(sum(miss) - count(*) * max(rate), 4) AS excess FROM x JOIN l ON x.line = l.line GROUP BY stop, x.line HAVING count(*) >= 20 AND sum(miss) > 1.5 * count(*) * max(rate)",
    ),
    "grid_occupancy": Statement(
        f"c AS (SELECT CAST(floor(value / 5) AS BIGINT) AS x, CAST(floor(k / 5) AS BIGINT) AS y, {_DAY} AS day, veh FROM {{e}}), d AS (SELECT * FROM (VALUES (-1), (0), (1)) AS v(d)), "
        "n AS (SELECT DISTINCT x + a.d AS x, y + b.d AS y, day, veh FROM c JOIN d a ON TRUE JOIN d b ON TRUE)",
        "SELECT x, y, count(*) AS seen FROM n GROUP BY x, y HAVING count(*) >= 20",
    ),
}
