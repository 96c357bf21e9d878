"""Queries that are plain SQL in both engines: one statement each, with the event log as `{e}`."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tramline.sources.tables import events, table

#: The event log for the oracle, in the roles that events() gives it.
LOG = (
    "e AS (SELECT event_id, user_id AS veh, event_type AS stop, value, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS t, "
    "CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"
)
OTHER = ("lineitem", "orders", "customer", "nation", "region", "part", "supplier", "documents", "conversations")


@dataclass(frozen=True)
class Statement:
    """Common table expressions and a select. {p}, {sw} and {ud} stand for names that differ."""

    ctes: str
    select: str

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        text = f"WITH {self.ctes} {self.select}" if self.ctes else self.select
        text = text.replace("{p}", "percentile").replace("{sw}", "startswith").replace("{ud}", "unix_date(")
        used = {n: table(spark, sf_dir, n) for n in OTHER if "{" + n + "}" in text}
        if "{e}" in text:
            used["e"] = events(spark, sf_dir)
        return spark.sql(text, **used)

    def oracle(self) -> str:
        text = f"{LOG}, {self.ctes}" if self.ctes else LOG
        text = f"WITH {text} {self.select}".replace("{p}", "quantile_cont").replace("{e}", "e")
        text = text.replace("{sw}", "starts_with").replace("{ud}", "date_diff('day', DATE '1970-01-01', ")
        for n in OTHER:
            text = text.replace("{" + n + "}", n)
        return text


_BIN = "CAST(floor(t / 600) AS BIGINT)"

STATEMENTS = {
    # Scoring: leads, errors and passes. A forecast is a view's value for the next purchase of the same user.
    "pass_rates": Statement(
        "f AS (SELECT o_orderkey AS id, CAST(o_custkey % 40 AS BIGINT) AS route, CAST(o_orderkey % 2700 AS BIGINT) AS lead, "
        "CAST(round(o_totalprice) AS BIGINT) % 900 - 450 AS err FROM {orders}), "
        "g AS (SELECT *, CASE WHEN lead >= 1800 THEN 180 WHEN lead >= 1200 THEN 120 ELSE 60 END AS tol FROM f)",
        "SELECT route, count(*) AS n, count_if(abs(err) <= tol) AS pass_shrink, count_if(abs(err) <= 0.10 * lead) AS pass_ten, "
        "count_if(err > 0.01 * lead) AS too_late, count_if(abs(err) > greatest(600, 0.5 * lead)) AS gross, round(avg(abs(err)), 4) AS mae FROM g GROUP BY route",
    ),
    "late_bins": Statement(
        "f AS (SELECT o_orderkey AS id, CAST(o_orderkey % 2700 AS BIGINT) AS lead, CAST(round(o_totalprice) AS BIGINT) % 900 - 450 AS err FROM {orders}), "
        "b AS (SELECT * FROM (VALUES ('0-10', 0, 600), ('0-6', 0, 360), ('6-10', 360, 600), ('10-15', 600, 900), ('15-20', 900, 1200), ('20-30', 1200, 1800), ('30-45', 1800, 2700)) AS v(bin, lo, hi))",
        "SELECT bin, count(*) AS n, count_if(err > 0) AS late, round({p}(err, 0.5), 4) AS med, round({p}(err, 0.9), 4) AS p90 FROM f JOIN b ON lead >= lo AND lead < hi GROUP BY bin",
    ),
    "representative_rows": Statement(
        "f AS (SELECT *, CAST(floor(l_quantity / 10) AS BIGINT) AS bin, abs(l_quantity - (floor(l_quantity / 10) * 10 + 5)) AS off FROM {lineitem}), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, bin, l_partkey % 10 ORDER BY off, l_orderkey, l_linenumber) AS o FROM f)",
        "SELECT l_suppkey, bin, l_partkey % 10 AS grp, l_orderkey, l_linenumber FROM r WHERE o = 1",
    ),
    "summary_grouping_sets": Statement(
        "f AS (SELECT n_name, c_mktsegment, o_totalprice, o_custkey, o_orderkey FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey)",
        "SELECT coalesce(n_name, 'ALL') AS route, coalesce(c_mktsegment, 'all') AS segment, count(*) AS n, count(DISTINCT o_custkey) AS covered, round(avg(o_totalprice), 2) AS mean "
        "FROM f GROUP BY GROUPING SETS ((), (n_name), (c_mktsegment))",
    ),
    "rollup_ratio_to_all": Statement(
        "f AS (SELECT n_name, o_orderstatus FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey), "
        "g AS (SELECT n_name, count(*) AS n, count_if(o_orderstatus = 'F') AS bad FROM f GROUP BY ROLLUP (n_name)), "
        "a AS (SELECT n AS all_n, bad AS all_bad FROM g WHERE n_name IS NULL)",
        "SELECT n_name AS route, n, bad, round((bad / n) / nullif(all_bad / all_n, 0), 4) AS ratio, round(bad - n * (all_bad / all_n), 4) AS excess FROM g JOIN a ON TRUE WHERE n_name IS NOT NULL",
    ),
    "graded_flags": Statement(
        "g AS (SELECT veh, CAST(floor(t / 86400) AS BIGINT) AS day, count(*) AS n, count_if(stop = 'error') AS bad FROM {e} GROUP BY veh, CAST(floor(t / 86400) AS BIGINT)), "
        "s AS (SELECT veh, sum(n) AS n, sum(bad) AS bad, count_if(bad >= 1) AS days FROM g GROUP BY veh), a AS (SELECT sum(bad) / sum(n) AS rate FROM s)",
        "SELECT veh, CAST(n AS BIGINT) AS n, CAST(bad AS BIGINT) AS bad, CAST(days AS BIGINT) AS days, "
        "CASE WHEN n < 20 THEN 'thin' WHEN bad / n >= 2 * rate AND days >= 3 THEN 'high' WHEN bad / n >= 1.25 * rate THEN 'medium' ELSE 'low' END AS grade FROM s JOIN a ON TRUE",
    ),
    "dimension_slices": Statement(
        "f AS (SELECT veh % 7 AS line, stop AS kind, CAST(floor(t / 3600) AS BIGINT) % 24 AS hour, CASE WHEN value > 60 THEN 1 ELSE 0 END AS miss FROM {e}), "
        "u AS (SELECT line, 'kind' AS dim, kind AS level, miss FROM f UNION ALL SELECT line, 'hour', CAST(hour AS VARCHAR(8)), miss FROM f), "
        "b AS (SELECT line, avg(miss) AS base FROM f GROUP BY line)",
        "SELECT u.line, dim, level, count(*) AS n, CAST(sum(miss) AS BIGINT) AS misses, round(avg(miss) / nullif(max(base), 0), 4) AS lift FROM u JOIN b ON u.line = b.line GROUP BY u.line, dim, level",
    ),
    "rank_sum": Statement(
        "g AS (SELECT veh, count(*) AS n, sum(value) AS total, max(value) AS top FROM {e} GROUP BY veh), "
        "r AS (SELECT veh, row_number() OVER (ORDER BY n DESC, veh) + row_number() OVER (ORDER BY round(total, 6) DESC, veh) + row_number() OVER (ORDER BY top DESC, veh) AS ranks FROM g)",
        "SELECT veh, CAST(ranks AS BIGINT) AS ranks FROM r",
    ),
    # Grouped statistics.
    "group_median_mad": Statement(
        "m AS (SELECT l_suppkey, median(l_extendedprice) AS med FROM {lineitem} GROUP BY l_suppkey)",
        "SELECT l.l_suppkey, count(*) AS n, round(max(med), 4) AS med, round(1.4826 * median(abs(l_extendedprice - med)), 4) AS mad FROM {lineitem} l JOIN m ON l.l_suppkey = m.l_suppkey GROUP BY l.l_suppkey",
    ),
    "lognormal_fit": Statement(
        "x AS (SELECT l_partkey % 100 AS seg, ln(greatest(l_quantity, 3)) AS y FROM {lineitem}), m AS (SELECT seg, median(y) AS mu FROM x GROUP BY seg)",
        "SELECT x.seg, count(*) AS n, round(max(mu), 6) AS mu, CASE WHEN count(*) >= 3 THEN round(1.4826 * median(abs(y - mu)), 6) END AS sigma FROM x JOIN m ON x.seg = m.seg GROUP BY x.seg",
    ),
    "harmonic_speed": Statement(
        "",
        "SELECT l_suppkey, CASE WHEN sum(l_quantity) > 0 THEN round(sum(l_extendedprice) / sum(l_quantity), 4) END AS speed FROM {lineitem} GROUP BY l_suppkey",
    ),
    "quantile_grid": Statement(
        "",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, round({p}(l_extendedprice, 0.1), 4) AS p10, round({p}(l_extendedprice, 0.5), 4) AS p50, round({p}(l_extendedprice, 0.9), 4) AS p90 FROM {lineitem} GROUP BY l_returnflag, l_linestatus",
    ),
    "pinball_coverage": Statement(
        "q AS (SELECT l_suppkey, {p}(l_extendedprice, 0.1) AS lo, {p}(l_extendedprice, 0.9) AS hi FROM {lineitem} WHERE l_linenumber % 2 = 1 GROUP BY l_suppkey), "
        "t AS (SELECT l.l_suppkey, l_extendedprice AS y, lo, hi FROM {lineitem} l JOIN q ON l.l_suppkey = q.l_suppkey WHERE l_linenumber % 2 = 0)",
        "SELECT l_suppkey, count(*) AS n, round(avg(greatest(1e-1 * (y - lo), 9e-1 * (lo - y))), 4) AS pin10, round(avg(greatest(9e-1 * (y - hi), 1e-1 * (hi - y))), 4) AS pin90, "
        "round(avg(CASE WHEN y BETWEEN lo AND hi THEN 1e0 ELSE 0e0 END), 4) AS covered FROM t GROUP BY l_suppkey",
    ),
    "error_measures": Statement(
        "f AS (SELECT l_returnflag AS g, l_quantity AS y, l_tax * 500 AS p FROM {lineitem})",
        "SELECT g, round(avg(abs(p - y)), 4) AS mae, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(avg(abs(p - y) / greatest(y, 10)), 4) AS mape FROM f GROUP BY g",
    ),
    "multi_level_stats": Statement(
        "f AS (SELECT veh % 10 AS route, stop AS seg, CAST(floor(t / 21600) AS BIGINT) % 4 AS dp, value FROM {e})",
        "SELECT route, seg, dp, count(*) AS n, round(median(value), 4) AS med FROM f GROUP BY GROUPING SETS ((route, dp), (seg), (seg, dp), ())",
    ),
    "shrunk_levels": Statement(
        "f AS (SELECT n_regionkey AS r, n_nationkey AS n, c_mktsegment AS s, c_acctbal AS v FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey), "
        "g0 AS (SELECT avg(v) AS m0 FROM f), g1 AS (SELECT r, count(*) AS c1, avg(v) AS m1 FROM f GROUP BY r), g2 AS (SELECT r, n, count(*) AS c2, avg(v) AS m2 FROM f GROUP BY r, n), "
        "g3 AS (SELECT r, n, s, count(*) AS c3, avg(v) AS m3 FROM f GROUP BY r, n, s), "
        "b AS (SELECT g3.r, g3.n, s, c3, c2, c1, m3, m2, m1, m0 FROM g3 JOIN g2 ON g3.r = g2.r AND g3.n = g2.n JOIN g1 ON g3.r = g1.r JOIN g0 ON TRUE), "
        "x AS (SELECT *, c1 / (c1 + 5.0) * m1 + 5.0 / (c1 + 5.0) * m0 AS s1 FROM b), y AS (SELECT *, c2 / (c2 + 5.0) * m2 + 5.0 / (c2 + 5.0) * s1 AS s2 FROM x)",
        "SELECT r, n, s, c3, round(c3 / (c3 + 5.0) * m3 + 5.0 / (c3 + 5.0) * s2, 4) AS shrunk FROM y",
    ),
    "shrunk_bias": Statement(
        "f AS (SELECT l_suppkey AS stop, l_suppkey % 10 AS route, l_extendedprice - 1000 * l_quantity AS err FROM {lineitem}), "
        "a AS (SELECT median(err) AS m0 FROM f), r AS (SELECT route, count(*) AS c, median(err) AS m FROM f GROUP BY route), s AS (SELECT route, stop, count(*) AS c, median(err) AS m FROM f GROUP BY route, stop), "
        "q AS (SELECT route, r.c / (r.c + 20.0) * m + 20.0 / (r.c + 20.0) * m0 AS rm FROM r JOIN a ON TRUE)",
        "SELECT s.route, stop, s.c AS n, round(s.c / (s.c + 20.0) * m + 20.0 / (s.c + 20.0) * rm, 4) AS bias FROM s JOIN q ON s.route = q.route",
    ),
    "fallback_levels": Statement(
        "f AS (SELECT l_partkey AS a, l_suppkey AS b, l_quantity AS v FROM {lineitem}), x AS (SELECT a, b, count(*) AS n, avg(v) AS m FROM f GROUP BY a, b HAVING count(*) >= 3), "
        "y AS (SELECT a, count(*) AS n, avg(v) AS m FROM f GROUP BY a HAVING count(*) >= 20), z AS (SELECT avg(v) AS m FROM f), k AS (SELECT DISTINCT a, b FROM f)",
        "SELECT k.a, k.b, round(coalesce(x.m, y.m, z.m), 4) AS m, CASE WHEN x.m IS NOT NULL THEN 2 WHEN y.m IS NOT NULL THEN 1 ELSE 0 END AS level FROM k LEFT JOIN x ON k.a = x.a AND k.b = x.b LEFT JOIN y ON k.a = y.a JOIN z ON TRUE",
    ),
    "mode_min_n": Statement(
        "c AS (SELECT veh, stop, count(*) AS n FROM {e} GROUP BY veh, stop), r AS (SELECT *, row_number() OVER (PARTITION BY veh ORDER BY n DESC, stop) AS o FROM c)",
        "SELECT veh, stop, n FROM r WHERE o = 1 AND n >= 3",
    ),
    "rolling_origin_bias": Statement(
        "f AS (SELECT CAST(floor(t / 604800) AS BIGINT) AS wk, stop, value FROM {e}), d AS (SELECT DISTINCT wk, stop FROM f)",
        "SELECT d.wk, d.stop, count(*) AS n, round(median(value), 4) AS bias FROM d JOIN f ON f.stop = d.stop AND f.wk < d.wk GROUP BY d.wk, d.stop HAVING count(*) >= 5",
    ),
    "volume_vs_reference_days": Statement(
        "d AS (SELECT {ud}CAST(o_orderdate AS DATE)) AS day, count(*) AS n FROM {orders} GROUP BY {ud}CAST(o_orderdate AS DATE))), "
        "p AS (SELECT a.day, a.n, b.n AS ref FROM d a JOIN d b ON b.day >= a.day - 28 AND b.day < a.day AND (a.day - b.day) % 7 = 0)",
        "SELECT CAST(day AS BIGINT) AS day, max(n) AS n, count(*) AS refs, round(max(n) / median(ref), 4) AS share FROM p GROUP BY day HAVING count(*) >= 3",
    ),
    # Sequences and episodes.
    "session_islands": Statement(
        "s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY veh ORDER BY t, event_id) <= 1800 THEN 0 ELSE 1 END AS new FROM {e}), "
        "i AS (SELECT *, sum(new) OVER (PARTITION BY veh ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM s)",
        "SELECT veh, CAST(g AS BIGINT) AS g, min(t) AS a, max(t) AS b, count(*) AS n FROM i GROUP BY veh, g",
    ),
    "session_two_pass": Statement(
        "s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY veh ORDER BY t, event_id) <= 3600 THEN 0 ELSE 1 END AS new FROM {e}), "
        "i AS (SELECT *, sum(new) OVER (PARTITION BY veh ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM s), "
        "h AS (SELECT veh, g, min(t) AS a, max(t) AS b, count(*) AS n FROM i GROUP BY veh, g HAVING count(*) >= 2), "
        "u AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY veh ORDER BY a) <= 14400 THEN 0 ELSE 1 END AS nu FROM h), "
        "v AS (SELECT *, sum(nu) OVER (PARTITION BY veh ORDER BY a ROWS UNBOUNDED PRECEDING) AS shift FROM u)",
        "SELECT veh, CAST(shift AS BIGINT) AS shift, min(a) AS a, max(b) AS b, CAST(sum(n) AS BIGINT) AS n, count(*) AS stints FROM v GROUP BY veh, shift",
    ),
    "lag_duplicate_count": Statement(
        "s AS (SELECT *, t - lag(t) OVER (PARTITION BY veh, stop ORDER BY t, event_id) AS gap FROM {e})",
        "SELECT stop, count(*) AS n, count_if(gap <= 900) AS repeats FROM s GROUP BY stop",
    ),
    "same_stop_repeats": Statement(
        "s AS (SELECT *, lag(stop) OVER (PARTITION BY veh ORDER BY t, event_id) AS before, t - lag(t) OVER (PARTITION BY veh ORDER BY t, event_id) AS gap FROM {e})",
        "SELECT event_id FROM s WHERE before = stop AND gap <= 7200",
    ),
    "bin_episodes": Statement(
        f"b AS (SELECT veh, {_BIN} AS bin, count(*) AS n, count_if(value > 50) AS odd FROM {{e}} GROUP BY veh, {_BIN}), h AS (SELECT veh, bin, n FROM b WHERE odd * 2 >= n), "
        "s AS (SELECT *, CASE WHEN bin - lag(bin) OVER (PARTITION BY veh ORDER BY bin) <= 12 THEN 0 ELSE 1 END AS new FROM h), i AS (SELECT *, sum(new) OVER (PARTITION BY veh ORDER BY bin ROWS UNBOUNDED PRECEDING) AS g FROM s)",
        "SELECT veh, min(bin) AS first_bin, max(bin) AS last_bin, count(*) AS bins, CAST(sum(n) AS BIGINT) AS n FROM i GROUP BY veh, g HAVING count(*) >= 2",
    ),
    "interval_union_coverage": Statement(
        "x AS (SELECT veh % 10 AS line, t AS a, t + 900 + k AS b FROM {e}), "
        "m AS (SELECT *, max(b) OVER (PARTITION BY line ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x), "
        "s AS (SELECT *, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY line ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m), u AS (SELECT line, g, min(a) AS a, max(b) AS b FROM s GROUP BY line, g)",
        "SELECT line, count(*) AS spans, CAST(sum(b - a) AS BIGINT) AS covered, max(b) - min(a) AS total FROM u GROUP BY line",
    ),
    "exposure_minutes": Statement(
        "s AS (SELECT veh, least(60, coalesce(lead(t) OVER (PARTITION BY veh ORDER BY t, event_id) - t, 60)) AS stands FROM {e})",
        "SELECT veh, CAST(sum(stands) AS BIGINT) AS exposure FROM s GROUP BY veh",
    ),
    "running_max_late_rows": Statement(
        "s AS (SELECT event_id, t + (k % 7) * 3000 AS u, CAST(floor(event_id / 1000) AS BIGINT) AS file FROM {e}), "
        "m AS (SELECT *, max(u) OVER (PARTITION BY file ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS top FROM s)",
        "SELECT event_id, top - u AS late FROM m WHERE top - u > 7200",
    ),
    "missing_slot_runs": Statement(
        f"p AS (SELECT DISTINCT veh % 5 AS line, {_BIN} AS slot FROM {{e}}), "
        "n AS (SELECT line, slot, lag(slot) OVER (PARTITION BY line ORDER BY slot) AS before FROM p)",
        "SELECT line, before + 1 AS first_slot, slot - before - 1 AS missing FROM n WHERE slot - before - 1 >= 2",
    ),
    "interpolate_gaps": Statement(
        "x AS (SELECT veh, event_id, t, CASE WHEN k % 3 = 0 THEN value END AS v FROM {e}), "
        "y AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN t END) OVER (PARTITION BY veh ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS t0, "
        "min(CASE WHEN v IS NOT NULL THEN t END) OVER (PARTITION BY veh ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM x), "
        "k AS (SELECT veh, t, avg(v) AS v FROM x WHERE v IS NOT NULL GROUP BY veh, t)",
        "SELECT y.event_id, round(CASE WHEN t1 = t0 THEN a.v ELSE a.v + (b.v - a.v) * (y.t - t0) / nullif(t1 - t0, 0) END, 4) AS filled FROM y JOIN k a ON a.veh = y.veh AND a.t = t0 JOIN k b ON b.veh = y.veh AND b.t = t1",
    ),
    "trailing_30m_log_median": Statement(
        # Rows meet on bins as wide as the window, so no line's rows are all paired.
        "d AS (SELECT event_id, veh % 20 AS line, t, ln(value + 1) AS y, CAST(floor(t / 1800) AS BIGINT) AS bin FROM {e}), "
        "a AS (SELECT event_id, line, t, bin FROM d UNION ALL SELECT event_id, line, t, bin - 1 FROM d)",
        "SELECT a.event_id, count(*) AS n, round(median(b.y), 6) AS med FROM a JOIN d b ON a.line = b.line AND a.bin = b.bin AND b.t >= a.t - 1800 AND b.t < a.t GROUP BY a.event_id",
    ),
    "headways": Statement(
        "h AS (SELECT stop, t - lag(t) OVER (PARTITION BY stop, veh % 10 ORDER BY t, event_id) AS gap FROM {e})",
        "SELECT stop, count(gap) AS n, round(median(gap), 1) AS headway FROM h GROUP BY stop",
    ),
    "time_clusters_windows": Statement(
        "c AS (SELECT stop, veh % 5 AS line, t % 86400 AS clock, CAST(floor(t / 86400) AS BIGINT) AS day FROM {e}), "
        "s AS (SELECT *, CASE WHEN clock - lag(clock) OVER (PARTITION BY stop, line ORDER BY clock, day) <= 120 THEN 0 ELSE 1 END AS new FROM c), "
        "i AS (SELECT *, sum(new) OVER (PARTITION BY stop, line ORDER BY clock, day ROWS UNBOUNDED PRECEDING) AS g FROM s)",
        "SELECT stop, line, CAST(g AS BIGINT) AS g, min(clock) - 60 AS lo, max(clock) + 60 AS hi, count(DISTINCT day) AS days, count(*) AS n FROM i GROUP BY stop, line, g HAVING count(DISTINCT day) >= 3",
    ),
    # Text, versions and small graphs.
    "version_merge_hash": Statement(
        "h AS (SELECT doc_id, lang, substr(sha1(lower(trim(text))), 1, 12) AS version FROM {documents})",
        "SELECT version, min(doc_id) AS first_seen, max(doc_id) AS last_seen, count(*) AS sightings, count(DISTINCT lang) AS langs FROM h GROUP BY version",
    ),
    "search_tiers": Statement(
        "q AS (SELECT * FROM (VALUES ('blue'), ('steel'), ('a'), ('part 12')) AS v(q)), "
        "s AS (SELECT q, p_partkey, p_name, CASE WHEN lower(p_name) = q THEN 4 WHEN {sw}(lower(p_name), q) THEN 3 WHEN contains(lower(p_name), concat(' ', q)) THEN 2 WHEN contains(lower(p_name), q) THEN 1 ELSE 0 END AS tier FROM {part} JOIN q ON TRUE), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tier DESC, length(p_name), p_partkey) AS o FROM s WHERE tier > 0)",
        "SELECT q, p_partkey, tier, o FROM r WHERE o <= 20",
    ),
    "two_leg_plan": Statement(
        "l AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b, CAST(min(l_quantity) AS BIGINT) AS ride FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey "
        "GROUP BY c_nationkey, s_nationkey), "
        "d AS (SELECT a, b, ride AS cost, 0 AS changes, -1 AS via FROM l), x AS (SELECT p.a, q.b, p.ride + q.ride + 5 AS cost, 1 AS changes, p.b AS via FROM l p JOIN l q ON p.b = q.a AND p.a <> q.b AND p.b <> p.a AND q.a <> q.b), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY cost, changes, via) AS o FROM (SELECT * FROM d UNION ALL SELECT * FROM x) u)",
        "SELECT a, b, cost, changes, via FROM r WHERE o = 1",
    ),
    "rule_audit": Statement(
        "r AS (SELECT count_if(l_quantity <= 0) AS bad_quantity, count_if(l_discount > 0.09) AS high_discount, count_if(l_tax < 0 OR l_tax > 0.08) AS bad_tax, count_if(l_extendedprice / l_quantity > 2000) AS dear FROM {lineitem})",
        "SELECT 'bad_quantity' AS rule, bad_quantity AS n FROM r UNION ALL SELECT 'high_discount', high_discount FROM r UNION ALL SELECT 'bad_tax', bad_tax FROM r UNION ALL SELECT 'dear', dear FROM r",
    ),
    "alias_unique": Statement(
        "a AS (SELECT split_part(c_name, '#', 1) AS alias, c_nationkey % 3 AS x, c_custkey FROM {customer} UNION ALL SELECT substr(c_mktsegment, 1, 4), c_nationkey, c_custkey FROM {customer}), "
        "u AS (SELECT alias, x FROM a GROUP BY alias, x HAVING count(DISTINCT c_custkey) = 1)",
        "SELECT a.alias, a.x, a.c_custkey FROM a JOIN u ON a.alias = u.alias AND a.x = u.x",
    ),
    "first_match_regime": Statement(
        "c AS (SELECT * FROM (VALUES (1, 9000, 9050), (2, 9020, 10400), (3, 0, 99999)) AS v(prio, lo, hi)), d AS (SELECT o_orderkey, {ud}CAST(o_orderdate AS DATE)) AS day FROM {orders}), "
        "r AS (SELECT o_orderkey, prio, row_number() OVER (PARTITION BY o_orderkey ORDER BY prio) AS o FROM d JOIN c ON day BETWEEN lo AND hi)",
        "SELECT o_orderkey, prio FROM r WHERE o = 1",
    ),
    "numeric_aware_ids": Statement(
        "x AS (SELECT DISTINCT CASE WHEN veh % 3 = 0 THEN concat('R', CAST(veh AS VARCHAR(9))) ELSE CAST(veh AS VARCHAR(9)) END AS id FROM {e})",
        "SELECT id, row_number() OVER (ORDER BY CASE WHEN {sw}(id, 'R') THEN 1 ELSE 0 END, CASE WHEN {sw}(id, 'R') THEN 0 ELSE CAST(id AS BIGINT) END, id) AS o FROM (SELECT id FROM x) y".replace(
            "CAST(id AS BIGINT)", "try_cast(id AS BIGINT)"
        ),
    ),
}
