"""The forecast table: for each minute before an arrival, what was on display for it, and how far off it was.

Every arrival is spread over the minutes from which it lies within the horizon, so nothing is joined on time ranges. What was on display, the visit before and the last
arrival are as-of joins, cut along their keys. On a line that meets a stop twice (a loop) a forecast counts for the visit whose place in the
order it names, and a forecast that can only be about an earlier lap is told apart.

Shuffled rows are narrow and take some ten times their bytes where they are sorted, so tasks are dealt by the number of rows and each sorts once between two shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.operators.cuts import running
from tramline.operators.joins import asof
from tramline.operators.lineage import written

# Seconds that a forecast counts as on display after the last poll that shows it, seconds in which a visit before matters, and by which a forecast must lie behind it.
GRACE_S, LAP_S, GAP_S = 90, 7200, 120
# Rows of a task, on average, and seconds of a block in which the last arrival is looked up.
TASK_ROWS, DAY = 250_000, 86_400


def laps(visits: DataFrame, width: int = 86_400) -> DataFrame:
    """visits (id, veh, trip, t, idx) with lap: its number along the vehicle's trip, which grows where the place in the order does not."""
    key = ["veh", "trip"]
    block = F.floor(F.col("t") / width)
    seen = running(visits, key, ["t", "id"], block, "max", F.struct("t", "id", "idx"), "_last", inclusive=False)
    new = F.when(F.col("_last").isNull() | (F.col("idx") <= F.col("_last.idx")), 1).otherwise(0)
    return running(seen, key, ["t", "id"], block, "sum", new, "lap").drop("_last")


def _places(lines: DataFrame) -> DataFrame:
    """route, stop, loop (the line meets it twice or more) and last (its last place in the order)."""
    return lines.groupBy("route", "stop").agg((F.count("*") > 1).alias("loop"), F.max("idx").alias("last_idx"))


def minutes(arrivals: DataFrame, step: int, horizon: int) -> DataFrame:
    """arrivals (with actual, the time) with a row for each t on the grid of `step` seconds for which t < actual <= t + horizon."""
    low, high = F.ceil((F.col("actual") - horizon) / step), F.ceil(F.col("actual") / step) - 1
    return arrivals.where(low <= high).withColumn("t", F.explode(F.transform(F.sequence(low, high), lambda k: (k * step).cast("long"))))


def _newest(rows: DataFrame, shown: DataFrame, tasks: int) -> DataFrame:
    """rows with pred, made, seen and until of the newest forecast seen by t; at loop stops of those that name the wanted place or none."""
    dated = shown.select("veh", "trip", "stop", "seq", F.col("seen").alias("t"), "id", "seen", F.col("last").alias("until"), "made", "pred")
    keep, names = ["veh", "trip", "stop"], ["seen", "until", "made", "pred"]
    plain = asof(rows.where("NOT loop"), dated.drop("seq"), keep, "t", "id", [*names], tasks=tasks).drop("at")
    # At a loop stop both kinds are looked up, and the newer one counts.
    looped = rows.where("loop").withColumn("seq", F.col("want"))
    dated = dated.withColumn("f", F.struct("seen", "id", "until", "made", "pred", F.col("seq").alias("named")))
    own = asof(looped, dated.where("seq IS NOT NULL"), [*keep, "seq"], "t", "id", ["f"], tasks=tasks).drop("at", "seq").withColumnRenamed("f", "_own")
    both = asof(written(own), dated.where("seq IS NULL").drop("seq"), keep, "t", "id", ["f"], tasks=tasks).drop("at")
    best = F.greatest("_own", "f")
    both = both.withColumns({n: best[n] for n in names}).withColumn("named", best["named"]).drop("_own", "f")
    return plain.withColumn("named", F.lit(None).cast(shown.schema["seq"].dataType)).unionByName(both.select([*plain.columns, "named"]))


def forecast_table(arrivals: DataFrame, shown: DataFrame, lines: DataFrame, step: int = 60, horizon: int = 3600) -> DataFrame:
    """veh, t, id, trip, route, stop, idx, rank, next_trip, stops_away, lead, status, pred, made, seen and error.

    arrivals: id, veh, trip, route, stop, idx, t. shown (forecasts): id, veh, trip, stop, seq (null where unknown), seen and last (first and last poll that shows it), made, pred. lines: route, idx, stop.
    rank counts a trip's visits to a stop that are still ahead; only the next one (1) can have a forecast. status: none (nothing on display), previous_lap (what is
    shown was made for, or lies before, an earlier visit), else shown, with error = pred - arrival. stops_away counts along the line from the last arrival, over its end where
    the trip is another one. Arrivals without a time have no rows; forecasts that name no vehicle are not looked up here (joins.shown_to_bus does)."""
    least = arrivals.sparkSession.sparkContext.defaultParallelism
    visited, listed = arrivals.count(), shown.count()
    few, tasks = (max(least, -(-n // TASK_ROWS)) for n in (2 * visited, visited * max(1, horizon // step) + listed))
    lines = lines.select("route", "idx", "stop").distinct()
    sizes = lines.groupBy("route").agg(F.max("idx").alias("end_idx"))
    known = arrivals.where("t IS NOT NULL").withColumn("actual", F.col("t"))
    stops = known.join(_places(lines), ["route", "stop"], "left").join(sizes, "route", "left").withColumn("loop", F.coalesce("loop", F.lit(False)))
    # The visit to the stop before this one, on any trip: a property of the arrival, found before it is spread out.
    visits = arrivals.select("veh", "stop", "t", F.col("id"), F.col("t").alias("pa"), F.col("idx").alias("pa_idx"))
    before = asof(stops.withColumn("t", F.col("t") - 1), visits, ["veh", "stop"], "t", "id", ["pa", "pa_idx"], tasks=few).drop("at", "t")
    tops = shown.groupBy("veh", "trip", "stop").agg(F.max("seq").alias("top"))
    last = F.col("loop") & (F.col("idx") == F.col("last_idx")) & (F.col("top") > 1)
    wanted = before.join(tops, ["veh", "trip", "stop"], "left").withColumn("want", F.when(last, F.col("top")).otherwise(F.col("idx") + 1).cast(shown.schema["seq"].dataType))
    # Dealt again before they are spread, as a task that reads a table may hold many of its files.
    wanted = written(wanted.drop("top", "last_idx"))
    rows = minutes(wanted.repartition(tasks, "id"), step, horizon)
    days = F.sequence(F.floor((F.col("actual") - horizon) / DAY), F.floor(F.col("actual") / DAY))
    times = wanted.select("veh", F.explode(F.transform(days, lambda d: d * DAY)).alias("t"))
    log = arrivals.select("veh", "t", "id", F.col("trip").alias("l_trip"), F.col("route").alias("l_route"), F.col("idx").alias("l_idx"))
    rows = asof(rows, log, ["veh"], "t", "id", ["l_trip", "l_route", "l_idx"], width=DAY, tasks=tasks, times=times).drop("at")
    next_trip = F.coalesce(F.col("l_trip") != F.col("trip"), F.lit(False))
    same = F.col("l_route") == F.col("route")
    away: Column = F.when(same & (F.col("l_trip") == F.col("trip")) & (F.col("idx") > F.col("l_idx")), F.col("idx") - F.col("l_idx"))
    away = away.when(same & (F.col("l_trip") != F.col("trip")), F.col("end_idx") - F.col("l_idx") + F.col("idx"))
    rows = rows.withColumns({"next_trip": next_trip, "stops_away": away}).drop("l_trip", "l_route", "l_idx", "end_idx")
    turn = ["veh", "t", "trip", "stop", "_turn"]
    rows = rows.withColumn("_turn", F.when(F.col("loop"), F.col("idx"))).repartition(tasks, *turn)
    rows = written(rows.withColumn("rank", F.row_number().over(Window.partitionBy(*turn).orderBy("actual", "id"))).drop("_turn"))
    trips = arrivals.select("veh", "trip", "stop", "t", "id", F.col("t").alias("pv"))
    first = asof(written(_newest(rows.where("rank = 1"), shown, tasks)), trips, ["veh", "trip", "stop"], "t", "id", ["pv"], tasks=tasks).drop("at")
    alive = F.col("until") >= F.col("t") - GRACE_S
    lap = (F.col("t") - F.col("pv") <= LAP_S) & ((F.col("made") <= F.col("pv")) | (F.col("pred") < F.col("pv") + GAP_S))
    named = F.col("loop") & F.coalesce(F.col("named") == F.col("want"), F.lit(False)) & (F.col("pa_idx") + 1 != F.col("want"))
    trip = (F.col("actual") - F.col("pa") <= LAP_S) & (F.col("pred") < F.col("pa") + GAP_S) & ~named
    sure = lambda test: F.coalesce(test, F.lit(False))
    status = F.when(~sure(alive), "none").when(sure(lap) | sure(trip), "previous_lap").otherwise("shown")
    first = first.withColumn("status", status)
    told = {c: F.when(F.col("status") == "shown", F.col(c)) for c in ("pred", "made", "seen")}
    first = first.withColumns(told)
    later = rows.where("rank > 1").withColumn("status", F.lit("none"))
    columns = ["veh", "t", "id", "trip", "route", "stop", "idx", "rank", "next_trip", "stops_away", "status", "actual"]
    both = first.select(*columns, "pred", "made", "seen").unionByName(later.select(columns), allowMissingColumns=True)
    return both.select(*columns[:-2], (F.col("actual") - F.col("t")).alias("lead"), "status", "pred", "made", "seen", (F.col("pred") - F.col("actual")).alias("error"))
