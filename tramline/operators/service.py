"""Decisions about a service: which vehicles operate, whether to collect, how many stops away a bus is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.operators.cuts import running
from tramline.operators.joins import asof
from tramline.operators.lineage import written

# Fixed values, in seconds: a report older than STALE_S is none, a forecast counts PRED_GRACE_S after its time; collecting begins BEFORE_S ahead of a start, goes on WARMUP_S after it, and GRACE_S
# after the last bus seen.
STALE_S, PRED_GRACE_S, BEFORE_S, WARMUP_S, GRACE_S = 300, 60, 2700, 1800, 1800
# Fixed value: words of alerts about detours.
DETOUR = r"(?i)detour|re-?rout|closed|closure|blocked|construction|bypass|not serv|will not stop|temporar"


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounded to the nearest, halves to the even neighbour."""
    return F.bround(x, digits)


def half_up(x: Column) -> Column:
    """Rounded to the nearest whole number, halves upwards (of negative numbers too)."""
    return F.floor(x + 0.5)


def half_up_div(a: Column, b: Column) -> Column:
    """a / b of whole numbers (b > 0), rounded to the nearest whole one, halves upwards."""
    return F.floor((2 * a + b) / (2 * b))


def operating(buses: DataFrame, lines: DataFrame, spans: DataFrame, predictions: DataFrame, width: int = 3600) -> DataFrame:
    """The buses (id, veh, trip, route, t, now) in service: with a report of the last STALE_S seconds, on a route of lines (route), and either scheduled at `now` (within a span: route, a, b; a
    route without any span is taken as scheduled) or with a forecast (trip, veh, at) that is not over, for the bus or for no bus by name. A bus without a report time is not stale.

    Spans are dealt to bins of `width` seconds, so a bus meets those of its hour and line."""
    fresh = buses.where(F.col("t").isNull() | (F.col("now") - F.col("t") <= STALE_S)).join(lines.select("route").distinct(), "route", "left_semi")
    bins = F.explode(F.sequence(F.floor(F.col("a") / width), F.floor((F.col("b") - 1) / width)))
    dealt = spans.where("b > a").select("route", "a", "b", bins.alias("_bin"))
    asked = fresh.withColumn("_bin", F.floor(F.col("now") / width))
    runs = asked.join(dealt, ["route", "_bin"]).where((F.col("a") <= F.col("now")) & (F.col("now") < F.col("b"))).select("id")
    free = fresh.join(spans.select("route").distinct(), "route", "left_anti").select("id")
    # Of a trip's forecasts the last one decides, for each bus and for those that name none.
    last = predictions.groupBy("trip", "veh").agg(F.max("at").alias("until"))
    own = fresh.join(last.where("veh IS NOT NULL"), ["trip", "veh"])
    nameless = fresh.join(last.where("veh IS NULL").drop("veh"), "trip")
    unnamed = fresh.where("veh IS NULL").drop("veh").join(last.drop("veh"), "trip")
    predicted = [x.where(F.col("until") >= F.col("now") - PRED_GRACE_S).select("id") for x in (own, nameless, unnamed)]
    found = runs.unionByName(free).unionByName(predicted[0]).unionByName(predicted[1]).unionByName(predicted[2]).distinct()
    return buses.join(found, "id", "left_semi")


def gate(asks: DataFrame, spans: DataFrame, width: int = 86_400) -> DataFrame:
    """ask, collect, why and wake: whether to collect at `now`, from the spans (a, b) of all lines.

    asks: ask, now, last_seen (of any bus; null where none), feed_ok, buses (live in a fresh probe). why is live, seen, starts, feed_down or idle; wake is when to look again, null where nothing starts any more."""
    starts = spans.where("b > a").groupBy("a").agg(F.max("b").alias("b"))
    order = F.floor(F.col("a") / width)
    reach = written(running(starts, [], ["a"], order, "max", F.col("b"), "reach").select(F.col("a").alias("t"), F.col("a").alias("id"), F.col("a").alias("start"), "reach"))
    soon = asof(asks.withColumn("t", F.col("now") + BEFORE_S), reach, [], "t", "id", ["start", "reach"]).drop("at")
    both = asof(written(soon).withColumn("t", F.col("now") + BEFORE_S + 1), reach.select("t", "id", F.col("start").alias("later")), [], "t", "id", ["later"], forward=True)
    now = F.col("now")
    why = (
        F.when(F.col("buses") > 0, "live")
        .when(now - F.col("last_seen") < GRACE_S, "seen")
        .when(now < F.col("start") + WARMUP_S, "starts")
        .when(~F.col("feed_ok") & (now < F.col("reach") + GRACE_S), "feed_down")
        .otherwise("idle")
    )
    idle = F.col("why") == "idle"
    return both.withColumn("why", why).select("ask", (~idle).alias("collect"), "why", F.when(idle, F.col("later") - BEFORE_S).alias("wake"))


def stops_away(buses: DataFrame, lines: DataFrame) -> DataFrame:
    """id, stop and away: how many stops each bus (id, route, next) is from each stop of its line, 0 at its next one.

    lines: route, idx, stop; a line that ends where it begins is a loop, on which a stop behind the bus is a lap away, less what it is behind; on others it is left out. A stop that a line meets twice
    counts at its first place, as does the bus's next one. Stops of a line are few: each bus meets those of its own."""
    rows = lines.select("route", "idx", "stop").distinct()
    ends = rows.groupBy("route").agg(F.min_by("stop", "idx").alias("_a"), F.max_by("stop", "idx").alias("_b"), F.count("*").alias("_n"))
    ends = ends.withColumn("loop", (F.col("_a") == F.col("_b")) & (F.col("_n") > 2))
    # The last stop of a loop is its first.
    order = rows.groupBy("route", "stop").agg(F.min("idx").alias("idx"))
    size = rows.groupBy("route").agg(F.max("idx").alias("_last"))
    placed = order.join(ends.select("route", "loop"), "route").join(size, "route")
    at = buses.join(order.select("route", F.col("stop").alias("next"), F.col("idx").alias("_i")), ["route", "next"])
    away = F.col("idx") - F.col("_i")
    met = at.join(placed, "route").where((away >= 0) | F.col("loop"))
    return met.select("id", "stop", F.when(away < 0, away + F.col("_last")).otherwise(away).alias("away"))


def detoured(alerts: DataFrame) -> DataFrame:
    """route, alert, a and b: what alerts (alert, a, b, named: their routes, header, description) put on a detour, and when: each route that an alert names, and, as a null route, all of them where it
    names none and its words are of a detour."""
    none = F.coalesce(F.size("named"), F.lit(0)) <= 0
    words = F.concat_ws(" ", "header", "description").rlike(DETOUR)
    named = alerts.where(~none).withColumn("route", F.explode("named")).select("route", "alert", "a", "b").distinct()
    every = alerts.where(none & words)
    return named.unionByName(every.select(F.lit(None).cast(named.schema["route"].dataType).alias("route"), "alert", "a", "b"))
