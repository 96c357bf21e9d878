"""What is learnt from many days: cells of a corridor, the scale of forecast intervals; and labels that stand in each other's way."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.operators import cuts

# A cell, a step along a pass (metres), a pass (seconds, metres, metres off the line), days, shares, and metres from the line.
CELL_M, STEP_M, PASS_S, PASS_M, OFF_M = 25.0, 10.0, 40, 400.0, 40.0
LEAST_DAYS, DAY_SHARE, LAP_SHARE, LINE_M = 5, 2 / 3, 0.05, (80.0, 400.0)
# Bounds of the scale of intervals, and metres under which two labels clash.
SCALES, LABEL_M = (0.3, 6.0), 15.0
#: Cells of a row of cells, far more than the earth has.
ROW = 1 << 32
#: Tasks that the pairs of cells of labels are dealt to.
LABEL_TASKS = 256


def corridor_cells(rows: DataFrame, laps: DataFrame, line: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """route, cx, cy, days and passes of the cells that vehicles of a route use away from its line, day after day.

    rows: id, veh, route, day, t, x, y, off (metres from the line) and ok; laps: route and laps a day. Two linked good reports, one at least off the
    line, are a pass along the straight between them; passes of a vehicle in a quarter of an hour count once. A cell stays if it and those around it were
    passed on LEAST_DAYS and DAY_SHARE of the route's days and by LAP_SHARE of its laps. line(route, x, y) gives a point's distance from the
    drawn line, where cells have to be within LINE_M. Routes with fewer days or without laps are not learnt."""
    order = Window.partitionBy("veh").orderBy("t", "id")
    before = {f"p_{c}": F.lag(c).over(order) for c in ("route", "t", "x", "y", "off", "ok")}
    dx, dy = F.col("x") - F.col("p_x"), F.col("y") - F.col("p_y")
    linked = rows.withColumns(before).where("ok AND p_ok AND route = p_route").withColumn("far", F.sqrt(dx * dx + dy * dy))
    linked = linked.where((F.col("t") - F.col("p_t") <= PASS_S) & (F.greatest("off", "p_off") > OFF_M) & (F.col("far") <= PASS_M))
    k = F.greatest(F.lit(1), F.floor(F.col("far") / STEP_M)).cast("long")
    place = lambda a, d, i: F.floor((F.col(a) + d * i / k) / CELL_M)
    # A cell is one number. The cells of a pass are one list, and those around them another: a pass meets a cell once, and only counts are dealt by cell.
    crossed = F.transform(F.sequence(F.lit(0).cast("long"), k), lambda i: place("p_x", dx, i) * ROW + place("p_y", dy, i) + ROW // 2)
    links = linked.select("veh", "route", "day", F.floor(F.col("p_t") / 900).alias("slot"), F.array_distinct(crossed).alias("cells"))
    passes = links.groupBy("veh", "route", "day", "slot").agg(F.array_distinct(F.flatten(F.collect_list("cells"))).alias("cells"))
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    around = F.transform("cells", lambda c: F.array(*[c + (i * ROW + j) for i, j in steps]))
    near = passes.select("route", "day", "cells", F.explode(F.array_distinct(F.flatten(around))).alias("c"))
    own = F.array_contains("cells", F.col("c"))
    daily = near.withColumn("own", own).groupBy("route", "c", "day").agg(F.count("*").alias("n"), F.max("own").alias("own"))
    used = daily.groupBy("route", "c").agg(F.count("day").alias("days"), F.sum("n").alias("passes"), F.max("own").alias("own")).where("own")
    used = used.withColumns({"cx": F.shiftright("c", ROW.bit_length() - 1), "cy": F.pmod("c", F.lit(ROW)) - ROW // 2})
    days = rows.where("ok").groupBy("route").agg(F.count_distinct("day").alias("all_days")).join(laps.where("laps > 0"), "route").where(F.col("all_days") >= LEAST_DAYS)
    enough = (F.col("days") >= F.greatest(F.lit(LEAST_DAYS), DAY_SHARE * F.col("all_days"))) & (F.col("passes") >= LAP_SHARE * F.col("all_days") * F.col("laps"))
    kept = used.join(days, "route").where(enough)
    if line is not None:
        off = line(F.col("route"), (F.col("cx") + 0.5) * CELL_M, (F.col("cy") + 0.5) * CELL_M)
        kept = kept.where((off > LINE_M[0]) & (off <= LINE_M[1]))
    return kept.select("route", "cx", "cy", "days", "passes")


def interval_scale(rows: DataFrame, by: Sequence[str], target: float = 0.8) -> DataFrame:
    """by, n and scale: the least factor of sigma, within SCALES, by which `target` of a key's values lie in their interval.

    rows: id (unique), mu, sigma, dwell and y; the interval of y - dwell is log-normal and covers `target` if the model is right. Each row has a least
    factor of its own, so the key's is that of one rank. Rows whose y is not over dwell, or that differ from mu without a sigma, fit no interval."""
    z = NormalDist().inv_cdf(0.5 + target / 2)
    moved = F.col("y") - F.col("dwell")
    miss = F.abs(F.ln(moved) - F.col("mu"))
    own = F.when(moved <= 0, float("inf")).when(miss == 0, 0.0).when(F.col("sigma") > 0, miss / (z * F.col("sigma"))).otherwise(float("inf"))
    # A row beyond the upper bound only has to rank there.
    each = rows.select(*by, F.least(own, F.lit(2 * SCALES[1])).alias("own"))
    found = cuts.at_ranks(each, by, "own", {"own": lambda n: F.ceil(F.round(target * n, 9)) - 1})
    return found.select(*[F.col("_key")[c].alias(c) for c in by], "n", F.greatest(F.least("own", F.lit(SCALES[1])), F.lit(SCALES[0])).alias("scale"))


def label_clashes(labels: DataFrame) -> DataFrame:
    """id, other and kind: `near` for two labels under LABEL_M apart that both never hide, `name` for a label whose name, in lower case, the label of a lesser id has.

    labels: id, label, x, y (metres) and until (null: never hides). Of `name`, other is the first label of the name."""
    always = labels.where("until IS NULL").select("id", "x", "y", F.floor(F.col("x") / LABEL_M).alias("cx"), F.floor(F.col("y") / LABEL_M).alias("cy"))
    # Each two cells meet once. The pairs grow with the square of the labels' density, so they are dealt to a fixed number of tasks and not by the labels' bytes.
    ahead = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    wide = always.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy", F.explode(ahead).alias("d"))
    wide = wide.select("id2", "x2", "y2", (F.col("cx") + F.col("d.x")).alias("cx"), (F.col("cy") + F.col("d.y")).alias("cy"), (F.col("d.x") + F.col("d.y") == 0) & (F.col("d.x") == 0))
    wide = wide.toDF("id2", "x2", "y2", "cx", "cy", "same")
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    met = always.repartition(LABEL_TASKS, "cx", "cy").join(wide.repartition(LABEL_TASKS, "cx", "cy").hint("merge"), ["cx", "cy"])
    met = met.where((~F.col("same") | (F.col("id") < F.col("id2"))) & (dx * dx + dy * dy < LABEL_M**2))
    near = met.select(F.least("id", "id2").alias("id"), F.greatest("id", "id2").alias("other"), F.lit("near").alias("kind"))
    named = labels.select(F.lower("label").alias("name"), "id")
    first = named.groupBy("name").agg(F.min("id").alias("other"))
    return near.unionByName(named.join(first, "name").where("id > other").select("id", "other", F.lit("name").alias("kind")))
