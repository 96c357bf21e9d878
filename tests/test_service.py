"""Rounding rules and alerts about detours; the other decisions are compared with their SQL in test_queries.py."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tramline.operators import service


def test_rounding(spark):
    values = [-2.5, -1.5, -0.5, 0.5, 1.5, 2.5, 2.4999, 7.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(service.half_even(F.col("v")), service.half_up(F.col("v"))).collect()
    assert [tuple(map(float, r)) for r in rows] == [(float(round(v)), float(math.floor(v + 0.5))) for v in values]
    pairs = [(a, b) for a in range(-9, 10) for b in (1, 2, 3, 4)]
    found = spark.createDataFrame(pairs, "a long, b long").select(service.half_up_div(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in found] == [(2 * a + b) // (2 * b) for a, b in pairs]


def test_detours(spark):
    rows = [(1, 0, 9, ["a", "b"], "no words", None), (2, 0, 9, [], "Road CLOSED", None), (3, 1, 5, None, None, "Buses re-routed today"), (4, 0, 9, [], "New timetable", ""), (5, 0, 9, ["a", "a"], "x", "y"), (6, 0, 9, None, None, None)]
    found = service.detoured(spark.createDataFrame(rows, "alert long, a long, b long, named array<string>, header string, description string")).collect()
    assert sorted((r.route or "", r.alert) for r in found) == [("", 2), ("", 3), ("a", 1), ("a", 5), ("b", 1)]


def test_buses_without_ids_or_times(spark):
    buses = spark.createDataFrame([(1, None, 7, "r", None, 100), (2, 5, 7, "r", 90, 100), (3, 5, None, "r", 90, 100), (4, 5, 7, "x", 90, 100), (5, 5, 7, "s", 90, 100)], "id long, veh long, trip long, route string, t long, now long")
    lines = spark.createDataFrame([("r",), ("s",)], "route string")
    spans = spark.createDataFrame([("r", 500, 900), ("r", 900, 500)], "route string, a long, b long")
    forecasts = spark.createDataFrame([(7, 6, 150), (None, 5, 150)], "trip long, veh long, at long")
    assert sorted(r.id for r in service.operating(buses, lines, spans, forecasts).collect()) == [1, 5]
