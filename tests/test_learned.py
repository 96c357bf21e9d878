"""Operators of learned.py on crafted rows."""

from __future__ import annotations

import math
import random
from statistics import NormalDist

from pyspark.sql import functions as F

from tramline.operators import learned


def test_corridor_needs_days_and_laps(spark):
    def passes(route, veh, days, x0, off=60.0):
        return [(veh * 10_000 + d * 10 + i, veh, route, d, d * 86_400 + 20 * i, x0 + 30.0 * i, 10.0, off, True) for d in range(days) for i in (0, 1)]

    # Route 1 has nine days: vehicle 1 passes on all, vehicle 2 on four, vehicle 3 on the line; route 2 has too few days.
    rows = passes(1, 1, 9, 5.0) + passes(1, 2, 4, 1005.0) + passes(1, 3, 9, 2005.0, off=10.0) + passes(2, 4, 4, 5.0)
    df = spark.createDataFrame(rows, "id long, veh long, route long, day long, t long, x double, y double, off double, ok boolean")
    laps = spark.createDataFrame([(1, 10), (2, 10)], "route long, laps long")
    assert {tuple(r) for r in learned.corridor_cells(df, laps).collect()} == {(1, 0, 0, 9, 9), (1, 1, 0, 9, 9)}
    away = learned.corridor_cells(df, laps, lambda route, x, y: x + 60)
    assert {r.cx for r in away.collect()} == {1}  # the centre of cell 0 is 72.5 m from that line, of cell 1 97.5 m
    assert learned.corridor_cells(df, laps.withColumn("laps", F.lit(1000))).count() == 0


def test_interval_scale_is_the_least_that_covers(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, 4.0, 0.3, 10.0, 10 + math.exp(4 + rng.gauss(0, 0.6))) for i in range(301)] + [(900, 0, 4.0, 0.0, 0.0, 3.0), (901, 1, 4.0, 0.3, 10.0, 10.0), (902, 7, 4.0, 0.3, 10.0, 9.0), (903, 8, 0.0, 0.3, 0.0, 1.0)]
    out = learned.interval_scale(spark.createDataFrame(rows, "id long, route long, mu double, sigma double, dwell double, y double"), ["route"])
    found = {r.route: (r.n, r.scale) for r in out.collect()}
    assert found[7] == (1, 6.0) and found[8] == (1, 0.3)
    z = NormalDist().inv_cdf(0.9)
    for route in (0, 1):
        mine = [r for r in rows if r[1] == route]

        def covered(c):
            return sum(math.exp(m - z * s * c) + d <= y <= math.exp(m + z * s * c) + d for _, _, m, s, d, y in mine) / len(mine)

        n, scale = found[route]
        assert n == len(mine) and covered(scale * (1 + 1e-9)) >= 0.8 > covered(scale * (1 - 1e-9))


def test_labels_clash_by_place_or_name(spark):
    rows = [(1, "Hall", 0.0, 0.0, None), (2, "North", 14.0, 0.0, None), (3, "hall", 500.0, 0.0, None), (4, "Group", 1.0, 1.0, 15), (5, "South", 15.0, 0.0, None)]
    out = learned.label_clashes(spark.createDataFrame(rows, "id long, label string, x double, y double, until int"))
    assert {tuple(r) for r in out.collect()} == {(1, 2, "near"), (2, 5, "near"), (3, 1, "name")}


def test_crowded_labels_meet_in_many_tasks(spark):
    """Pairs of 900 labels in a few cells equal all pairs; they are dealt to a number of tasks that does not hang on the labels' bytes."""
    rows = [(i, f"n{i}", (i * 37 % 450) / 5.0 - 45, (i * 91 % 300) / 5.0 - 30, None) for i in range(900)]
    found = learned.label_clashes(spark.createDataFrame(rows, "id long, label string, x double, y double, until int"))
    want = {(a[0], b[0], "near") for a in rows for b in rows if a[0] < b[0] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 < 225}
    got = found.collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert f"{learned.LABEL_TASKS}), REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()


def test_corridor_cells_count_without_dealing_passes_by_cell(spark):
    """Cells on both sides of zero, and a pass of two links in one quarter of an hour."""
    rows = [(i, v, 0, d, d * 86_400 + 30 * i, -60.0 + 40 * i, -10.0 - 30 * i, 50.0, True) for d in range(6) for v in range(3) for i in range(3)]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    found = learned.corridor_cells(spark.createDataFrame(rows, "id long, veh long, route long, day long, t long, x double, y double, off double, ok boolean"), spark.createDataFrame([(0, 3)], "route long, laps long"))
    got = {(r.cx, r.cy): (r.days, r.passes) for r in found.collect()}
    cells = {(math.floor((-60 + 10 * i) / 25), math.floor((-10 - 7.5 * i) / 25)) for i in range(9)}
    assert {(-3, -1), (0, -3)} <= got.keys() <= {(x, y) for x in range(-3, 1) for y in range(-3, 0)} and cells & got.keys()
    assert set(got.values()) == {(6, 18)}
    assert "flatten" in found._jdf.queryExecution().toString()
