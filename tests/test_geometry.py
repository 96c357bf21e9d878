"""Nearest places and segments and places along lines, against plain searches over all pairs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tramline.operators import geometry


def scattered(n, seed, wide=100_000):
    """Places in dense clusters, in sparse country, on top of each other and far away."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.random()
        x, y = rng.uniform(-wide, wide), rng.uniform(-wide, wide)
        if kind < 0.5:
            x, y = rng.gauss(500, 60), rng.gauss(-700, 60)
        elif kind < 0.6:
            x, y = 1000.0, 50.0
        out.append((i % 2, i, x, y))
    return out + [(0, n, 1e7, -1e7), (0, n + 1, None, 1.0), (None, n + 2, 1.0, 1.0), (5, n + 3, 0.0, 0.0)]


@pytest.mark.parametrize(("keyed", "self_"), [(False, True), (True, False), (True, True)])
def test_nearest(spark, keyed, self_):
    a, b = scattered(150, 1), scattered(200, 1 if self_ else 2)
    by = ["key"] if keyed else []
    p, o = (spark.createDataFrame(x, "key long, id long, x double, y double") for x in (a, b))
    want = set()
    for key, i, x, y in a:
        if x is None or (keyed and key is None):
            continue
        near = sorted((math.hypot(x - u, y - v), j) for k, j, u, v in b if u is not None and (not keyed or k == key) and not (self_ and i == j))
        want |= {(i, j, r + 1, round(d, 4)) for r, (d, j) in enumerate(near[:3])}
    found = {(r.id, r.other, r.r, round(r.m, 4)) for r in geometry.nearest(p, o, 3, by, self_).collect()}
    assert found == want


def to_segment(x, y, ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(ax + t * dx - x, ay + t * dy - y), t


def lines(seed, keys=4):
    """Winding lines with long and short segments, a doubled vertex, and a loop driven twice."""
    rng, vertices = random.Random(seed), []
    for key in range(keys):
        x = y = 0.0
        for k in range(60):
            vertices.append((key, k, x, y))
            step = rng.choice((0, 5, 40, 40, 300, 2500))
            angle = rng.uniform(-0.6, 0.6) + k / 12
            x, y = x + step * math.cos(angle), y + step * math.sin(angle)
    ring = [(0, 0), (400, 0), (400, 400), (0, 400)]
    return vertices + [(9, k, *map(float, ring[k % 4])) for k in range(9)]


def plain_segments(vertices):
    out = {}
    for key in sorted({v[0] for v in vertices}):
        own, start = sorted(v[1:] for v in vertices if v[0] == key), 0.0
        for (_, ax, ay), (k, bx, by) in zip(own, own[1:], strict=False):
            out.setdefault(key, []).append((k, ax, ay, bx, by, start))
            start += math.hypot(bx - ax, by - ay)
    return out


def test_points_on_lines(spark):
    vertices = lines(7)
    segs, rng = plain_segments(vertices), random.Random(8)
    points = [(key, 100 * key + i, rng.uniform(-3000, 9000), rng.uniform(-3000, 9000)) for key in (0, 1, 2, 3, 9, 77) for i in range(40)] + [(0, 9999, None, 1.0)]
    s = geometry.segments(spark.createDataFrame(vertices, "line long, seq long, x double, y double"), ["line"])
    found = {r.id: (round(r.d, 5), round(r.along, 4)) for r in geometry.on_line(spark.createDataFrame(points, "line long, id long, x double, y double"), s, ["line"]).collect()}
    want = {}
    for key, i, x, y in points:
        if x is not None and key in segs:
            best = min((round((r := to_segment(x, y, *g[1:5]))[0], 7), g[5] + r[1] * math.hypot(g[3] - g[1], g[4] - g[2])) for g in segs[key])
            want[i] = best
    assert found.keys() == want.keys()
    for i, (d, at) in want.items():
        assert abs(found[i][0] - d) < 1e-4 and (abs(found[i][1] - at) < 1e-3 or found[i][0] > 1000)


def test_stops_along_lines(spark):
    vertices = lines(11)
    segs, rng, stops = plain_segments(vertices), random.Random(12), []
    for key, own in segs.items():
        for seq in range(14):
            k, ax, ay, bx, by, _ = own[min(len(own) - 1, seq * len(own) // 14)]
            t = rng.random()
            stops.append((key, 1000 * key + seq, seq, ax + t * (bx - ax) + rng.uniform(-15, 15), ay + t * (by - ay) + rng.uniform(-15, 15)))
    want = {}
    for key, own in segs.items():
        far = -math.inf
        for _, i, _, x, y in sorted((s for s in stops if s[0] == key), key=lambda s: s[2]):
            ways = [((r := to_segment(x, y, *g[1:5]))[0], g[5] + r[1] * math.hypot(g[3] - g[1], g[4] - g[2])) for g in own]
            best = min(d for d, _ in ways)
            fits = [a for d, a in ways if d <= best + 25 and a >= far - 5]
            want[i] = min(fits) if fits else min(ways)[1]
            far = max(far, want[i])
    s = geometry.segments(spark.createDataFrame(vertices, "line long, seq long, x double, y double"), ["line"])
    found = {r.id: r.along for r in geometry.along(spark.createDataFrame(stops, "line long, id long, seq long, x double, y double"), s, ["line"]).collect()}
    assert found.keys() == want.keys() and all(abs(found[i] - want[i]) < 1e-6 for i in want)
    # The second lap of the loop gets places of the second lap.
    assert max(v for i, v in found.items() if i >= 9000) > 1600


def test_empty(spark):
    none = spark.createDataFrame([], "id long, x double, y double")
    one = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    assert geometry.nearest(none, one).collect() == geometry.nearest(one, none).collect() == geometry.nearest(one, one, self_=True).collect() == []


def test_flat(spark):
    x, y = geometry.flat(F.lit(41.8), F.lit(-87.6), 41.8)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(r.y - 41.8 * 111320) < 1e-6 and abs(r.x + 87.6 * 111320 * math.cos(math.radians(41.8))) < 1e-6


def test_cells_of_all_levels_are_never_broadcast(spark):
    """Rows of 21 levels outgrow what Spark expects of their table, and with it the driver."""
    at = spark.range(300).selectExpr("id", "CAST(id * 7919 % 1003 AS DOUBLE) AS x", "CAST(id * 104729 % 997 AS DOUBLE) AS y")
    found = geometry.nearest(at, at, 3, self_=True)
    sent = [line for line in found._jdf.queryExecution().toString().splitlines() if "BroadcastHashJoin" in line]
    assert all("BroadcastHashJoin [_l#" in line for line in sent)  # the few levels that are looked at
    assert found.count() == 900


def test_close_lines_get_small_cells(spark):
    """A line that goes to and fro 0.2 m apart: cells are fitted to it, and results are the same."""
    vertices = spark.range(3000).selectExpr("1L AS line", "id AS seq", "id * 0.2D AS x", "(id % 2) * 30.0D AS y")
    points = spark.range(200).selectExpr("1L AS line", "id", "id * 3.0D AS x", "40.0D AS y")
    segs = geometry.segments(vertices, ["line"])
    first = geometry._fit(points, segs, ["line"], 0.0)
    assert first < geometry.FIRST
    fitted = {r.id: (r.seg, r.d, r.along) for r in geometry.on_line(points, segs, ["line"]).collect()}
    assert fitted == {r.id: (r.seg, r.d, r.along) for r in geometry.on_line(points, segs, ["line"], geometry.FIRST).collect()} and len(fitted) == 200


def test_stops_in_turn_are_placed_without_listing_their_places(spark, monkeypatch):
    rng = random.Random(8)
    vertices = [(1, i, float(i // 4 % 40), rng.uniform(0, 60)) for i in range(600)]
    stops = [(1, i, i, rng.uniform(0, 40), rng.uniform(0, 60)) for i in range(150)]
    monkeypatch.setattr(geometry, "SEGMENTS", 16, raising=False)
    segs = geometry.segments(spark.createDataFrame(vertices, "line long, seq long, x double, y double"), ["line"])
    found = geometry.along(spark.createDataFrame(stops, "line long, id long, seq long, x double, y double"), segs, ["line"])
    rows, far, want = segs.orderBy("seg").collect(), -math.inf, {}
    for _, i, _, x, y in stops:
        ways = []
        for g in rows:
            dx, dy = g.bx - g.ax, g.by_ - g.ay
            part = min(1.0, max(0.0, ((x - g.ax) * dx + (y - g.ay) * dy) / g.length**2)) if g.length else 0.0
            ways.append((math.hypot(g.ax + part * dx - x, g.ay + part * dy - y), g.start + part * g.length))
        best, near = min(ways)
        want[i] = next((w for d, w in sorted(ways, key=lambda p: p[1]) if w >= far - 5 and d <= best + 25), near)
        far = max(far, want[i])
    got = {r.id: r.along for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    assert "collect_set" not in found._jdf.queryExecution().toString()
