"""Search along one line through boxes, against measures of all its segments."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tramline.operators import geometry


def zigzag(n, seed, copies=1):
    rng = np.random.default_rng(seed)
    at = np.repeat(np.column_stack((np.sort(rng.uniform(0, 5 * n, n)), rng.uniform(0, 500, n))), copies, axis=0)
    a, b = at[:-1], at[1:]
    length = np.hypot(*(b - a).T)
    return np.column_stack((np.concatenate(([0.0], np.cumsum(length)[:-1])), a, b, length))


@pytest.mark.parametrize(("n", "copies"), [(2, 1), (40, 1), (65, 2), (3000, 1), (300, 40)])
def test_search_of_a_line(n, copies, monkeypatch):
    segs, rng, measured, plain = zigzag(n, 1, copies), np.random.default_rng(2), [], geometry._measured
    x, y = rng.uniform(-100, 5 * n + 100, 150), rng.uniform(-50, 550, 150)
    x[0], y[0] = 1e7, -1e7
    line = geometry._Line(segs)
    monkeypatch.setattr(geometry, "_measured", lambda s, *at: measured.append(len(s)) or plain(s, *at))
    found = [np.concatenate(part) for part in zip(*[line.nearest(x[i : i + 60], y[i : i + 60]) for i in range(0, 150, 60)], strict=True)]
    far = rng.uniform(-0.2, 1.1, 150) * segs[-1, 0]
    ways = [line.first_way(f, d + geometry.SLACK, *at) for f, d, *at in zip(far.tolist(), found[0].tolist(), x.tolist(), y.tolist(), strict=True)]
    assert len(segs) < 3000 or copies > 1 or sum(measured) < 0.2 * 300 * len(segs)
    for i in range(150):
        d, along = plain(segs, x[i], y[i])
        assert found[0][i] == d.min() and found[1][i] == along[d == d.min()].min()
        fits = along[(d <= d.min() + geometry.SLACK) & (along >= far[i])]
        assert ways[i] == (fits.min() if len(fits) else None)


def test_places_are_halved_where_they_open_too_many(monkeypatch):
    segs = zigzag(2000, 3)
    x, y = np.linspace(0, 10_000, 90), np.full(90, 250.0)
    whole = geometry._Line(segs).nearest(x, y)
    monkeypatch.setattr(geometry, "PAIRS", 500)
    halved = geometry._Line(segs).nearest(x, y)
    assert all((a == b).all() for a, b in zip(whole, halved, strict=True))


def test_stops_in_turn_meet_no_pairs(spark):
    """Stops and segments that stand many times over are dealt once each; a stop without a place, a line without segments or a name has no way."""
    vertices = [(1, i, float(i // 9), float(i // 9 % 2 * 40)) for i in range(400)] + [(None, 0, 0.0, 0.0), (None, 1, 1.0, 0.0)]
    stops = [(1, i, i, float(i // 9), 20.0) for i in range(200)] + [(1, 900, 900, None, 1.0), (2, 901, 1, 1.0, 1.0), (None, 902, 1, 0.0, 0.0)]
    segs = geometry.segments(spark.createDataFrame(vertices, "line long, seq long, x double, y double"), ["line"])
    found = geometry.along(spark.createDataFrame(stops, "line long, id long, seq long, x double, y double"), segs, ["line"])
    assert "Join" not in found._jdf.queryExecution().toString()
    rows = sorted((r.seq, r.id, r.along) for r in found.collect())
    assert [r[1] for r in rows] == list(range(200)) and all(math.isfinite(r[2]) for r in rows)
