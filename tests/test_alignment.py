"""Alignment, times between live anchors and boards, against the full table of the definition."""

from __future__ import annotations

import random

import pytest

from tramline.operators import alignment


def full_table(stops, times, fits, price):
    """Places (k, q) of the best alignment, by the whole table of the most pairs and least cost from each cell on."""
    n, m = len(stops), len(times)
    best = [[(0, 0)] * (m + 1) for _ in range(n + 1)]  # (pairs, minus cost)
    for k in range(n - 1, -1, -1):
        for q in range(m - 1, -1, -1):
            ways = [best[k + 1][q], best[k][q + 1]]
            if fits(k, q):
                ways.append((best[k + 1][q + 1][0] + 1, best[k + 1][q + 1][1] - price(k, q)))
            best[k][q] = max(ways)
    out, k, q = [], 0, 0
    while k < n and q < m and best[k][q][0]:
        if fits(k, q) and (best[k + 1][q + 1][0] + 1, best[k + 1][q + 1][1] - price(k, q)) == best[k][q]:
            out.append((k, q))
            k, q = k + 1, q + 1
        elif best[k + 1][q] == best[k][q]:
            k += 1
        else:
            q += 1
    return out


@pytest.mark.parametrize("costs", [1, 3])
def test_a_part_is_aligned_as_by_the_full_table(costs):
    rng = random.Random(3)
    for _ in range(800):
        n, m = rng.randrange(1, 9), rng.randrange(1, 9)
        ids, ups = [rng.randrange(3) for _ in range(n)], [rng.randrange(3) for _ in range(m)]
        cost = {(k, q): rng.randrange(costs) for k in range(n) for q in range(m)}
        pairs = [(k, q, cost[k, q]) for k in range(n) for q in range(m) if ids[k] == ups[q]]
        if pairs:
            want = full_table(ids, ups, lambda k, q: ids[k] == ups[q], lambda k, q: cost[k, q])
            assert alignment.best_pairs(pairs, min(q for _, q, _ in pairs) == 0) == want


def rows(keys, length, seed, spread):
    """Planned stops every 60 seconds and live times of most of them, late or early, with a few strays and ties."""
    rng, planned, live = random.Random(seed), [], []
    for key in range(keys):
        n = rng.randrange(1, length)
        for k in range(n):
            stop = rng.randrange(4) if rng.random() < 0.97 else None
            planned.append((key, k, stop, 60 * k))
            if rng.random() < 0.8:
                live.append((key, len(live), stop, 60 * k + rng.randrange(-spread, spread) // 30 * 30))
            if rng.random() < 0.1:
                live.append((key, len(live), rng.randrange(4), 60 * rng.randrange(n)))
    return planned, live


@pytest.mark.parametrize(("spread", "wide", "costly"), [(60, 90, False), (200, 180, True), (400, 300, False)])
def test_aligned(spark, monkeypatch, spread, wide, costly):
    monkeypatch.setattr(alignment, "BLOCK", 16)
    planned, live = rows(40, 120, 5, spread)
    p = spark.createDataFrame(planned, "bus long, pos long, stop long, due long").repartition(3)
    e = spark.createDataFrame(live, "bus long, id long, stop long, t long").repartition(3)
    cost = alignment.F.abs(alignment.F.col("r_t") - alignment.F.col("due")).cast("double") if costly else None
    found = {(r.bus, r.pos): (r.id, r.t) for r in alignment.aligned(p, e, ["bus"], wide, wide, cost).collect()}
    want = {}
    for bus in range(40):
        mine = [x for x in planned if x[0] == bus]
        ups = sorted((x for x in live if x[0] == bus), key=lambda x: (x[3], x[1]))
        fits = lambda k, q: mine[k][2] is not None and mine[k][2] == ups[q][2] and abs(mine[k][3] - ups[q][3]) <= wide  # noqa: E731, B023
        price = lambda k, q: abs(mine[k][3] - ups[q][3]) if costly else 0  # noqa: E731, B023
        want |= {(bus, mine[k][1]): (ups[q][1], ups[q][3]) for k, q in full_table(mine, ups, fits, price)}
    assert len(want) > 500 and found == want


def test_a_key_of_many_rows_is_cut(spark):
    """One bus with a hundred thousand stops: many parts, and each planned stop gets its own time."""
    p = spark.range(100_000).selectExpr("1 AS bus", "id AS pos", "id % 7 AS stop", "id * 60 AS due")
    e = spark.range(100_000).selectExpr("1 AS bus", "id", "id % 7 AS stop", "id * 60 + id % 50 AS t")
    found = alignment.aligned(p, e, ["bus"], 120, 120)
    assert found.count() == 100_000 and found.where("pos <> id").count() == 0
    parts = alignment._parts(p.selectExpr("bus", "pos", "pos AS q"), ["bus"])
    assert parts.select("block").distinct().count() == 100_000


def test_aligned_of_nothing(spark):
    p = spark.createDataFrame([(1, 0, "a", 0)], "bus long, pos long, stop string, due long")
    e = spark.createDataFrame([(1, 1, None, 0), (1, 2, "a", None), (2, 3, "a", 0)], "bus long, id long, stop string, t long")
    assert alignment.aligned(p, e, ["bus"], 60, 60).collect() == []
    assert alignment.aligned(p.limit(0), e.limit(0), ["bus"], 60, 60).collect() == []


def plain_times(ride, live, now):
    out, floor = [], now
    for k, (c, t) in enumerate(zip(ride, live, strict=True)):
        if t is not None:
            out.append((max(t, now), False))
            floor = max(floor, t)
            continue
        back = [j for j in range(k) if live[j] is not None]
        ahead = [m for m in range(k + 1, len(ride)) if live[m] is not None]
        if back:
            j = back[-1]
            at = live[j] + c - ride[j]
            if ahead and ride[ahead[0]] > ride[j] and live[ahead[0]] > live[j]:
                at = live[j] + (live[ahead[0]] - live[j]) * ((c - ride[j]) / (ride[ahead[0]] - ride[j]))
        elif ahead:
            m = ahead[0]
            at = now + (live[m] - now) * min(1, c / ride[m]) if live[m] > now and ride[m] > 0 else live[m] - (ride[m] - c)
        else:
            at = now + c
        floor = max(at, floor, now)
        out.append((floor, True))
    return out


def test_stop_times(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 4)
    rng, data, want = random.Random(2), [], {}
    for bus in range(60):
        ride, c = [], 0
        for _ in range(rng.randrange(1, 25)):
            c += rng.choice((0, 60, 120, 300))
            ride.append(c)
        live = [rng.randrange(-100, 5000) if rng.random() < 0.4 else None for _ in ride]
        data += [(bus, k, r, t, 100) for k, (r, t) in enumerate(zip(ride, live, strict=True))]
        want |= {(bus, k): x for k, x in enumerate(plain_times(ride, live, 100))}
    found = alignment.stop_times(spark.createDataFrame(data, "bus long, pos long, ride long, live long, now long"), ["bus"]).collect()
    assert {(r.bus, r.pos): (round(r["at"], 6), r.est) for r in found} == {k: (round(float(a), 6), e) for k, (a, e) in want.items()}


def test_board(spark):
    times = spark.createDataFrame([(1, 0, "a", 100.0, False), (1, 1, "b", 160.0, True), (1, 2, "a", 500.0, True), (2, 0, "a", 90.0, True)], "bus long, pos long, stop string, at double, est boolean")
    live = spark.createDataFrame([(1, 1, "a", 100), (1, 2, "a", 480), (1, 3, "b", 150), (3, 4, "a", 70)], "bus long, id long, stop string, t long")
    found = {tuple(r) for r in alignment.board(times, live, ["bus"]).select("stop", "bus", "at", "kind", "away").collect()}
    assert found == {("a", 1, 100.0, "live", None), ("a", 1, 480.0, "live", None), ("b", 1, 160.0, "est", 1), ("a", 3, 70.0, "live", None), ("a", 2, 90.0, "est", 0)}
