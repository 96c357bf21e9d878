"""Laps, the forecast table's rules on crafted rows, and clusters of bounded width; the whole table is compared with its SQL in test_queries.py."""

from __future__ import annotations

import random

from tramline.operators import clusters, forecasts

ARRIVALS = "id long, veh long, trip long, route long, stop string, idx long, t long"
SHOWN = "id long, veh long, trip long, stop string, seq long, seen long, last long, made long, pred long"


def test_laps(spark):
    rng, rows, want = random.Random(1), [], {}
    for veh in range(3):
        t, lap, last = 0, 0, None
        for i in range(60):
            t, idx = t + rng.choice((0, 40, 90)), rng.randrange(5)
            lap += last is None or idx <= last
            last = idx
            rows.append((100 * veh + i, veh, 7, t, idx))
            want[100 * veh + i] = lap
    df = spark.createDataFrame(rows, "id long, veh long, trip long, t long, idx long").repartition(3)
    assert {r.id: r.lap for r in forecasts.laps(df, width=100).collect()} == want


def table(spark, arrivals, shown, lines):
    found = forecasts.forecast_table(
        spark.createDataFrame(arrivals, ARRIVALS), spark.createDataFrame(shown, SHOWN), spark.createDataFrame(lines, "route long, idx long, stop string"), 60, 600
    ).collect()
    return {(r.id, r.t): r for r in found}


def test_forecast_rules(spark):
    line = [(1, 0, "a"), (1, 1, "b"), (1, 2, "c")]
    arrivals = [(1, 5, 1, 1, "a", 0, 600), (2, 5, 1, 1, "b", 1, 900), (3, 5, 1, 1, "b", 1, 1190), (4, 5, 2, 1, "a", 0, 1200)]
    shown = [(10, 5, 1, "b", 2, 480, 700, 480, 930), (11, 5, 1, "b", 2, 780, 1000, 770, 905), (12, 5, 2, "a", 1, 1000, 2000, 990, 650)]
    found = table(spark, arrivals, shown, line)
    assert {t for i, t in found if i == 2} == {300, 360, 420, 480, 540, 600, 660, 720, 780, 840}
    assert [found[2, t].status for t in (420, 480, 720, 780)] == ["none", "shown", "shown", "shown"]
    assert (found[2, 480].error, found[2, 780].error, found[2, 780].lead) == (30, 5, 120)
    assert (found[3, 840].rank, found[3, 840].status, found[3, 900].rank) == (2, "none", 1)
    # What is shown at 900 was made before the visit of that second.
    assert found[3, 900].status == "previous_lap" and found[3, 1140].status == "none"
    # A forecast for an earlier visit to the stop, on another trip.
    assert found[4, 1020].status == "previous_lap" and found[4, 1020].next_trip and found[4, 1020].stops_away == 1
    assert found[2, 720].stops_away == 1 and found[2, 420].stops_away is None


def test_forecasts_at_a_loop(spark):
    loop = [(1, 0, "a"), (1, 1, "b"), (1, 2, "a")]
    arrivals = [(1, 5, 1, 1, "a", 0, 600), (2, 5, 1, 1, "a", 2, 1500)]
    shown = [(10, 5, 1, "a", 1, 300, 590, 300, 610), (11, 5, 1, "a", 3, 400, 1400, 700, 1490), (12, 5, 1, "a", None, 1300, 1400, 1290, 1510)]
    found = table(spark, arrivals, shown, loop)
    assert (found[1, 480].status, found[1, 480].pred, found[1, 480].rank) == ("shown", 610, 1)
    assert (found[2, 960].pred, found[2, 960].error) == (1490, -10) and found[2, 1320].pred == 1510


def test_tasks_follow_the_rows(spark, monkeypatch):
    """Tables of other sizes are dealt to as many more tasks, on average TASK_ROWS rows each, with the same rows as a result."""
    rng = random.Random(2)
    line = [(1, 0, "a"), (1, 1, "b"), (1, 2, "a")]
    arrivals = [(i, i % 3, rng.randrange(2), 1, line[i % 3][2], i % 3, rng.randrange(3000)) for i in range(60)]
    shown = [(i, i % 3, rng.randrange(2), "ab"[i % 2], rng.choice((1, 2, 3, None)), s, s + 300, s - 30, s + 400) for i in range(60) for s in [rng.randrange(2500)]]
    whole, plain, dealt = table(spark, arrivals, shown, line), forecasts.asof, []
    monkeypatch.setattr(forecasts, "TASK_ROWS", 20)
    monkeypatch.setattr(forecasts, "asof", lambda *a, **more: dealt.append(more["tasks"]) or plain(*a, **more))
    assert table(spark, arrivals, shown, line) == whole and len(whole) > 400
    least = spark.sparkContext.defaultParallelism
    assert dealt == [max(least, 6)] + [max(least, (60 * 10 + 60) // 20)] * 5


def plain_clusters(values, gap, width, least):
    out = [[]]
    for v in sorted(values):
        if out[-1] and v - out[-1][-1] > gap:
            out.append([])
        out[-1].append(v)

    def parts(c):
        if c[-1] - c[0] <= width or len(c) < 2:
            return [c]
        g, i = max((c[j + 1] - c[j], j) for j in range(len(c) - 1))
        return [c] if g < least else parts(c[: i + 1]) + parts(c[i + 1 :])

    return [p for c in out if c for p in parts(c)]


def test_clusters(spark):
    rng, rows, want = random.Random(5), [(9, None)], set()
    for key in range(6):
        values = [rng.randrange(0, 400 if key % 2 else 1400) for _ in range(rng.randrange(1, 90))]
        rows += [(key, v) for v in values]
        want |= {(key, float(c[0]), float(c[-1]), len(c), n + 1) for n, c in enumerate(plain_clusters(values, 15, 30, 4))}
    found = clusters.clusters(spark.createDataFrame(rows, "key long, m long").repartition(3), ["key"], "m", 15, 30, 4, block=50.0)
    assert {tuple(r) for r in found.collect()} == want
    assert clusters.clusters(spark.createDataFrame([], "key long, m long"), ["key"], "m", 15, 30, 4).collect() == []
