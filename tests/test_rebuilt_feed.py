"""Feeds rebuilt from a log of changes, against a replay poll by poll."""

from __future__ import annotations

import random

from tramline.operators import rebuilt


def log(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        seen = rng.randrange(0, 6000)
        made = seen - rng.choice((0, 0, 10, 200, 900))
        rows.append((i, rng.randrange(3), rng.randrange(2), rng.choice("abc"), seen, seen + rng.choice((-5, 0, 40, 300)), made, made + rng.randrange(300), rng.randrange(1, 4)))
    return rows


def replayed(rows, grid=30, slack=90):
    """For each poll and (vehicle, trip) the sorted (seq, stop, pred) on display."""
    rows = sorted(rows, key=lambda r: (r[4], r[6], r[0]))
    active, out, k = {}, {}, 0
    for g in range(0, 9000, grid):
        while k < len(rows) and rows[k][4] <= g:
            _, veh, trip, stop, seen, last, made, pred, seq = rows[k]
            held = active.get((veh, trip, stop))
            if held is None or made >= held[0]:
                active[veh, trip, stop] = (made, max(last, seen), seq, pred)
            k += 1
        active = {key: v for key, v in active.items() if v[1] + slack >= g}
        for (veh, trip, stop), (_, _, seq, pred) in active.items():
            out.setdefault((g, veh, trip), []).append((seq, stop, pred))
    return {key: sorted(x) for key, x in out.items()}


def test_polls_show_what_a_replay_shows(spark):
    for seed in (1, 2):
        rows = log(seed)
        df = spark.createDataFrame(rows, "id long, veh long, trip long, stop string, seen long, last long, made long, pred long, seq long").repartition(3)
        held = rebuilt.spans(df, ["veh", "trip", "stop"], ["pred", "seq"])
        snaps = rebuilt.snapshots(held, ["veh", "trip"], "seq", ["stop", "pred"])
        polls = spark.range(0, 9000, 30).withColumnRenamed("id", "t")
        found = {(r.t, r.veh, r.trip): [tuple(e) for e in r.entries] for r in rebuilt.shown_at_polls(polls, snaps).collect()}
        want = replayed(rows)
        assert found == want and len(want) > 300
        assert snaps.count() < len(want) / 2


def test_empty_log(spark):
    df = spark.createDataFrame([], "id long, veh long, trip long, stop string, seen long, last long, made long, pred long, seq long")
    held = rebuilt.spans(df, ["veh", "trip", "stop"], ["pred", "seq"])
    assert rebuilt.snapshots(held, ["veh", "trip"], "seq", ["stop", "pred"]).collect() == []
