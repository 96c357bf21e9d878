"""Operators whose plan was rebuilt: near vehicles, fleet drops, expanding medians, and the ring of newest forecasts as a stream."""

from __future__ import annotations

import random
import statistics

from pyspark.sql import functions as F

from tramline.operators import bootstrap, cuts, tracks
from tramline.operators.joins import on_display
from tramline.streaming import detect


def sightings(seed, n=500, keys=3, vehicles=5, wide=4000):
    rng = random.Random(seed)
    rows = [(i, rng.choice([*range(keys), None]) if i % 17 == 0 else rng.randrange(keys), rng.randrange(vehicles), rng.randrange(wide)) for i in range(n)]
    return rows + [(n, 0, None, 50), (n + 1, 0, 1, None), (n + 2, 9, 1, 5), (n + 3, 9, 1, 5)]


def test_another_near(spark):
    rows = sightings(1, n=250)
    df = spark.createDataFrame(rows, "id long, trip long, veh long, t long").repartition(3)
    for before, after in ((20, 20), (0, 60), (0, 0)):
        found = {r.id: r.near for r in tracks.another_near(df, ["trip"], before, after, width=300).collect()}
        want = {i: any(k == trip and v is not None and veh is not None and v != veh and u is not None and t is not None and t - before <= u <= t + after for _, k, v, u in rows) for i, trip, veh, t in rows}
        assert found == want and any(want.values()) and not all(want.values())


def test_drops(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(3), rng.randrange(4), rng.randrange(60) * 100) for _ in range(160)]
    end, want = max(t for _, _, t in rows), set()
    for route, veh in {r[:2] for r in rows}:
        times = sorted({t for r, v, t in rows if (r, v) == (route, veh)})
        for t, after in zip(times, [*times[1:], None], strict=True):
            if (end if after is None else after) - t >= 600:
                others = len({v for r, v, u in rows if r == route and v != veh and t < u <= t + 600})
                if others:
                    away = None if after is None else after - t
                    lasting = 0 if away is not None and away < 1800 else 1 if away is not None or end - t >= 1800 else None
                    want.add((route, veh, t, others + 1, others, lasting, away))
    df = spark.createDataFrame(rows, "route long, veh long, t long")
    found = {tuple(r) for r in tracks.drops(df, df.agg(F.max("t")).scalar()).collect()}
    assert found == want and len({w[5] for w in want}) > 1


def test_expanding_median(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(12), rng.choice([rng.gauss(0, 5), 3.0, 1e6, None])) for _ in range(400)] + [("one", 1, 2.0), ("one", None, 2.0)]
    want = {}
    for key in {r[0] for r in rows}:
        for step in {r[1] for r in rows if r[0] == key and r[1] is not None}:
            before = [v for k, s, v in rows if k == key and s is not None and s < step and v is not None]
            if before:
                want[key, step] = (len(before), statistics.median(before))
    found = {(r.key, r.step): (r.n, r.mid) for r in cuts.expanding_median(spark.createDataFrame(rows, "key string, step long, value double"), ["key"], "step", "value", "mid", bins=8).collect()}
    assert found == want


def test_displays_equal_the_batch_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(detect, "RING", 5)
    rng = random.Random(3)
    rows = [(rng.randrange(4), i, t, rng.random() < 0.4, t + rng.choice((0, 50, 100, 500))) for i, t in enumerate(sorted(rng.randrange(6000) for _ in range(600)))]
    kind = "veh long, event_id long, t long, asks boolean, last long"
    for part in range(6):  # files in order of time, one a batch
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = {(r.event_id, r.seen, r["last"]) for r in detect.replay(spark, detect.displays(source), str(tmp_path)).collect()}
    table = spark.createDataFrame(rows, kind)
    shown = table.where("NOT asks").select("veh", "event_id", F.col("t").alias("seen"), "last")
    batch = on_display(table.where("asks").select("veh", "event_id", "t"), shown, ["veh"], "t", detect.GRACE_S)
    assert found == {(r.event_id, r.seen, r["last"]) for r in batch.collect()} and len({f[1] for f in found}) > 50


def test_day_shares(spark):
    rng = random.Random(8)
    rows = [(key, 100 + d, rng.choice((0, 1, 5, 40)), 0) for key in range(5) for d in range((1, 2, 7, 30, 3)[key])] + [(9, 1, 0, 0), (9, 2, 0, 0)]
    rows = [(k, d, n, rng.randrange(n + 1)) for k, d, n, _ in rows]
    found = {r.key: (r.share, r.low, r.high) for r in bootstrap.day_shares(spark.createDataFrame(rows, "key long, day long, n long, hit long").repartition(3), ["key"], 60).collect()}
    slots = spark.range(60).selectExpr("CAST(id AS INT) AS b", "explode(sequence(1, 30)) AS s")
    place = {(r.b, r.s, r.d): r.p for r in slots.select("b", "s", F.explode(F.sequence(F.lit(2), F.lit(30))).alias("d")).withColumn("p", bootstrap.drawn(F.col("b"), F.col("s"), F.col("d"))).collect()}
    assert {place[b, s, 7] for b in range(60) for s in range(1, 8)} == set(range(1, 8))
    for key in {r[0] for r in rows}:
        days = sorted(r[1:] for r in rows if r[0] == key)
        n = sum(d[1] for d in days)
        sims = []
        for b in range(60 if len(days) > 1 else 0):
            pick = [days[place[b, s, len(days)] - 1] for s in range(1, len(days) + 1)]
            if sum(p[1] for p in pick):
                sims.append(sum(p[2] for p in pick) / sum(p[1] for p in pick))
        sims.sort()
        ends = (sims[int(0.025 * len(sims))], sims[max(0, int(0.975 * len(sims)) - 1)]) if sims else (None, None)
        assert found[key] == (sum(d[2] for d in days) / n if n else None, *ends)


def fleet_log(seed, seconds=9000):
    """Reports of three routes every 30 seconds or so, with vehicles that pause, leave and come."""
    rng, rows = random.Random(seed), []
    for route in ("a", "b", "c"):
        for veh in range(5):
            t = rng.randrange(0, 3000)
            while t < seconds:
                until = t + rng.randrange(100, 2500)
                while t < min(until, seconds):
                    rows.append((route, veh, t // 10 * 10))
                    t += rng.choice((20, 30, 60, 200))
                t += rng.choice((300, 590, 600, 900, 2500))
    return sorted(rows, key=lambda r: r[2])


def plain_changes(rows):
    """Second by second, from the whole past of the log."""
    out = set()
    for route in {r[0] for r in rows}:
        times = {}
        for r, veh, t in rows:
            if r == route:
                times.setdefault(veh, []).append(t)
        since = min(t for ts in times.values() for t in ts)
        stays = {}  # veh: (first, last, when it counts) of each stay
        for veh, ts in times.items():
            ts = sorted(ts)
            cuts = [0, *[i for i in range(1, len(ts)) if ts[i] - ts[i - 1] >= detect.LEFT_S], len(ts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                stay = ts[a:b]
                counts = next((t for i, t in enumerate(stay) if t - stay[0] >= detect.ADD_S and i + 1 >= detect.ADD_REPORTS), None)
                stays.setdefault(veh, []).append((stay, counts))

        def running(veh, at, strictly):
            """Others that count and were seen within LEFT_S; of stays that begin to count at that second those of lesser vehicles."""
            many = 0
            for other, held in stays.items():  # noqa: B023
                for stay, counts in held:
                    seen = [t for t in stay if t <= at]
                    started = counts is not None and (counts < at or (counts == at and not strictly and other < veh))
                    many += other != veh and started and bool(seen) and at - seen[-1] < detect.LEFT_S
            return many

        for veh, held in stays.items():
            for stay, counts in held:
                if counts is None:
                    continue
                many = running(veh, counts, False)
                if many and stay[0] >= since + detect.ADD_S:
                    out.add((route, "add", veh, stay[0], many, many + 1))
                many = running(veh, stay[-1] + detect.LEFT_S, True)
                if many:
                    out.add((route, "drop", veh, stay[-1], many + 1, many))
    return out


def test_fleet_changes_of_a_stream(spark, tmp_path):
    rows = fleet_log(4)
    for part in range(5):
        spark.createDataFrame(rows[part * len(rows) // 5 : (part + 1) * len(rows) // 5], "route string, veh long, t long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("route string, veh long, t long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = {tuple(r) for r in detect.replay(spark, detect.fleet_changes(source), str(tmp_path)).collect()}
    sure = max(r[2] for r in rows) - 1500
    want = {w for w in plain_changes(rows) if w[3] < sure}
    assert {f for f in found if f[3] < sure} == want
    assert {w[1] for w in want} == {"add", "drop"} and len(want) > 12


def visit_log(seed):
    rng, rows, t = random.Random(seed), [], 0
    for veh in range(6):
        t, trip = rng.randrange(50), 1
        while t < 8000:
            stop = rng.choice([None, 1, 2, 3])
            for _ in range(rng.randrange(1, 5)):
                trip += rng.random() < 0.1
                rows.append((veh, len(rows), trip if rng.random() < 0.9 else None, stop, t))
                t += rng.choice((0, 20, 40, 120, 121, 400))
    return sorted(rows, key=lambda r: (r[4], r[1]))


def plain_visits(rows):
    """Stretches of reports at one stop without a gap over two minutes."""
    out = set()
    for veh in {r[0] for r in rows}:
        own, k = [r for r in rows if r[0] == veh], 0
        while k < len(own):
            j = k
            while j + 1 < len(own) and own[j + 1][3] == own[k][3] and own[j + 1][4] - own[j][4] <= detect.SILENT_S:
                j += 1
            if own[k][3] is not None:
                silent = j + 1 == len(own) or own[j + 1][4] - own[j][4] > detect.SILENT_S
                out.add((veh, own[k][3], own[k][2], own[k][4], own[j][4] - own[k][4], not silent, own[j][2] != own[k][2]))
            k = j + 1
    return out


def test_visits_of_a_stream(spark, tmp_path):
    rows = visit_log(5)
    kind = "veh long, event_id long, trip long, stop long, t long"
    for part in range(5):
        spark.createDataFrame(rows[part * len(rows) // 5 : (part + 1) * len(rows) // 5], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = [tuple(r) for r in detect.replay(spark, detect.visits(source), str(tmp_path)).collect()]
    sure = max(r[4] for r in rows) - 1000
    want = plain_visits(rows)
    assert len(found) == len(set(found)) and set(found) <= want
    assert {f for f in found if f[3] + f[4] < sure} == {w for w in want if w[3] + w[4] < sure}
    assert any(w[6] for w in want) and {w[5] for w in want} == {True, False}


def test_reports_at_stops(spark):
    rng = random.Random(4)
    stops = [(i, rng.uniform(0, 900), rng.uniform(0, 900)) for i in range(20)]
    lines = [(i % 3, i) for i in range(20)] + [(0, 1), (0, 1)]
    reports = [(1, i, 1, rng.randrange(4), rng.uniform(-50, 950), rng.uniform(-50, 950), rng.choice([0.0, 0.5, None, 9.0]), i) for i in range(300)] + [(1, 300, 1, 0, None, 1.0, 0.0, 1)]
    df = spark.createDataFrame(reports, "veh long, event_id long, trip long, route long, x double, y double, speed double, t long")
    out = detect.at_stops(df, spark.createDataFrame(stops, "id long, x double, y double"), spark.createDataFrame(lines, "route long, stop long"))
    want = {}
    for _, i, _, route, x, y, speed, _ in reports:
        near = [] if x is None or (speed or 0) > 1 else sorted((((x - sx) ** 2 + (y - sy) ** 2) ** 0.5, s) for s, sx, sy in stops if (route, s) in lines and (x - sx) ** 2 + (y - sy) ** 2 <= 3600)
        want[i] = near[0][1] if near else None
    assert {r.event_id: r.stop for r in out.collect()} == want and sum(s is not None for s in want.values()) > 5


def test_a_second_of_a_fleet_costs_its_reports_and_not_its_vehicles():
    from tramline.streaming import detect

    class Watched(dict):
        """Counts the vehicles that are looked at."""

        seen = 0

        def items(self):
            for x in super().items():
                Watched.seen += 1
                yield x

    fleet = detect.Fleet()
    fleet.held = Watched()
    fleet.since = 0
    for at in range(1200):
        fleet.report(at, [at % 600, 600 + at % 600])
        if not isinstance(fleet.held, Watched):
            break
    assert isinstance(fleet.held, Watched) and Watched.seen <= 4 * 2400 and len(fleet.held) == 1200
