"""Track operators, folds, sources and sinks on small crafted tables, against plain versions and known cases."""

from __future__ import annotations

import json
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tramline.functions.spelling import spelling_cost
from tramline.operators import sequences, tracks
from tramline.sources import tables


def reports(seed=4, n=900, keys=5):
    rng = random.Random(seed)
    return [(i, rng.randrange(keys), rng.randrange(4000), round(rng.uniform(0, 60), 3), rng.randrange(4)) for i in range(n)]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(reports(), "event_id long, veh long, t long, value double, rank int").repartition(3)


def by_key(order):
    out = {}
    for r in sorted(reports(), key=order):
        out.setdefault(r[1], []).append(r)
    return out


def test_spelling_costs():
    known = {("palvesky", "palevsky"): 0.6, ("regenstwin", "regenstein"): 0.6, ("regensteen", "regenstein"): 0.7, ("mansuetto", "mansueto"): 0.5, ("abc", "abc"): 0, ("a1", "a2"): 1.5}
    assert {pair: spelling_cost(*pair) for pair in known} == known


def test_first_hit_merge(spark, log):
    want = set()
    for rows in by_key(lambda r: r[0]).values():
        kept = []
        for event, _, t, _, rank in rows:
            hit = next((p for p in kept if abs(t - p[0]) <= 30), None)
            if hit is None:
                kept.append([t, rank, event])
            elif rank > hit[1]:
                hit[1:] = [rank, event]
        want |= {p[2] for p in kept}
    assert {r.event_id for r in sequences.ranked_merge(log, ["veh"], 30).collect()} == want
    # A row that takes a place leaves it where it was: 250 is near 0, 520 is not.
    few = spark.createDataFrame([(1, 1, 0, 0), (2, 1, 250, 1), (3, 1, 520, 1)], "event_id long, veh long, t long, rank int")
    assert {r.event_id for r in sequences.ranked_merge(few, ["veh"], 300).collect()} == {2, 3}


def test_anchored_keeps_two_and_chained_one(spark):
    rows = spark.createDataFrame([(i, 1, 200 * i) for i in range(3)], "event_id long, veh long, t long")
    assert {r.event_id for r in sequences.anchored(rows, ["veh"], "t", 300, "event_id").collect()} == {0, 2}
    assert {r.event_id for r in sequences.chained(rows, ["veh"], "t", 300, "event_id").where("NOT repeat").collect()} == {0}


def test_decayed_levels(log):
    found = {r.event_id: r.level for r in sequences.decayed(log, ["veh"], 500.0).collect()}
    for rows in by_key(lambda r: (r[2], r[0])).values():
        level, last = 0.0, None
        for event, _, t, value, _ in rows:
            level *= math.exp(-(t - last) / 500) if last is not None else 0
            assert math.isclose(found[event], level, abs_tol=1e-9)
            level, last = level + 0.5 * (value - level), t


def test_kalman_follows_a_line_and_syncs_after_three_rejects(spark):
    rows = [(i, 1, i, 10.0 * i) for i in range(30)] + [(30 + i, 1, 30 + i, 9000.0) for i in range(6)]
    rows += [(100 + i, 2, i, 100.0 - 10 * i) for i in range(5)]
    found = {r.event_id: r for r in sequences.smoothed(spark.createDataFrame(rows, "event_id long, veh long, t long, value double"), ["veh"]).collect()}
    assert abs(found[29].estimate - 290) < 2
    assert [found[30 + i].rejected for i in range(4)] == [1, 1, 1, 0] and found[33].estimate > 400
    # Velocity is not below 0: a vehicle that seems to roll back is not predicted further back.
    assert found[104].estimate > 60


def test_standing_since(log):
    found = {r.event_id: r.since for r in tracks.standing_since(log, ["veh"], 15.0, lambda a, b: abs(a[0] - b[0]), ["value"], id_="event_id").collect()}
    for rows in by_key(lambda r: (r[2], r[0])).values():
        anchor = None
        for event, _, t, value, _ in rows:
            if anchor is None or abs(anchor[1] - value) > 15:
                anchor = (t, value)
            assert found[event] == anchor[0]


def test_segments_by_rule(spark):
    kind = "id long, trip string, stop string, t long, prev_stop string, prev_t long, dist double, speed double, dwell double"
    rows = [
        (1, "a", "s0", 1000, None, None, 0.0, None, 20.0), (2, "a", "s1", 1100, "s0", 1000, 400.0, None, None), (3, "a", "s2", 3000, "s1", 1100, 400.0, None, None),
        (4, "a", "s3", 1101, "s1", 1100, 400.0, None, None), (5, "a", "s4", 1150, "s1", 1100, 1900.0, None, None), (6, "a", "s5", 1200, "s1", 1100, 2500.0, None, None),
        (7, "a", "s6", 1200, "s1", 1100, 400.0, 8.0, None), (8, "a", "s7", 1200, "s1", 1100, 0.0, None, None), (9, "a", "s0", 1000, None, None, 0.0, None, None),
    ]
    found = {r.id: (r.seg, r.dwell_before, r.run) for r in tracks.segments(tracks.previous_dwell(spark.createDataFrame(rows, kind))).collect()}
    assert found == {2: (100, 20.0, 80.0), 6: (100, None, 100.0), 7: (100, 50.0, 50.0)}


def test_drops_stay_unknown_until_the_log_is_long_enough(spark):
    rows = [("r", "a", t) for t in range(0, 6001, 60)] + [("r", "b", t) for t in range(0, 1201, 60)] + [("r", "b", t) for t in range(2400, 3001, 60)] + [("r", "c", t) for t in range(0, 4801, 60)]
    rows += [("q", "d", t) for t in range(0, 601, 60)]
    found = {(r.veh, r.t): (r.before, r.after, r.lasting) for r in tracks.drops(spark.createDataFrame(rows, "route string, veh string, t long"), 6000).collect()}
    assert found == {("b", 1200): (3, 2, 0), ("b", 3000): (3, 2, 1), ("c", 4800): (2, 1, None)}


def test_fillers(spark):
    rows = [(1, 0, 100), (1, 1, 102), (1, 2, 105), (1, 3, 200), (1, 4, 199), (2, 0, 50)]
    found = {(r.trip, r.seq): r.kind for r in tracks.fillers(spark.createDataFrame(rows, "trip long, seq int, predicted long"), ["trip"]).collect()}
    assert found == {(1, 0): "head", (1, 1): "filler", (1, 2): "filler", (1, 3): "normal", (1, 4): "normal", (2, 0): "normal"}


def test_sources_and_sinks(spark, tmp_path):
    names = [part.split()[0] for part in tables.PREDICTIONS.split(", ")]
    good, other = ",".join(str(i) for i in range(len(names))), ",".join(["7"] * (len(names) - 1))
    (tmp_path / "p.csv").write_text("\n".join([",".join(names), good, other, "x,1", good + ",9,9"]) + "\n")
    rows, bad = tables.csv_rows(spark, str(tmp_path / "p.csv"), tables.PREDICTIONS)
    assert sorted(r.epoch for r in rows.collect()) == [0, 7] and bad.count() == 2
    with pytest.raises(ValueError):
        tables.csv_rows(spark, str(tmp_path / "p.csv"), tables.ARRIVALS.replace("ts_utc", "utc"))
    report = ["v1", "t", "r", 1.0, 2.0, 0, 3.0, 0, "s", "x", 500]
    lines = [{"t": 510, "h": 1, "v": [report]}, {"t": 520, "h": 1, "v": [report, [*report[:10], 515]]}, {"t": 530, "h": 1, "v": []}]
    (tmp_path / "polls.json").write_text("\n".join([*map(json.dumps, lines), "{broken"]) + "\n")
    polls = {(r.veh, r.vt): r.t for r in tables.raw_polls(spark, str(tmp_path / "polls.json")).collect()}
    assert polls == {("v1", 500): 510, ("v1", 515): 520}
    updates = [["v", "t", "s", 1, 9, 2, 100, 120], ["v", "t", "s", 1, 9, 2, 90, 130], [None, "t", "s", 5, 9, 2], ["short"]]
    (tmp_path / "updates.json").write_text("\n".join(map(json.dumps, updates)) + "\n")
    found = {(r.veh, r.made): (r.seen, r.last) for r in tables.prediction_updates(spark, str(tmp_path / "updates.json")).collect()}
    assert found == {("v", 1): (90, 130), (None, 5): (5, 5)}
    out = str(tmp_path / "days")
    tables.overwrite_days(spark.createDataFrame([(1, "a"), (2, "b")], "x int, service_day string"), out)
    tables.overwrite_days(spark.createDataFrame([(9, "b")], "x int, service_day string"), out)
    assert {(r.x, r.service_day) for r in spark.read.parquet(out).collect()} == {(1, "a"), (9, "b")}
    same = spark.createDataFrame([('{"b": 1, "a": [2]}',), ('{"a": [2],  "b": 1}',), ('{"a": [3], "b": 1}',)], "j string")
    ids = [r.i for r in same.select(tables.content_id(F.from_json("j", "MAP<STRING, STRING>")).alias("i")).collect()]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 12
    numbers = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("Infinity",), (None,)], "s string")
    assert [r.n for r in numbers.select(tables.number(F.col("s")).alias("n")).collect()] == [1.5, None, None, None, None]
    before, after = spark.createDataFrame([("a", 3), ("b", 2)], "family string, n long"), spark.createDataFrame([("a", 4), ("b", 1)], "family string, n long")
    assert [(r.family, r.lost) for r in tables.rows_lost(before, after, ["family"]).collect()] == [("b", 1)]
    feed = spark.createDataFrame([('{"entity": [{"id": "1"}], "header": {"timestamp": 5}}',), ('{"entity": 3}',), ("no json",)], "value string")
    fine, quarantine = tables.checked_feed(feed, "header STRUCT<timestamp: LONG>, entity ARRAY<STRUCT<id: STRING>>", "header.timestamp IS NOT NULL AND entity IS NOT NULL")
    assert [r.feed.header.timestamp for r in fine.collect()] == [5] and quarantine.count() == 2


def test_streams_over_several_files_and_a_restart(spark, tmp_path):
    """Arrivals and silences are the same in many micro-batches, over a restart, and late rows are dropped."""
    from tramline.streaming import detect

    kind = "event_id long, veh long, stop string, t long"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def put(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
        found = detect.replay(spark, detect.arrivals(stream), out, "arrivals").collect()
        gone = detect.replay(spark, detect.silences(stream, "0 seconds"), out, "silences").collect()
        return sorted((r.veh, r.stop, r.t) for r in found), sorted((r.veh, r.last_t) for r in gone)

    put([(1, 1, "a", 0), (3, 1, "b", 200), (2, 1, "a", 100), (4, 2, "a", 50)])
    assert run()[0] == [(1, "a", 0), (1, "b", 200), (2, "a", 50)]
    put([(5, 1, "c", 150), (6, 1, "b", 300), (7, 1, "c", 400)])  # the first is late
    put([(8, 2, "a", 2000), (9, 1, "c", 2000)])
    put([(10, 3, "z", 2600)])
    found, gone = run()
    assert found == [(1, "a", 0), (1, "b", 200), (1, "c", 400), (1, "c", 2000), (2, "a", 50), (2, "a", 2000), (3, "z", 2600)]
    assert gone == []  # both were back before the clock, which trails by a batch, had passed them
    put([(11, 3, "z", 9000)])
    put([(12, 3, "z", 9100)])
    assert {(1, 2000), (2, 2000)} <= set(run()[1])


def test_jumps_at_the_limit_count_by_the_difference_itself(spark, tmp_path):
    from tramline.plans import registry

    pairs = [(i / 100, (i + 500) / 100) for i in range(0, 6000, 7)]
    rows = [(2 * u + j, f"2024-01-01 00:0{j}:00", u, "view", v, '{"k": 1}') for u, pair in enumerate(pairs) for j, v in enumerate(pair)]
    made = spark.createDataFrame(rows, "event_id long, at string, user_id long, event_type string, value double, props string")
    made.withColumn("ts", F.col("at").cast("timestamp_ntz")).drop("at").write.parquet(f"{tmp_path}/events.parquet")
    found = registry.QUERIES["position_jumps"](spark, str(tmp_path))
    assert {r.veh for r in found.collect()} == {u for u, (a, b) in enumerate(pairs) if (b - a) * 100 >= 500}


def test_first_hit_merge_makes_one_table_a_batch(monkeypatch):
    rows = pd.DataFrame([(v, 0, 10 * v, v % 3, v) for v in range(500)], columns=["veh", "_stretch", "t", "rank", "event_id"])
    run, plain, made = sequences._first_hits(["veh", "_stretch"], 60), pd.DataFrame, []
    monkeypatch.setattr(sequences.pd, "DataFrame", lambda *a, **k: made.append(1) or plain(*a, **k))
    out = list(run(iter([rows[:250], rows[250:]])))
    assert [i for t in out for i in t["event_id"]] == list(range(500)) and len(made) == 3
