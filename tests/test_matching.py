"""Operators of matching.py on crafted rows, against plain versions and known cases."""

from __future__ import annotations

import math
import random

import pytest

from tramline.operators import beside, matching
from tramline.streaming import detect


@pytest.mark.parametrize("most", [0, 7, 60, 5000])
def test_paired_is_the_plain_greedy_match(spark, most):
    rng = random.Random(most)
    left = [(rng.randrange(3), rng.randrange(1500), i) for i in range(150)]
    right = [(rng.randrange(3), rng.randrange(1500), i) for i in range(130)]
    used, want = set(), set()
    for key, t, i in sorted(left, key=lambda r: (r[1], r[2])):
        near = [(abs(at - t), at, j) for k, at, j in right if k == key and j not in used and abs(at - t) <= most]
        if near:
            used.add(min(near)[2])
            want.add((key, i, min(near)[2]))
    frame = lambda rows: spark.createDataFrame([*rows, (None, 5, 900), (1, None, 901)], "veh long, t long, id long").repartition(4)
    assert {tuple(r) for r in matching.paired(frame(left), frame(right), ["veh"], most).collect()} == want
    assert matching.paired(frame([]), frame(right), ["veh"], most).count() == 0


def test_other_trip_leaves_trips_not_begun_or_already_past(spark):
    asked = spark.createDataFrame([(1, 7, "own", "s", 1000, 400, None), (2, 7, "own", "s", 1000, 400, 950)], "id long, veh long, trip string, stop string, arrival long, t long, visit long")
    schema = "veh long, trip string, stop string, seq int, seen long, until long, pred long"

    def run(*rows):
        return {r.id: r.pred for r in matching.other_trip(asked, spark.createDataFrame([(7, *r) for r in rows], schema)).collect()}

    fits = ("b", "s", 4, 300, 900, 1010)
    assert run(fits) == {1: 1010}  # the second asks after a visit that the forecast is older than
    assert run(fits, ("c", "s", 5, 100, 500, 990)) == {1: 990}
    assert run(fits, ("b", "first", 1, 0, 900, 300)) == {}  # its first stop is on show
    assert run(fits, ("b", "later", 6, 0, 900, 800)) == {}  # a later stop comes earlier
    assert run(fits, ("b", "later", 6, 0, 399, 800)) == {1: 1010}  # no more on show
    assert run(("own", "s", 4, 300, 900, 1010)) == {} and run(("b", "s", 4, 300, 900, 369)) == {}


def test_side_by_side_bridges_one_bin(spark):
    def track(veh, bins, y=0.0):
        return [(veh, 1, veh * 1000 + b, b * 30, 24.9, y, True) for b in bins]

    rows = [*track(1, range(12)), *track(2, [0, 1, 2, 4, 5, 6], 20.0), *track(3, [0, 1, 2, 5, 6, 7], -24.0), *track(4, range(12), 300.0)]
    out = matching.side_by_side(spark.createDataFrame(rows, "veh long, route long, id long, t long, x double, y double, moving boolean"))
    assert [tuple(r) for r in out.collect()] == [(1, 2, 0, 210, 6)]


SIDE = "veh long, route long, id long, t long, x double, y double, moving boolean"


def plain_side_by_side(rows, metres):
    first = {}
    for veh, route, id_, t, x, y, moving in rows:
        new = ((t, id_), route, x, y, moving)
        first[veh, t // 30] = min(first.get((veh, t // 30), new), new, key=lambda r: r[0])
    bins = {}
    for (veh, b), (_, route, x, y, moving) in first.items():
        if moving:
            bins.setdefault(b, []).append((veh, route, x, y))
    met = {}
    for b, there in sorted(bins.items()):
        for one, r, x, y in there:
            for two, s, x2, y2 in there:
                if one < two and r == s and ((x - x2) ** 2 + (y - y2) ** 2) ** 0.5 <= metres:
                    met.setdefault((one, two), []).append(b)
    out = set()
    for (one, two), at in met.items():
        run = []
        for b in [*at, at[-1] + 9]:
            if run and b - run[-1] > 2:
                if len(run) >= 6:
                    out.add((one, two, run[0] * 30, (run[-1] + 1) * 30, len(run)))
                run = []
            run.append(b)
    return out


@pytest.mark.parametrize("width", [21, 40, 2880])
def test_side_by_side_over_borders_groups_and_changed_routes(spark, monkeypatch, width):
    """Runs over several chunks, groups of few tracks, vehicles that change the route together and apart: all runs as by a plain loop."""
    monkeypatch.setattr(matching, "SIDE_GROUP", 4)
    monkeypatch.setattr(matching, "SIDE_GROUPS", 3)
    monkeypatch.setattr(matching, "SIDE_TASKS", 8)
    rng, rows = random.Random(width), []
    for veh in range(14):
        x, route, start = rng.uniform(0, 30), rng.randrange(2), rng.randrange(-40, 20)
        for b in range(start, start + 110):
            x += rng.uniform(-6, 6)
            route = b // 37 % 2 if veh < 5 else rng.randrange(2) if rng.random() < 0.02 else route
            for _ in range(rng.choice((0, 1, 1, 1, 1, 1, 1, 2))):
                rows.append((veh, route, len(rows), b * 30 + rng.randrange(30), x, rng.uniform(0, 12), rng.random() < 0.95))
    want = plain_side_by_side(rows, 20.0)
    out = matching.side_by_side(spark.createDataFrame(rows, SIDE).repartition(3), 20.0, width).collect()
    assert len(want) > 40 and len(out) == len(want) and {tuple(r) for r in out} == want


def test_side_by_side_shuffles_tracks_not_pairs(spark):
    """A crowd of one route: every vehicle is beside every other in each bin, and rows shuffled stay near the number of reports."""
    rows = [(veh, 1, veh * 10 + b, b * 30, 0.01 * veh, 0.0, True) for veh in range(300) for b in range(6)]
    rows += [(veh, route, veh * 10 + b, b * 30, 9.0e6 + 1e5 * veh, float("nan") if veh == 402 else 0.0, True) for veh, route in ((401, 1), (402, 1), (403, None)) for b in range(6)]
    shuffled = lambda: sum(s.shuffleWriteRecords() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)))
    before = shuffled()
    out = matching.side_by_side(spark.createDataFrame(rows, SIDE))
    assert {tuple(r)[2:] for r in out.collect()} == {(0, 180, 6)} and out.count() == 300 * 299 // 2
    assert shuffled() - before < 20 * len(rows)


def test_the_limit_of_side_by_side_is_a_root(spark):
    """Squares are compared with the largest one whose root is within the metres, as in the SQL."""
    for metres in (5.0, 0.3, 25.0, 1e-3):
        s = beside.squared_limit(metres)
        assert math.sqrt(s) <= metres < math.sqrt(math.nextafter(s, math.inf))


def test_clock_restarts_by_route_gap_or_distance(spark):
    rows = [(1, 9, 1, 0, 0.0), (2, 9, 1, 500, 60.0), (3, 9, 1, 1000, 70.0), (4, 9, 1, 1100, 90.0), (5, 9, 2, 1200, 90.0), (6, 9, 2, 1801, 90.0)]
    out = matching.still_since(spark.createDataFrame(rows, "id long, veh long, route long, t long, x double"), 80.0, lambda a, b: abs(a[0] - b[0]), ["x"])
    assert {r.id: r.since for r in out.collect()} == {1: 0, 2: 0, 3: 0, 4: 1100, 5: 1200, 6: 1801}


def test_one_empty_answer_is_held(spark):
    polls = spark.createDataFrame([("f", 0, 3), ("f", 15, 0), ("f", 25, 0), ("f", 40, 2), ("f", 71, 0), ("g", 10, 0)], "feed string, t long, n long")
    out = {(r.feed, r.t): r.shown_t for r in matching.lists_held(polls, ["feed"]).collect()}
    assert out == {("f", 0): 0, ("f", 15): 0, ("f", 25): None, ("f", 40): 40, ("f", 71): None, ("g", 10): None}


def test_places_go_to_the_first_kept_one(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["Hall", "hall ", "Library"]), rng.randrange(2), rng.uniform(0, 900), 0.0) for i in range(200)]
    kept, want = {}, {}
    for i, name, rank, y, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        mine = kept.setdefault(name.lower().strip(), [])
        want[i] = next((k for k, there in mine if abs(there - y) < matching.SAME_PLACE_M), i)
        if want[i] == i:
            mine.append((i, y))
    out = matching.places_merged(spark.createDataFrame(rows, "id long, name string, rank int, y double, x double"), lambda a, b: abs(a[0] - b[0]))
    assert {r.id: r.kept_id for r in out.collect()} == want


def test_off_route_needs_two_linked_reports(spark):
    rows = [
        (1, 1, 1, 0, 300.0, False, False), (2, 1, 1, 30, 300.0, False, False), (3, 1, 1, 45, 260.0, False, False),  # far for 45 s
        (4, 2, 1, 0, 600.0, False, False), (5, 2, 1, 5, 600.0, False, False), (6, 2, 2, 9, 600.0, False, False),  # fast; then another route
        (7, 3, 1, 0, 130.0, True, False), (8, 3, 1, 120, 130.0, True, False), (9, 3, 1, 130, 90.0, True, False), (10, 3, 1, 240, 130.0, True, False),
        (11, 4, 1, 0, 600.0, False, True), (12, 4, 1, 5, 600.0, False, True), (13, 5, 1, 0, 900.0, False, False), (14, 5, 1, 601, 900.0, False, False),
        (15, 6, 1, 0, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id long, veh long, route long, t long, off double, corridor boolean, detour boolean")
    assert {r.id for r in matching.off_route(df).where("hidden").collect()} == {3, 5, 8}


def test_numbers_are_held_for_a_missing_vehicle(spark):
    polls = {0: [1, 2, 3], 15: [1, 3], 30: [1, 3], 60: [1, 3], 61: [3], 75: [1, 3], 90: [2, 3]}
    rows = [("f", t, v, 9) for t, vs in polls.items() for v in vs]
    out = {}
    for r in matching.held_numbers(spark.createDataFrame(rows, "feed string, t long, veh long, route long")).collect():
        out.setdefault(r.t, {})[r.veh] = r.number
    three = {1: 1, 2: 2, 3: 3}
    # Vehicle 2 is first missing at 15, so it keeps its place until 60; vehicle 1 is held at 61 and again at 90.
    assert out == {0: three, 15: three, 30: three, 60: three, 61: {1: 1, 3: 2}, 75: {1: 1, 3: 2}, 90: three}


def test_replay_takes_only_what_it_disproves(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "id long, t long, veh long")
    live, again = rows((1, 100, 1), (2, 500, 1), (3, 900, 1)), rows((11, 130, 1), (12, 2000, 1))
    disproved = spark.createDataFrame([(1,), (2,)], "id long")
    out = matching.replay_applied(live, again, disproved, ["veh"], 60)
    assert {(r.id, r.source) for r in out.collect()} == {(1, "live"), (3, "live"), (12, "replay")}


def test_alert_versions_go_on_after_a_restart(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, "alert long, version string, t long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema("alert long, version string, t long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return {tuple(r) for r in detect.versions_seen(spark, stream, str(tmp_path), "alerts").collect()}

    put([])
    assert run() == set()
    put([(1, "a", 5), (1, "b", 9)])
    put([(1, "a", 2)])
    assert run() == {(1, "a", 2, 5, 2), (1, "b", 9, 9, 1)}
    put([(1, "a", 7)])
    assert run() == run() == {(1, "a", 2, 7, 3), (1, "b", 9, 9, 1)}
