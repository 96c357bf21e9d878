"""Cut operators against plain numpy versions: ties, nulls in keys and values, one hot key, empty tables, outliers."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.operators.cuts import numbered, quantiles, running
from tramline.operators.joins import asof
from tramline.operators.sequences import interval_unions

SCHEMA = "k string, id long, v double"


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    keys = ["hot"] * 600 + ["few"] * 5 + [None] * 90 + ["one"] + ["same"] * 40
    rows = [(k, i, 3.5 if k == "same" else None if rng.random() < 0.1 else rng.randint(-9, 200) / 4) for i, k in enumerate(keys)]
    rows[3] = ("hot", 3, 1e12)
    rows[4] = ("hot", 4, None)
    return rows + [("nothing", 9_999, None)]


def test_quantiles_equal_numpy(spark, data):
    qs = {"lo": 0.1, "mid": 0.5, "hi": 0.93, "top": 1.0}
    for bins in (1, 7, 1024):
        got = {r.k: r for r in quantiles(spark.createDataFrame(data, SCHEMA), ["k"], "v", qs, bins=bins).collect()}
        assert set(got) == {"hot", "few", None, "one", "same"}
        for k, r in got.items():
            values = [v for key, _, v in data if key == k and v is not None]
            assert r.n == len(values)
            assert [r[name] for name in qs] == pytest.approx([float(np.quantile(values, q)) for q in qs.values()])


def test_quantiles_count_rows_by_weight(spark):
    rows = spark.createDataFrame([(1.0, 3), (2.0, 1), (9.0, 4)], "v double, c long")
    assert [tuple(r) for r in quantiles(rows, [], "v", {"m": 0.5}, weight="c").collect()] == [(8, 5.5)]


def test_quantiles_of_nothing(spark):
    assert quantiles(spark.createDataFrame([], SCHEMA), ["k"], "v", {"m": 0.5}).collect() == []


def test_numbered_equals_sorting(spark, data):
    got = {(r.k, r.id): r.o for r in numbered(spark.createDataFrame(data, SCHEMA), ["k"], "v", "id", "o").collect()}
    want = {}
    for k in {k for k, _, _ in data}:
        order = sorted((v, i) for key, i, v in data if key == k and v is not None)
        want |= {(k, i): n for n, (_, i) in enumerate(order, 1)}
    assert got == want


@pytest.mark.parametrize("fold", ["sum", "max"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_equals_a_plain_pass(spark, data, fold, inclusive):
    rows = spark.createDataFrame(data, SCHEMA)
    got = {r.id: r.r for r in running(rows, ["k"], ["id"], F.floor(F.col("id") / 50), fold, F.col("v"), "r", inclusive).collect()}
    assert len(got) == len(data)
    for k in {k for k, _, _ in data}:
        seen = []
        for _, i, v in sorted((r for r in data if r[0] == k), key=lambda r: r[1]):
            before = list(seen)
            seen += [v] if v is not None else []
            held = seen if inclusive else before
            want = sum(held) if fold == "sum" else max(held, default=None)
            assert got[i] == want or got[i] == pytest.approx(want)


def test_running_refuses_other_folds(spark, data):
    with pytest.raises(ValueError):
        running(spark.createDataFrame(data, SCHEMA), ["k"], ["id"], F.lit(0), "min", F.col("v"), "r")


def test_unions_do_not_depend_on_the_blocks(spark):
    rng = random.Random(3)
    spans = [(rng.choice("xy"), a, a + rng.randint(1, 90)) for a in (rng.randint(0, 2000) for _ in range(60))] + [("x", 5, 1500), ("z", 0, 10), ("z", 10, 20), ("z", 21, 22)]
    rows = spark.createDataFrame(spans, "k string, a long, b long")
    want = set()
    for k in "xyz":
        inside = sorted((a, b) for key, a, b in spans if key == k)
        lo, hi = inside[0]
        for a, b in inside[1:]:
            if a > hi:
                want.add((k, lo, hi))
                lo, hi = a, b
            hi = max(hi, b)
        want.add((k, lo, hi))
    for width in (10, 333, 86_400):
        assert {tuple(r) for r in interval_unions(rows, ["k"], width).collect()} == want


@pytest.mark.parametrize("forward", [False, True])
def test_asof_sorts_once_and_joins_nothing(spark, forward):
    """Rows carried over blocks come as rows and not by a join, null keys and times included; told times and tasks change nothing."""
    left = spark.createDataFrame([(None if i % 7 == 0 else i % 2, None if i % 11 == 0 else i * 37 % 900, i) for i in range(90)], "k int, t long, event_id long")
    right = spark.createDataFrame([(None if i % 5 == 0 else i % 3, i * 211 % 900, i) for i in range(25)], "k int, t long, id long")
    args = (right, ["k"], "t", "id", [], forward)
    out = asof(left, *args, width=50)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    whole = {(r.event_id, r.at) for r in asof(left, *args, width=10**6).collect()}
    told = asof(left, *args, width=50, tasks=5, times=left.select("k", "t").unionByName(right.select("k", "t")))
    assert {(r.event_id, r.at) for r in out.collect()} == whole == {(r.event_id, r.at) for r in told.collect()}
    assert out.count() == told.count() == 90 and sum(at is not None for _, at in whole) > 40


@pytest.mark.parametrize("forward", [False, True])
def test_asof_does_not_depend_on_the_blocks(spark, forward):
    rng = random.Random(11)
    left = [(rng.choice(["hot", "hot", "cold"]), i, rng.randint(0, 900)) for i in range(80)] + [("hot", 80, None), ("none", 81, 5)]
    right = [(rng.choice(["hot", "hot", "cold"]), i, rng.randint(0, 900)) for i in range(60)] + [("hot", 60, None)]
    lrows, rrows = (spark.createDataFrame(x, f"k string, {i} long, t long") for x, i in ((left, "id"), (right, "rid")))
    want = {}
    for k, i, t in left:
        side = [(u, r) for key, r, u in right if key == k and u is not None and t is not None and (u >= t if forward else u <= t)]
        best = (min if forward else max)(side, default=(None, None))
        want[i] = best if side and abs(best[0] - t) <= 200 else (None, None)
    for width in (7, 100, 86_400):
        r = rrows.withColumn("id", F.col("rid"))
        got = asof(lrows, r, ["k"], "t", "id", ["rid"], forward=forward, max_age=200, width=width).collect()
        assert {x.id: (x.at, x.rid) for x in got} == want


def test_bins_are_as_many_as_the_rows_of_a_key_fill(spark):
    """Small keys have one bin; crowded bins are cut by value and tie, or counted."""
    from tramline.operators import cuts

    rows = spark.range(400_000).selectExpr("id", "id % 50 AS k", "CASE WHEN id % 4 = 0 THEN id ELSE 7 END AS v")
    assert cuts._spread(rows, ["k"], "v", None, cuts.BINS).where("_bin > 0").count() == 0
    found = numbered(rows, [], "v", "id", "o")
    want = sorted((i if i % 4 == 0 else 7, i) for i in range(400_000))
    assert [(r.v, r.id) for r in found.orderBy("o").collect()] == want
    assert found.agg({"o": "max"}).collect()[0][0] == 400_000
    q = cuts.quantiles(rows, [], "v", {"mid": 0.5, "high": 0.9}).collect()[0]
    values = [v for v, _ in want]
    assert q.n == 400_000 and q.mid == (values[199_999] + values[200_000]) / 2 and q.high == pytest.approx(values[359_999] + 0.1 * (values[360_000] - values[359_999]))


def test_trailing_median_equals_pairing(spark):
    from tramline.operators.cuts import trailing_median

    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1, 2]), rng.randrange(-500, 3000), rng.choice([None, float(rng.randrange(30))])) for i in range(700)]
    frame = spark.createDataFrame(rows, "id long, k long, t long, v double").repartition(5)
    want = {}
    for i, k, t, _ in rows:
        near = [x for _, b, at, x in rows if b == k and t - 60 <= at < t]
        known = [x for x in near if x is not None]
        if near:
            want[i] = (len(near), float(np.median(known)) if known else None)
    found = trailing_median(frame, ["k"], "t", "v", "id", 60, "mid", spans=2)
    assert {r.id: (r.n, r.mid) for r in found.collect()} == want
    # A row goes to two blocks at most, and rows never meet each other.
    assert "Join" not in found._jdf.queryExecution().toString()


def test_numbered_rows_keep_their_columns(spark):
    rows = [(i % 3, i * 7 % 50, i, f"s{i}", None if i % 5 else i) for i in range(200)]
    found = numbered(spark.createDataFrame(rows, "veh long, t long, id long, stop string, due long"), ["veh"], "t", "id", "pos", bins=4, keep=["stop", "due"])
    want, place = set(), {}
    for veh, t, i, stop, due in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        place[veh] = place.get(veh, 0) + 1
        want.add((veh, t, i, stop, due, place[veh]))
    assert {tuple(r) for r in found.select("veh", "t", "id", "stop", "due", "pos").collect()} == want
