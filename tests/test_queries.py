"""Every registered query of the transit side against its SQL in DuckDB, on the tables of sf0.01."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from tramline.plans import registry

DIR = "/root/testdata/sf0.01"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(x):
        return round(x, 4) if isinstance(x, float) else x

    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    found = rows_of(df.columns, df.collect())
    want = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    expected = rows_of(want.columns, want.fetchall())
    assert len(found) == len(expected)
    bad = [(a, b) for a, b in zip(found, expected, strict=True) if a != b and not close(a, b)]
    assert not bad, bad[:3]


def close(a, b):
    return all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-4 * max(1, abs(x))) for x, y in zip(a, b, strict=True))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["event_id", "at", "seen"]


def test_spelling_search_finds_names_with_many_doubled_letters(spark, tmp_path):
    rows = [(1, "patr 3333333"), (2, "Patr 333333333"), (3, "patr 3333333333"), (4, "quite another")]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    found = {r.p_partkey: r.cost for r in registry.QUERIES["spelling_search"](spark, str(tmp_path)).where("q = 'patr 333'").collect()}
    # A doubled letter costs 0.5 each: four more are within the limit of 2.5, six are not.
    assert found == {1: 2.0}


def test_spelling_search_finds_the_names_meant(spark):
    found = registry.QUERIES["spelling_search"](spark, DIR).where("o = 1").join(spark.read.parquet(f"{DIR}/part.parquet"), "p_partkey").collect()
    assert {r.q: (r.p_name, r.cost) for r in found} == {"smlal ring": ("small ring", 0.6), "red widgt": ("red widget", 1.0), "bkue bolt": ("blue bolt", 0.6), "hott gear": ("hot gear", 0.5)}
