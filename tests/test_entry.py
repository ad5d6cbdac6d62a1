"""The driver's contract, and every registered query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from brindle.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(frame):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return repr(round(float(v), 6) + 0.0) if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(one, r)) for r in frame.itertuples(index=False, name=None))


def test_entry(spark):
    got = entry_point.entry(spark).collect()
    assert {r["cluster"] for r in got} <= {1, 2, 3} and sum(r["n"] for r in got) > 0


def test_names():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert len(catalogue.SQL) > 40


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_oracle(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
