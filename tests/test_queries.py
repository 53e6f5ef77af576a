"""Each query against its SQL, on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from tarnkite.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else p / '*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.8g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.8g}" if abs(v) < 1e6 else str(v)
    return v if v is None else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    found = df.collect()
    if name in ORACLE_SQL:
        want = db.sql(ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, found) == rows(want.columns, want.fetchall())


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
