"""Every registered query of the core against its SQL equivalent on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

from lexiloom.plans.queries import oracle_sql, queries


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def test_equal_to_sql(spark, data, duck):
    wrong = []
    for name, f in queries().items():
        df = f(spark, data)
        got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
        if name in oracle_sql():
            cur = duck.execute(oracle_sql()[name])
            cols = [c[0] for c in cur.description]
            rows = [dict(zip(cols, r)) for r in cur.fetchall()]
            if sorted(cols) != sorted(df.columns) or sorted((tuple(plain(r[c]) for c in sorted(cols)) for r in rows), key=str) != got:
                wrong.append(name)
    assert wrong == []


def test_no_oracle_without_query():
    assert set(oracle_sql()) <= set(queries())
