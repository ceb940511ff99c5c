"""Every registered bill query against its SQL at the smallest scale."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from billoom.plans import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, con, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cur = con.execute(queries.ORACLE_SQL[name])
    at = {d[0]: k for k, d in enumerate(cur.description)}
    assert sorted(at) == columns
    assert got == sorted(repr([plain(r[at[c]]) for c in columns]) for r in cur.fetchall()) and got
