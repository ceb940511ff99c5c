"""Every placeholder of the reference in the three scalars that it guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from billoom.functions import scalars
from billoom.plans import inputs, queries

FRAGMENTS = ["n/a", "na", "none", "null", "nil", "unknown", "unbekannt", "not available", "nicht verfügbar", "illegible", "unleserlich", "unreadable", "not visible", "keine angabe", "no data"]


def test_placeholders(spark):
    texts = [t for f in FRAGMENTS for t in (f, f.upper(), f" {f} 12,50 EUR", f"{f} (2025-01-02)")]
    rows = spark.createDataFrame([(t,) for t in [*texts, "nilpf 12,50"]], "t string")
    got = rows.select("t", scalars.parse_amount(F.col("t")).alias("a"), scalars.normalise_date(F.col("t")).alias("d"), scalars.normalise_currency(F.col("t")).alias("c")).collect()
    assert {r["t"]: (r["a"], r["d"], r["c"]) for r in got} == dict.fromkeys(texts, (None, "", "")) | {"nilpf 12,50": (12.5, "", "")}


def test_queries_equal_their_sql(spark):
    import duckdb

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("orders", "part", "supplier", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name in ("parse_amount", "normalise_date", "normalise_currency"):
        got = queries.QUERIES[name](spark, folder)
        assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.ORACLE_SQL[name]).fetchall())
    assert {r["t"] for r in inputs.dates(spark, folder).collect()} >= set(FRAGMENTS)
