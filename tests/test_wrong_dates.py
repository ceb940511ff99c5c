"""The expectation query on orders of every day: its wrong date is the date of none."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from billoom.plans import queries


def test_no_order_has_the_wrong_date(spark, tmp_path):
    days = spark.range(0, 12 * 1500).select(F.col("id").alias("o_orderkey"), F.expr("timestamp '1996-01-01 00:00:00' + make_interval(0, 0, 0, id div 12)").alias("o_orderdate"), (F.col("id") * 1.25).alias("o_totalprice"))
    days.write.parquet(str(tmp_path / "orders.parquet"))
    df = queries.QUERIES["expectation"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL['expectation']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) == 18_000
