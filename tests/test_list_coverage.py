"""What the list total covers, and cents back to amounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from billoom.functions import scalars
from billoom.operators import totals


def test_list_coverage(spark):
    rows = [("ok", 6550, "EUR"), ("ok", 9091, "eur "), ("error", None, None), ("error", 5, "EUR"), ("ok", None, "USD")]
    bills = spark.createDataFrame(rows, "status string, gross_cents long, currency string")
    assert totals.list_coverage(bills).collect() == [(5, 2, 2, 1)]
    assert totals.list_coverage(bills.limit(0)).collect() == [(0, 0, 0, 0)]
    assert [r[0] for r in bills.select(scalars.from_cents(F.col("gross_cents"))).collect()] == [65.5, 90.91, None, 0.05, None]
