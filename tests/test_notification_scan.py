"""Lines and sums of a file come out of one reading of its bills."""

from __future__ import annotations

from billoom.plans import queries


def test_one_scan_one_shuffle(spark):
    plan = queries.QUERIES["notification"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange") == 1 and "Join" not in plan
