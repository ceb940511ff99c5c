"""Boxes are sorted once: no window beside the fold."""

from __future__ import annotations

from billoom.sources import files


def test_one_sort_no_window(spark):
    rows = [("f", 1, 0.0, 0.4, 4.0, 8.4, "b"), ("f", 1, 0.0, 0.0, 4.0, 8.0, "c"), ("f", 1, -9.0, 0.8, -5.0, 8.8, "a"), ("f", 1, 0.0, 40.0, 4.0, 48.0, "d"), (None, 1, 0.0, 0.0, 1.0, 1.0, "  ")]
    df = files.layout_rows(spark.createDataFrame(rows, "path string, page int, x0 double, y0 double, x1 double, y1 double, text string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Sort [") == 1
    assert [tuple(r) for r in df.collect()] == [("f", 1, "a b c\nd")]
