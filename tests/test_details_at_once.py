"""Text and markup of a bill's details made at once equal those by way of entries; money in the cheaper way equals the format's."""

from __future__ import annotations

from pyspark.sql import functions as F

from billoom.functions import render


def test_with_details(spark):
    rows = spark.createDataFrame([("a.pdf", "/in/a.pdf", 1, 2, "ok", "A & <B>\nC", "2025-01-02", "EUR", 12.5, True, ["x", "<y>"], {"z": "1", "b": "&", "file": "no", "e": ""}), (None, "", None, None, None, None, None, None, None, None, None, None), ("b", "b", 1, 1, "error", "", "", "", -0.001, False, [], {})], "file string, path string, bill int, bill_count int, status string, vendor string, date string, currency string, gross_total double, has_text_layer boolean, notes array<string>, extra map<string,string>")
    bill, extra = {c: F.col(c) for c in rows.columns if c != "extra"}, F.col("extra")
    e = render.details(bill, extra)
    got = render.with_details(rows.withColumn("want", F.struct(render.details_text(e), render.details_html(e))), bill, extra).collect()
    assert [(r["text"], r["html"]) for r in got] == [tuple(r["want"]) for r in got] and got[0]["html"].count("<b>") == 2
    assert render.with_details(rows, {}).first()["text"] == ""


def test_money_as_formatted(spark):
    values = [0.0, -0.0, 0.004, -0.004, 0.005, 0.01, -0.015, 1.005, 2.675, 1e12 + 0.125, 1e13 + 0.5, 1e17, -123456.785, float("nan"), float("inf"), None]
    rows = spark.createDataFrame([(x,) for x in values], "x double")
    for got, want in rows.select(render.bare_money(F.col("x")), F.when(F.col("x").isNotNull(), F.replace(F.format_string("%.2f", "x"), F.lit("."), F.lit(",")))).collect():
        assert got == want
