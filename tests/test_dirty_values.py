"""Values that no number can hold, images without an edge, money with a locale's grouping: rows of nulls, never an error."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from billoom.functions import render
from billoom.functions import scalars as S


def test_amounts_without_cents(spark):
    rows = spark.createDataFrame([(x,) for x in (float("nan"), float("inf"), float("-inf"), 1e300, -1e300, 0.005, -0.005, None)], "x double")
    assert [r[0] for r in rows.select(S.to_cents(F.col("x"))).collect()] == [None, None, None, None, None, 1, -1, None]


def test_endless_digits(spark):
    rows = spark.createDataFrame([("9" * 400,), ("1" * 300,), ("9" * 400 + ",00",), ("12",)], "t string")
    got = rows.select(S.parse_amount(F.col("t")).alias("a")).select("a", S.to_cents(F.col("a")).alias("c")).collect()
    assert [(r["a"] is None, r["c"]) for r in got] == [(True, None), (False, None), (True, None), (False, 1200)]


@pytest.mark.parametrize("width, height", [(0, 5000), (5000, 0), (-3, 5000), (0, 0), (None, 5000), (5000, None)])
def test_no_image(spark, width, height):
    rows = spark.createDataFrame([(width, height)], "w int, h int")
    r = rows.select(S.downscale(F.col("w"), F.col("h"), 1600, 700).alias("d"), S.zoom(F.col("w").cast("double"), F.col("h").cast("double")).alias("z"), S.ocr_factor(F.col("w"), F.col("h")).alias("o"), render.zoom_notes(F.col("w").cast("double"), F.col("h").cast("double")).alias("n")).first()
    assert r["d"] is None and r["z"] == 200 / 72 and r["n"] == [] and r["o"] >= 1


def test_floor_never_magnifies(spark):
    rows = spark.createDataFrame([(4000, 500), (4000, 2000), (100, 100)], "w int, h int")
    got = [tuple(r["d"]) for r in rows.select(S.downscale(F.col("w"), F.col("h"), 1600, 700).alias("d")).collect()]
    assert got == [(1.0, 4000, 500), (0.4, 1600, 800), (1.0, 100, 100)]


def test_grouped_money(spark):
    rows = spark.createDataFrame([(1234567.5,), (-1234.0,), (12.0,), (None,)], "x double")
    swiss, german = (render.money(F.col("x"), F.lit("EUR"), d, g) for d, g in ((".", "'"), (",", ".")))
    assert [tuple(r) for r in rows.select(swiss, german).collect()] == [("1'234'567.50 EUR", "1.234.567,50 EUR"), ("-1'234.00 EUR", "-1.234,00 EUR"), ("12.00 EUR", "12,00 EUR"), (None, None)]
