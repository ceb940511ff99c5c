"""Normalising scalars and totals on the cases of FIXTURES.md."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from billoom.functions import scalars
from billoom.operators import totals

AMOUNTS = {"1190.00": 1190, "1190,00": 1190, "1.190,00": 1190, "1'190.00": 1190, "€ 1.190,00": 1190, "EUR 18,48": 18.48, "18,48-": 18.48, "-35,01": -35.01, "SUMME -35,01": -35.01, "-1.190,00": -1190, "1.190.000,55": 1190000.55, "42": 42, "0,00": 0, "0.123": 0.123, "1190.000": 1190, "-0.123": -123, "-123.456": -123.456, "123.456": 123456, "134,60.": 13460, "1,190,00": None, "1,190,000": 1190000, "12-5": 125, "": None, "N/A": None, "-": None, "unbekannt": None, "EUR": None}
DATES = {"2025-05-07": "2025-05-07", "2025-05-07T11:37:45": "2025-05-07", "07/05/2025": "2025-05-07", "01.05.2025 - 07.09.2025": "2025-05-01", "17.07.25": "2025-07-17", "20250717": "2025-07-17", " 17.07.2025 11:37:45 ": "2025-07-17", "": "", "not visible": "", "01341698": "", "17.13.2025": "", "gestern": "", "31.02.2025": "2025-02-31", "70.23.22.57": ""}
CURRENCIES = {"€": "EUR", "eur": "EUR", "Euro": "EUR", "$": "USD", "£": "GBP", "CHF": "CHF", "PLN": "PLN"}


@pytest.mark.parametrize("f, cases", [(scalars.parse_amount, AMOUNTS), (scalars.normalise_date, DATES), (scalars.normalise_currency, CURRENCIES)])
def test_scalars(spark, f, cases):
    got = {r["t"]: r["x"] for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", f(F.col("t")).alias("x")).collect()}
    assert got == {k: pytest.approx(v) if isinstance(v, float) else v for k, v in cases.items()}


def test_totals(spark):
    rows = [("a", 1, 3, "ok", 6550, "EUR"), ("a", 2, 3, "ok", 9091, "eur "), ("a", 3, 3, "error", None, None), ("b", 1, 5, "ok", 100, "USD"), ("b", 2, 5, "ok", None, "USD")]
    bills = spark.createDataFrame(rows, "path string, page int, page_count int, status string, gross_cents long, currency string")
    assert {(r["path"], r["currency"], r["cents"]) for r in totals.file_totals(bills).collect()} == {("a", "EUR", 15641), ("b", "USD", 100)}
    cover = {r["path"]: r for r in totals.file_coverage(bills).collect()}
    assert (cover["a"]["failed"], cover["a"]["complete"], cover["b"]["unamounted"], cover["b"]["expected"]) == (1, False, 1, 5)
