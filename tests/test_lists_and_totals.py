"""Totals, runs, merging and comparison on the cases of FIXTURES.md sections 4 and 7, with nulls, repeats and empty tables."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from billoom.functions import render, scalars
from billoom.operators import lists, store, totals

BILL = "path string, page int, page_count int, status string, gross_cents long, currency string, vendor string, date string, error string"


def bills(spark, rows):
    return spark.createDataFrame([(*r, *(None,) * (9 - len(r))) for r in rows], BILL)


CASES = [
    ([("a", 1, 3, "ok", 6550, "EUR"), ("a", 2, 3, "ok", 9091, "EUR"), ("a", 3, 3, "ok", 2135, "EUR")], "177,76 EUR", "3 bills", "177,76"),
    ([("a", 1, 2, "ok", 1000, "EUR"), ("a", 2, 2, "ok", 500, "USD")], "10,00 EUR + 5,00 USD", "2 bills", ""),
    ([("a", 1, 2, "ok", 100, "EUR"), ("a", 2, 2, "ok", 200, " eur ")], "3,00 EUR", "2 bills", "3,00"),
    ([("a", 1, 3, "ok", 1000, "EUR"), ("a", 2, 3, "ok", None, "EUR"), ("a", 3, 3, "ok", 500, "EUR")], "15,00 EUR", "2 of 3 bills, 1 without an amount", "15,00"),
    ([("a", 1, 3, "ok", 1000, ""), ("a", 2, 3, "error", 7, "EUR"), ("a", 3, 3, None, 500, "EUR")], "10,00", "1 of 3 bills, 2 unread", "10,00"),
    ([("a", 1, 5, "ok", 6550, "EUR"), ("a", 2, 5, "ok", 9091, "EUR")], "156,41 EUR", "2 of 5 bills", "156,41"),
    ([("a", 1, 1, "error", None, None)], "", "0 of 1 bill, 1 unread", ""),
]


@pytest.mark.parametrize("rows, money, covered, bare", CASES)
def test_sums(spark, rows, money, covered, bare):
    got = totals.file_sums(bills(spark, rows)).select(render.joined_money(F.col("parts")), totals.coverage_text(), render.bare_amount(F.col("parts"))).collect()
    assert [tuple(r) for r in got] == [(money, covered, bare)]
    for f in (totals.file_sums, totals.file_totals, totals.file_coverage, totals.archivable, totals.sum_lines):
        assert f(bills(spark, [])).count() == 0


def test_lists_of_bills(spark):
    rows = bills(spark, [("a", 1, 2, "ok", 100, "eur"), ("b", 1, 1, "ok", 50, "EUR"), ("b", 2, 1, "ok", 7, "USD"), ("c", 1, 1, None, 1, "EUR")])
    assert {tuple(r) for r in totals.list_total(rows).collect()} == {("eur", 150, 2, 4, 1, 0, False), ("USD", 7, 1, 4, 1, 0, False)}
    assert [tuple(r) for r in totals.list_total(bills(spark, [])).collect()] == [(None, None, 0, 0, 0, 0, False)]
    assert tuple(totals.outcome(rows).first()) == (4, 1, 1) and tuple(totals.outcome(bills(spark, [])).first()) == (0, 0, 0)
    assert {tuple(r) for r in totals.archivable(rows).collect()} == {("a", True), ("b", True), ("c", False)}


KEYS = ["a", "a", "b", "b", "b", None, None, "a", "c", "c", "c", "c", "c", "c", "c", "a"]


@pytest.mark.parametrize("parts", [1, 2, 3, 8, 40])
def test_runs_over_ranges(spark, parts):
    rows = spark.createDataFrame([(k * 3, key, "clash") for k, key in enumerate(KEYS)], "pos long, key string, _part string").drop("_part").repartition(4)
    want = [n for n, (_, g) in enumerate(itertools.groupby(KEYS), 1) for _ in g]
    assert [r["run_id"] for r in totals.runs(rows, "key", "pos", parts=parts).orderBy("pos").collect()] == want
    assert totals.run_count(rows, "key", "pos").first()[0] == want[-1]
    assert totals.runs(rows.limit(0), "key", "pos", parts=parts).count() == 0 and totals.run_count(rows.limit(0), "key", "pos").first()[0] == 0


def test_run_subtotals(spark):
    rows = [(k, key, 1, "ok", 100, "EUR") for k, key in enumerate(["a", "a", "b", "a", "a", "a"])]
    df = spark.createDataFrame(rows, "pos long, key string, page_count int, status string, gross_cents long, currency string")
    got = totals.run_subtotals(df, "key", "pos", parts=3).orderBy("pos").select("covered", render.joined_money(F.col("parts"))).collect()
    assert [r[0] for r in got] == [None, "2 bills", None, None, None, "3 bills"] and got[1][1] == "2,00 EUR"


def test_merge_and_reopen(spark):
    shown = spark.createDataFrame([(1, "/x", "x", 1), (2, "", "y", 1), (3, None, None, 1), (4, "/x", "x", 2)], "pos long, path string, file string, bill int")
    fresh = spark.createDataFrame([(1, "/x", "x", 2)], shown.schema)
    pairs = lambda df: sorted((r["part"], r["pos"]) for r in df.collect())
    assert pairs(lists.replace_merge(shown, fresh)) == [(0, 1), (1, 2), (1, 3)]
    assert pairs(lists.replace_merge(shown, fresh, 2)) == [(0, 1), (1, 2)]
    assert pairs(lists.replace_merge(shown, fresh.limit(0))) == [(1, k) for k in (1, 2, 3, 4)]
    assert pairs(lists.replace_merge(shown, spark.createDataFrame([(9, None, "", 1)], shown.schema))) == [(0, 9)] + [(1, k) for k in (1, 2, 3, 4)]
    assert pairs(lists.concatenated(fresh, shown)) == [(0, 1)] + [(1, k) for k in (1, 2, 3, 4)]
    assert {(r["pos"], r["found"]) for r in lists.reopened(spark.createDataFrame([(8, "/x", "z", 2), (9, "/x", "x", 3)], shown.schema), shown).collect()} == {(8, 4), (9, None)}


def test_notifications(spark):
    rows = bills(spark, [("/i/f.pdf", 1, 3, "ok", 250, "EUR", "Shop", "2025-01-02"), ("/i/f.pdf", 2, 3, "error", None, None, None, None, "broken"), ("/i/g.pdf", 1, 1, "ok", None, "EUR")])
    got = dict(map(tuple, lists.notifications(rows).collect()))
    assert got == {"/i/f.pdf": "f.pdf p1: Shop, 2025-01-02, 2,50 EUR\nf.pdf p2: broken\nf.pdf: sum 2,50 EUR (1 of 3 bills, 1 unread)", "/i/g.pdf": "g.pdf: ?, ?, ?"}


def test_comparison(spark):
    actual = spark.createDataFrame([("d", 1, "Ö. Müller-Söhne", "2025-01-02", "EUR", 1.004), ("d", 2, "", "", "", None)], "document string, bill int, vendor string, date string, currency string, gross_total double")
    expected = spark.createDataFrame([("d", 1, "/^ö m.*ne$/", "2025-01-02", "EUR", "1.00"), ("d", 2, None, None, "*", None), ("d", 3, "*", None, "EUR", "1"), ("d", 1, "other", "2025-01-03", "USD", "1.01")], "document string, bill int, vendor string, date string, currency string, gross_total string")
    got = sorted(tuple(r)[1:] for r in lists.compared(expected, actual).collect())
    assert got == [(1, True, False, False, False, False), (1, True, True, True, True, True), (2, True, True, True, True, True), (3, False, False, False, False, False)]


def test_details(spark):
    row = spark.createDataFrame([("/i/a b.pdf", "a b.pdf", 2, 3, "A & B", 1.5, "EUR", ["n1", "n2"])], "path string, file string, bill int, bill_count int, vendor string, gross_total double, currency string, notes array<string>")
    e = render.details({c: F.col(c) for c in row.columns}, F.create_map(F.lit("z"), F.lit("1"), F.lit("k"), F.lit("2"), F.lit("file"), F.lit("no")))
    text, html, none = row.select(render.details_text(e), render.details_html(e), render.details_text(render.details({}))).first()
    assert text == "Datei: a b.pdf, S. 2\nPfad: /i/a b.pdf\n\nAussteller: A & B\nBetrag: 1,50 EUR\n\nNotiz: n1\nNotiz: n2\nk: 2\nz: 1" and none == "Datei: " * 0 + none
    assert "<b>Betrag: 1,50 EUR</b>" in html and "A &amp; B<br>" in html and html.count("<br><br>") == 2


def test_bad_patterns_are_findings(spark):
    rows = [(1, 1, "/[/"), (2, 1, "/vend.r/"), (3, 1, "/(/"), (4, 1, "/(/"), (5, 1, None), (6, 1, "*")]
    expected = spark.createDataFrame([(*r, "*", "*", "*", "clash") for r in rows], "document int, bill int, vendor string, date string, currency string, gross_total string, valid string")
    actual = spark.createDataFrame([(k, 1, "Vendor", "", "", 1.0) for k in range(1, 7)], "document int, bill int, vendor string, date string, currency string, gross_total double")
    assert {r["document"]: r["vendor_ok"] for r in lists.compared(expected, actual).collect()} == {1: False, 2: True, 3: False, 4: False, 5: False, 6: True}
    assert sorted(tuple(r) for r in lists.pattern_findings(expected).collect()) == [(1, 1, "invalid pattern /[/"), (3, 1, "invalid pattern /(/"), (4, 1, "invalid pattern /(/")]
    assert lists.pattern_findings(expected.limit(0)).count() == 0
    got = expected.select(scalars.vendor_matches(F.col("vendor"), F.lit("the Vendor")).alias("m")).collect()
    assert [r["m"] for r in got] == [False, True, False, False, False, True]


def test_numbered(spark):
    ticks = [5, 1, 9, 100, 101, 7, -3, 2**40]
    got = {r["t"]: r["n"] for r in totals.numbered(spark.createDataFrame([(t,) for t in ticks], "t long"), "t", "n").collect()}
    assert got == {t: k for k, t in enumerate(sorted(ticks), 1)} and totals.numbered(spark.createDataFrame([], "t long"), "t", "n").count() == 0


def test_placed_documents(spark):
    rows = [("b", "2025-01-02"), ("a", "2025-01-02"), ("c", None), ("d", "2025-03-01T10:00:00Z"), ("e", "no time"), ("f", "2024-12-31"), ("g", "2025-01-02")]
    got = {r["sha256"]: r["place"] for r in store.placed_documents(spark.createDataFrame(rows, "sha256 string, created_at string")).collect()}
    assert got == {"d": 1, "a": 2, "b": 3, "g": 4, "f": 5, "c": 6, "e": 7}
