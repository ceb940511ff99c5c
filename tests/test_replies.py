"""Replies, their settling, the model's retry, and lines of JSON on the cases of FIXTURES.md."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from billoom.operators import replies
from billoom.sources import ndjson

# reply, first answer, second answer -> total, asked twice, corrected
QUORUM = [
    ((10.0, None, None), (10.0, False, False)), ((None, None, None), (None, False, False)), ((10.0, 10.004, None), (10.004, False, False)), ((10.0, 12.0, None), (10.0, True, False)),
    ((10.0, 12.0, 10.0), (10.0, True, False)), ((10.0, 12.0, 12.0), (12.0, True, True)), ((None, 12.0, None), (None, True, False)), ((None, 12.0, 13.0), (None, True, False)), ((None, 12.0, 12.001), (12.0, True, True)),
]


def test_quorum(spark):
    rows = spark.createDataFrame([q for q, _ in QUORUM], "r double, a double, b double")
    assert [tuple(x["s"]) for x in rows.select(replies.settled_total(*[F.col(c) for c in "rab"]).alias("s")).collect()] == [want for _, want in QUORUM]


def test_dates(spark):
    rows = spark.createDataFrame([("x\nRechnungsdatum: 01.02.2025", "2024-01-01", "2023-01-01"), ("no label 01.02.2025", "17.07.25", "2023-01-01"), (None, "unknown", "2023-01-01"), ("", None, None)], "t string, a string, r string")
    assert [tuple(x["s"]) for x in rows.select(replies.settled_date(*[F.col(c) for c in "tar"]).alias("s")).collect()] == [("2025-02-01", "text"), ("2025-07-17", "asked"), ("2023-01-01", "reply"), ("", "none")]


def test_records(spark):
    good = '{"vendor": " Müller ", "vendor_address": "A\\n B  C", "date": "17.07.25", "due_date": "not visible", "currency": "Euro", "gross_total": "1.190,00 €", "net_total": 190.123, "tax_total": [1], "iban": "AT 1 2", "confidence": "0,9", "invoice_number": 7}'
    texts = [good, f"```json\n{good}\n```", f"Sure: {good} done", "nothing", "", None, "[1]", "{x}"]
    got = replies.from_reply(spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "k int, reply string, vendor string")).orderBy("k").collect()
    for r in got[:3]:
        assert (r["vendor"], r["vendor_address"], r["date"], r["due_date"], r["currency"], r["gross_total"], r["net_total"], r["tax_total"], r["iban"], r["confidence"], r["invoice_number"], r["error"]) == ("Müller", "A B C", "2025-07-17", "", "EUR", 1190.0, 190.123, None, "AT12", 0.9, "", "")
    assert [r["error"] for r in got[3:]] == ["the reply is not a JSON object", "the model returned nothing", "the model returned nothing", "the reply is not a JSON object", "the reply is not a JSON object"] and all(r["vendor"] is None for r in got[3:])
    out = json.loads(replies.from_reply(spark.createDataFrame([(good,)], "reply string")).select(replies.to_json()).first()[0])
    assert out["tax_total"] is None and out["gross_total"] == 1190.0 and list(out) == sorted(out)


def test_model_is_asked_again_once(spark):
    pages = spark.createDataFrame([("a", 1, "good"), ("a", 2, "late"), ("b", 1, "never"), ("c", 1, "  "), ("c", 2, None)], "path string, page int, text string")

    def model(messages):
        text, again = messages[1]["content"], len(messages) > 2
        return '{"vendor": "V", "gross_total": 2}' if text == "good" or (text == "late" and again) else '{"vendor": "only"}'

    got = {(r["path"], r["page"]): (r["status"], r["attempts"], r["vendor"], r["error"]) for r in replies.analysed(pages, model).collect()}
    assert got == {("a", 1): ("ok", 1, "V", ""), ("a", 2): ("ok", 2, "V", ""), ("b", 1): ("error", 2, "only", "the model returned no usable fields"), ("c", 1): ("error", 0, None, "nothing to send"), ("c", 2): ("error", 0, None, "nothing to send")}


def test_lines(spark, tmp_path):
    lines = ["", "  ", '{"file": "a.pdf", "status": "ok", "gross_total": 1.5}', "0", "null", "[1]", '"x"', "{broken", '{"path": "/i/b.pdf", "bill": 2, "bill_count": 3}']
    (tmp_path / "in.json").write_text("\n".join(lines))
    got = ndjson.read(spark, f"file://{tmp_path}/in.json")
    assert tuple(ndjson.broken(got.select("value")).first()) == (2, 5)
    b = [r["bill"] for r in got.filter("is_bill").collect()]
    assert [(x["path"], x["page"], x["page_count"], x["status"], x["invoice"]["gross_total"]) for x in b] == [("a.pdf", 1, 1, "ok", 1.5), ("/i/b.pdf", 2, 3, "error", None)]
    assert ndjson.parsed(spark.createDataFrame([], "value string")).count() == 0


@pytest.mark.parametrize("error", [None, "", "bad"])
def test_written_lines(spark, tmp_path, error):
    fields = {"confidence": None, "currency": "EUR", "date": "2025-01-01", "due_date": "", "gross_total": 2.5, "iban": "", "invoice_number": "7", "net_total": None, "tax_total": None, "vendor": 'V "q"', "vendor_address": ""}
    schema = "path string, page int, page_count int, status string, error string, quality_warning string, has_text_layer boolean, from_cache boolean, extract_ms long, inference_ms long, notes array<string>, " + ", ".join(f"{k} {'double' if k in replies.AMOUNTS else 'string'}" for k in fields)
    ndjson.write(spark.createDataFrame([("/i/b.pdf", 1, 1, "ok", error, None, True, False, 1, 2, ["n"], *fields.values())], schema), f"file://{tmp_path}/out")
    (row,) = spark.read.text(f"file://{tmp_path}/out").collect()
    out = json.loads(row[0])
    assert out["file"] == "b.pdf" and out["vendor"] == 'V "q"' and out["net_total"] is None and out.get("error") == (error or None) and ("error" in out) == bool(error) and "quality_warning" not in out
