"""The store on the cases of FIXTURES.md section 5."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from billoom.functions import scalars as S
from billoom.operators import store


def documents(spark, *rows):
    return spark.createDataFrame([(h, fp, f"/in/{h}", f"{h}.pdf", 1, True, "m", at) for h, fp, at in rows], store.DOCUMENTS)


def bills(spark, *rows):
    names = [f.split()[0] for f in store.BILLS.split(", ")]
    return spark.createDataFrame([tuple({"sha256": h, "page": p, "status": "ok", "vendor": v, "created_at": "2025", "payload": '{"vendor": "' + v + '", "gross_total": "1,50"}'}.get(n) for n in names) for h, p, v in rows], store.BILLS)


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/db")
    assert s.documents().count() == 0 == s.bills().count()
    s.create()
    s.save(documents(spark, ("h1", "a", "2025-01"), ("h2", "a", "2025-02")), bills(spark, ("h1", 1, "X"), ("h1", 2, "Y"), ("h2", 1, "Z")))
    assert s.find("h1", "a").count() == 1 and s.find("h1", "b").count() == 0
    s.save(documents(spark, ("h1", "b", "2025-03")), bills(spark, ("h1", 1, "W")))
    assert {(r["sha256"], r["page"], r["vendor"]) for r in s.bills().collect()} == {("h1", 1, "W"), ("h2", 1, "Z")}  # the page that went is gone
    assert s.find("h1", "a").count() == 0 and s.find("h1", "b").count() == 1
    again = store.Store(spark, f"file://{tmp_path}/db")
    assert [r["sha256"] for r in store.newest_documents(again.documents()).collect()] == ["h1", "h2"]
    assert [r["file_name"] for r in store.bills_of(again.bills(), again.documents(), "h1").collect()] == ["h1.pdf"]
    again.forget(spark.createDataFrame([("h1",)], "sha256 string"))
    assert {r["sha256"] for r in s.bills().collect()} == {"h2"} == {r["sha256"] for r in s.documents().collect()}
    s.clear()
    assert s.bills().columns == [f.split()[0] for f in store.BILLS.split(", ")] and s.bills().count() == 0


def test_a_write_that_fails_leaves_the_old_version(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/db")
    s.save(documents(spark, ("h1", "a", "2025")), bills(spark, ("h1", 1, "X")))
    broken = bills(spark, ("h2", 1, "Y")).withColumn("page", F.raise_error("no").cast("int"))
    with pytest.raises(Exception, match="no"):
        s.save(documents(spark, ("h2", "a", "2025")), broken)
    assert [r["sha256"] for r in s.documents().collect()] == ["h1"] and s.bills().count() == 1


def test_history(spark):
    d, b = documents(spark, ("h1", "a", "2025")), bills(spark, ("h1", 1, "X"), ("h1", 2, "Y"), ("lost", 1, "Z"))
    assert [r["vendor"] for r in store.history(b, d, 5, ("created_at", "page")).collect()] == ["Y", "X"]
    assert store.history(b, d, 0, ("page",)).count() == 0 and store.bill_count(b).first()[0] == 3
    line = store.history_lines(store.stored_bills(b.filter("page = 2"), d)).first()[0]
    assert line == f"2025  {'Y':20}  {'':10}  {'-':>12}  p2 h1.pdf"


def test_cache(spark):
    d, b = documents(spark, ("h1", "a", ""), ("h2", "a", ""), ("", "a", "")), bills(spark, ("h1", 1, "X"), ("h1", 2, "X"), ("", 1, "X"))
    asked = spark.createDataFrame([(1, "h1", "a"), (2, "h1", "b"), (3, "h2", "a"), (4, "", "a"), (5, None, "a"), (1, "h1", "a")], "n int, sha256 string, fingerprint string")
    assert sorted(tuple(r)[0::3] for r in store.cache_probe(asked, d, b).collect()) == [(1, True), (1, True), (2, False), (3, False), (4, False), (5, False)]
    assert store.cache_probe(asked, d.limit(0), b).filter("hit").count() == 0
    rows = b.select(F.lit("/in/x").alias("path"), "page", F.lit(2).alias("page_count"), F.when(F.col("page") == 2, "error").otherwise("ok").alias("status"), "payload", "created_at")
    got = {r["page"]: (r["vendor"], r["gross_total"], r["error"], r["from_cache"], r["notes"]) for r in store.from_stored(rows).collect()}
    assert got[2] == ("X", 1.5, "stored as error", True, ["answered from the cache, stored 2025"]) and got[1][2] == ""


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 2), ("c", 2)], "k string, v int")
    assert sorted(map(tuple, store.upsert(old, new, ["k"]).collect())) == [("a", 1), ("b", 2), ("c", 2)]
    assert sorted(map(tuple, store.upsert(old, new.limit(0), ["k"]).collect())) == [("a", 1), ("b", 1)] and store.upsert(old.limit(0), new.limit(0), ["k"]).count() == 0
    assert sorted(map(tuple, store.latest(old.unionByName(new), ["k"], F.col("v")).collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_fingerprint_follows_settings(spark):
    base = ["m", 3, 200, 1600, 1000, 120, 0, "deu"]
    keys = {S_key(spark, base)} | {S_key(spark, [*base[:k], x, *base[k + 1 :]]) for k, x in enumerate(["n", 4, 300, 1700, 900, 100, 1, "eng"])}
    assert len(keys) == 9 and all(len(k) == 16 for k in keys) and S_key(spark, base) in keys


def S_key(spark, values):
    return spark.range(1).select(S.fingerprint(*[F.lit(v) for v in values])).first()[0]
