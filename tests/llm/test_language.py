"""Language identification against exact sets and on held-out texts; odd rows."""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import functions as F

from billoom.llm import langid, queries

FOLDER = "/root/testdata/sf0.01"


def trigrams(text):
    kept = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
    return [f" {kept} "[k : k + 3] for k in range(len(kept))] if kept else []


def exact(rows):
    """(lang, score) by exact sets in place of filters."""
    counts: dict[str, Counter] = {}
    for doc_id, text, lang in rows:
        if lang is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 != 1:
            counts.setdefault(lang, Counter()).update(trigrams(text))
    rate = {k: {g: n / c.total() for g, n in c.items() if n / c.total() >= langid.MIN_RATE} for k, c in counts.items()}
    best = {g: max(r.get(g, 0) for r in rate.values()) for r in rate.values() for g in r}
    sets = {k: {g for g, x in r.items() if x >= langid.MIN_RATIO * best[g]} for k, r in sorted(rate.items())}
    for _, text, _ in rows:
        grams = trigrams(text)
        shares = {k: sum(g in s for g in grams) / len(grams) for k, s in sets.items()} if grams else {}
        total = sum(shares.values())
        yield (max(shares, key=shares.get), max(shares.values()) / total) if total else (None, 0.0)


def test_query_against_exact_sets(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").collect()]
    got = {r["doc_id"]: r for r in queries.op7_language_id(spark, FOLDER).collect()}
    want = dict(zip([r[0] for r in rows], exact(rows), strict=True))
    assert len(got) == len(rows) == len(want)
    told = [k for k, (lang, _) in want.items() if lang]
    assert sum(got[k]["lang_pred"] == want[k][0] for k in told) >= 0.999 * len(told)
    assert max(abs(got[k]["score"] - want[k][1]) for k in told) < 0.05
    held = [(k, lang) for k, _, lang in rows if lang is not None and got[k]["held_out"] and want[k][0]]
    assert held and sum(got[k]["lang_pred"] == lang for k, lang in held) >= 0.98 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())


def test_odd_rows(spark):
    teach = [(k, "aaa bbb ccc " * 3, "xx", 1.0) for k in range(3)] + [(9, "aaa bbb ccc " * 3, "yy", 1.0), (10, None, "xx", 1.0), (11, "zzz", None, 1.0), (12, "", "xx", 1.0)]
    df = spark.createDataFrame(teach, "doc_id long, text string, lang string, score double").withColumn("coverage", F.lit("clash")).withColumn("lang_pred", F.lit(7))
    model = langid.fit(df)
    assert model.languages == ["xx", "yy"]
    asked = spark.createDataFrame([(1, "aaa bbb"), (1, "aaa bbb"), (2, None), (3, "…!1"), (4, "qqq"), (None, "bbb"), (5, "aaa bbb ccc " * 200_000)], "doc_id long, text string")
    got = sorted(((str(r["doc_id"]), r["lang_pred"]) for r in langid.predict(asked, model).collect()))
    assert got == sorted([("1", "xx"), ("1", "xx"), ("2", "und"), ("3", "und"), ("4", "xx"), ("None", "xx"), ("5", "xx")])  # ties: the first name; nothing known: the commonest
    out = langid.predict(df, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "coverage"] and dict(out.dtypes)["coverage"] == "double"
    assert langid.predict(asked.limit(0), model).count() == 0 and langid.predict(asked, langid.fit(df.limit(0))).filter("lang_pred <> 'und'").count() == 0
