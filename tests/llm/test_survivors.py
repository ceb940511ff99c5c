"""Which rows one_of_each() keeps where ids repeat; clashing columns."""

from __future__ import annotations

from billoom.llm import simhash

A, B, C = ("the quick brown fox jumps over the lazy dog near the old river bank", "an entirely different sentence about cooking rice with some spices today", "numbers and letters are printed on large white sheets of paper every day")


def kept(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, component_id string")
    out = simhash.one_of_each(df.repartition(3))
    assert out.columns == df.columns
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in out.collect())


def test_repeated_ids_lose_no_text(spark):
    assert kept(spark, [(5, A), (5, B), (7, A), (8, B)]) == sorted([(False, 5, A), (False, 5, B)])
    assert kept(spark, [(2, A), (5, A), (5, B), (9, B)]) == sorted([(False, 2, A), (False, 5, B)])
    assert kept(spark, [(5, A), (5, A), (5, C), (6, A)]) == sorted([(False, 5, A), (False, 5, C)])


def test_nulls_and_nothing(spark):
    assert kept(spark, [(None, A), (None, A), (None, B), (3, None), (4, "")]) == sorted([(False, 3, ""), (True, 0, A), (True, 0, B)])
    assert kept(spark, []) == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, A, 1, "x"), (2, A, 1, "y")], "doc_id long, text string, fp int, component_id string")
    assert sorted(map(tuple, simhash.near_duplicates(df).collect())) == [(k, r.fp, 1) for k, r in zip((1, 2), simhash.fingerprints(df).collect(), strict=True)]
