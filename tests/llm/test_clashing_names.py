"""Every name that an operator uses inside, as a column of its input: the column comes back as it was."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from billoom.llm import kneserney, licenses, mixing, packing, permutation, simhash

FOLDER = Path(mixing.__file__).parent
NAMES = {"license", "score", "via", "from_dir", "copy", "n_copies", "shuffle_key", "sequence_id", "offset", "length", "piece", "doc_id", "text", "source", "path", "lang"}


def inside(module) -> list[str]:
    """Column-like names in the module's source, but for those that are its input or result."""
    source = Path(module.__file__).read_text()
    found = set(re.findall(r'"(_?[a-z][a-z_]*)"', source)) | {"near", "_dir", "_text", "_row", "_id", "_stays", "_times", "_doc", "_bucket", "_rank", "_u", "_rate", "_cut", "_source", "file"}
    return sorted(found - NAMES)


def with_all(rows, names):
    return rows.select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in names])


def same(rows, names):
    return all(r[n] == f"{n}-{r['doc_id']}" for r in rows.collect() for n in names)


@pytest.fixture
def docs(spark):
    rows = [(k, f"some words {k % 5} of a text that is long enough {k % 3}", f"s{k % 3}", f"d{k % 4}/{'LICENSE' if k < 4 else k}") for k in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, path string")


def test_mix(docs):
    names = inside(mixing)
    got = mixing.mix(with_all(docs, names), seed=3)
    assert same(got, names) and got.columns[: len(docs.columns) + len(names)] == with_all(docs, names).columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in mixing.mix(docs, seed=3).collect())


def test_mix_with_many_sources(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    names = inside(mixing)
    assert same(mixing.mix(with_all(docs, names), seed=3), names)


def test_one_of_each(docs):
    names = inside(simhash)
    wide = with_all(docs, names).withColumn("zz_map", F.create_map(F.lit("a"), F.col("doc_id"))).withColumn("zz_nested", F.struct(F.array(F.struct(F.create_map(F.lit("a"), F.lit(1)).alias("x"))).alias("y")))
    got = simhash.one_of_each(wide)
    assert same(got, names) and got.columns == wide.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect())
    assert simhash.one_of_each(wide.unionByName(wide)).count() == got.count()


def test_inherit(spark, docs):
    names = inside(licenses)
    found = spark.createDataFrame([("d1/LICENSE", "MIT", 1.0), ("d2/9", "Apache-2.0", 0.9)], "path string, license string, score double")
    got = licenses.inherit(with_all(docs, names), found)
    assert same(got, names) and {r["via"] for r in got.collect()} == {"own", "inherited", "none"}


def test_pack(docs):
    names = [n for n in inside(packing) if n not in ("start", "ids_crc32", "ids")]
    parts = with_all(docs.select("doc_id", F.lit(0).alias("piece"), (F.col("doc_id") % 7 + 1).alias("length")), names)
    got = packing.pack(parts, 10)
    assert same(got, names) and sorted(got.columns) == sorted([*parts.columns, "sequence_id", "offset"])
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 10").count() == 0


def test_score(docs):
    model = kneserney.fit(docs, order=2)
    got = kneserney.score(docs.withColumn("_text", F.col("doc_id")).withColumn("_TEXT_", F.col("doc_id")), model, keep=["doc_id", "_text", "_TEXT_", "text"])
    assert all(r["_text"] == r["doc_id"] == r["_TEXT_"] for r in got.collect()) and got.count() == 30


def test_repeated_vector_ids(spark):
    """An id on two vectors is a candidate with each; a query id on two vectors has one answer."""
    rows = [(1, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [1.0, 0.05]), (100, [1.0, 0.01]), (100, [0.0, 1.0]), (3, [0.0, 0.9])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"]) for r in permutation.search(vectors, vectors.filter("vec_id = 100"), k=4).orderBy("rank").collect()]
    assert [r for r, _ in got] == [1, 2, 3, 4] and got[0][1] == 1 and {2, 3} <= {v for _, v in got}
