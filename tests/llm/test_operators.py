"""Operators of the training-data part against brute force or round trips, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from billoom.llm import bm25, langid, licenses, packing, permutation, simhash, sstable, warc
from billoom.llm.queries import vocabulary

DOCS = [(1, "the cat sat on the mat and ran"), (2, None), (3, ""), (4, "The cat  sat on the mat and ran"), (5, "a b"), (5, "a b"), (6, "der hund und die katze"), (None, "zz yy xx ww vv uu"), (7, "x" * 20000)]


def docs(spark, rows=DOCS):
    return spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, text string, lang string, offset int")


def test_simhash(spark):
    got = simhash.near_duplicates(docs(spark)).collect()
    prints = [(d, simhash.fingerprint(t)) for d, t in DOCS]
    group = list(range(len(prints)))
    for _ in prints:
        for i, (_, a) in enumerate(prints):
            for j, (_, b) in enumerate(prints):
                if (a ^ b).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((d for (d, _), h in zip(prints, group, strict=True) if h == g and d is not None), default=None) for g in group}
    want = sorted((str(d), str(least[g])) for (d, _), g in zip(prints, group, strict=True))
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == want
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert sorted(str(r["doc_id"]) for r in simhash.one_of_each(docs(spark)).collect()) == ["1", "2", "5", "6", "7", "None"]


def test_hot_buckets_keep_all_links(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.integers(0, 64, 4)) for _ in range(300)})
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    scratch = simhash.Scratch(spark, "test")
    parts = lambda n: {frozenset(x) for x in _groups(simhash.components(simhash.links(nodes, scratch, n), scratch).collect())}
    assert parts(8) == parts(100_000) == {frozenset(x) for x in _brute(signed) if len(x) > 1}


def _groups(rows):
    out: dict[int, set[int]] = {}
    for r in rows:
        out.setdefault(r["root"], {r["root"]}).add(r["node"])
    return out.values()


def _brute(fps):
    left, out = set(fps), []
    while left:
        front = [left.pop()]
        group = set(front)
        while front:
            a = front.pop()
            near = {b for b in left if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
            left -= near
            group |= near
            front += near
        out.append(group)
    return out


def test_sstable(spark):
    manifest = sstable.write_tables(docs(spark), vocabulary("byte_bpe_50k.json"), shards=3)
    got = sstable.read_tables(manifest).orderBy("start").collect()
    tokenizer, at = sstable.coder(vocabulary("byte_bpe_50k.json"), "byte_level").tokenizer, 0
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 5, 5, 6, 7]
    for r in got:
        text = dict(DOCS)[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2] and r["start"] == at
        at += len(r["ids"]) // 4
    found = sstable.look_up(spark, manifest, spark.createDataFrame([(5,), (7,), (99,)], "doc_id long")).collect()
    assert sorted(r["doc_id"] for r in found) == [5, 5, 7]
    assert sstable.read_tables(sstable.write_tables(docs(spark, []), vocabulary("byte_bpe_50k.json"))).count() == 0


def test_warc(spark):
    rows = [(k, f"http://www.h{k % 3}.example.org/a?b={k}#c", "p" * (100 + k % 4) if k % 5 else None) for k in range(40)] + [(40, None, "short"), (41, "http://x/", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    runs = warc.write_archives(pages)
    index = warc.merge_index(runs, shards=3, fan_in=2)
    order = warc.captures(index).orderBy("shard", "place").collect()
    assert [(r["url_key"], r["captured"], r["page_id"]) for r in order] == sorted((r["url_key"], r["captured"], r["page_id"]) for r in order) and len(order) == len(rows)
    first: dict[str, int] = {}
    for r in sorted(warc.read_records(warc.captures(index)).collect(), key=lambda r: r["page_id"]):
        data = (rows[r["page_id"]][2] or "").encode()
        lead = first.setdefault(data, r["page_id"]) if len(data) >= 100 else r["page_id"]
        want = ("response", None) if lead == r["page_id"] else ("revisit", lead)
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(data), hashlib.sha256(data).hexdigest(), *want)
    assert warc.captures(warc.merge_index(warc.write_archives(pages.limit(0)))).count() == 0


def test_permutation_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = permutation.search(vectors, vectors.filter("vec_id % 100 = 0")).toPandas()
    pdf = vectors.toPandas()
    x, ids, hits, n = np.stack(pdf.embedding).astype(float), pdf.vec_id.to_numpy(), 0, 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        order = [int(ids[k]) for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        hits, n = hits + len(set(order) & set(g.vec_id)), n + len(order)
    assert hits / n >= 0.9
    odd = spark.createDataFrame([(0, [0.0, 0.0]), (100, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [3.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["rank"]) for r in permutation.search(odd, odd.filter("vec_id % 100 = 0")).orderBy("rank").collect()] == [(4, 1), (5, 2), (6, 3)]


def _bm25(rows, queries, k):
    """Scores everything; rows and queries are (doc_id, text)."""
    held = [(d, Counter(bm25.words(t))) for d, t in rows if d is not None]
    df = Counter(w for _, c in held for w in c)
    n, average = len(held), sum(c.total() for _, c in held) / len(held)
    out = set()
    for q, text in queries:
        best: dict[int, float] = {}
        for d, c in held:
            add = sum(qtf * math.floor(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * (c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / average))) * 2**24 + 0.5) for w, qtf in Counter(bm25.words(text)).items() if w in c)
            if d != q and add > 0:
                best[d] = max(best.get(d, 0), add / 2**24)
        out |= {(q, r, d, s) for r, (s, d) in enumerate([(-s, d) for s, d in sorted((-s, d) for d, s in best.items())][:k], 1)}
    return out


def test_bm25(spark):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.4, int(rng.integers(1, 60))), 400))) for k in range(400)]
    rows += [(k, "w1 W2 w3 w3 rare") for k in range(400, 500)] + DOCS + [(600, "w1 " * 5000)]
    queries = [(k, t) for k, t in rows if k is not None and k % 50 == 0]
    for size in (2000, 1 << 20):
        got = bm25.search(docs(spark, rows), docs(spark, queries), shard_bytes=size, query_bytes=2000)
        assert {tuple(r) for r in got.collect()} == _bm25(rows, queries, 10)
    assert {tuple(r) for r in bm25.search(docs(spark), docs(spark, [(5, "a b"), (9, "The mat"), (8, None)])).collect()} == _bm25(DOCS, [(5, "a b"), (9, "The mat")], 10)
    assert bm25.search(docs(spark, []), docs(spark)).count() == 0 == bm25.search(docs(spark), docs(spark, [])).count()


def test_packing(spark):
    rng = np.random.default_rng(3)
    lengths = [int(n) for n in np.minimum(rng.lognormal(6.5, 1, 3000) + 1, 4096)]
    hist = np.bincount(lengths, minlength=4097)
    classes, held = packing.plan(hist), np.zeros(4097, int)
    for items, count in classes:
        assert sum(n * t for n, t in items) <= 4096
        for n, t in items:
            held[n] += t * count
    assert (held == hist).all() and sum(c for _, c in classes) <= 1.02 * packing.lower_bound(lengths) + 1
    got = packing.pack_documents(docs(spark), vocabulary("word_bpe_49k.json"), with_ids=True).toPandas()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= 4096
    assert all(zlib.crc32(i) == c for i, c in zip(got.ids, got.ids_crc32, strict=True))
    assert len(got[got.piece == 0]) == len(DOCS)
    assert packing.pack_documents(docs(spark, []), vocabulary("word_bpe_49k.json")).count() == 0


def test_language(spark):
    rows = [(k, ("the house and the dog are here " if k % 2 else "der hund und das haus sind hier ") * 5, "en" if k % 2 else "de") for k in range(20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "the dog"), (2, "das haus"), (3, None), (4, "12 3"), (5, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(asked, model).collect()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und"}
    assert langid.predict(asked, langid.fit(asked.withColumn("lang", F.lit(None).cast("string")))).first()["lang_pred"] == "und"


def test_licenses(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.txt", "plain"), ("a/b/y.txt", "text.\nLicensed under the Apache License, Version 2.0."), ("c/z.txt", None), (None, "")]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {r["path"]: (r["license"], r["via"], r["from_dir"]) for r in licenses.inherit(files, licenses.scan(files)).collect()}
    assert got == {"a/LICENSE": ("MIT", "own", None), "a/b/x.txt": ("MIT", "inherited", "a"), "a/b/y.txt": ("Apache-2.0", "own", None), "c/z.txt": (None, "none", None), None: (None, "none", None)}
