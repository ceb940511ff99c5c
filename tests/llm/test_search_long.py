"""Long queries of the block-max search: all postings added up, those that many queries share in products of matrices."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from billoom.llm import bm25

DOCS, QUERIES = 1500, 150


def _texts(rng, n: int) -> list[str]:
    """Three vocabularies; words of each are the rarer the higher their number."""
    return [" ".join(f"v{k % 3}w{int(x)}" for x in np.minimum(rng.zipf(1.25, int(rng.integers(3, 400))), 2000)) for k in range(n)]


def _shard(ids: list[int], texts: list[str], folder: str):
    build = bm25.Builder()
    for i, t in zip(ids, texts, strict=True):
        build.add(i, t)
    path, n, total = build.write(folder)
    shard = dict(bm25.load_arrays(path))
    asked = list(bm25._dictionary(shard)) + [b"nowhere"]
    df = np.append(shard["sizes"].astype(int), 0)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    return lambda: bm25.Shard(shard, bm25._places(shard, asked), asked, idf, total / n), asked


def _queries(rng, asked: list[bytes], ids: list[int], texts: list[str]):
    number = {w: k for k, w in enumerate(asked)}
    for k in bm25._alike([np.array([number[w] for w in set(bm25.words(t))]) for t in texts[:QUERIES]], len(asked)).tolist():
        got = Counter(bm25.words(texts[k] + " nowhere"))
        yield np.array([number[w] for w in got]), np.array(list(got.values()), float), ids[k]


@pytest.mark.parametrize("repeats", [False, True])
@pytest.mark.parametrize("run, matrix", [(128, 1 << 23), (7, 8 * DOCS * 3)])
def test_long_queries_find_what_block_maxima_find(tmp_path, monkeypatch, repeats, run, matrix):
    monkeypatch.setattr(bm25, "RUN_QUERIES", run)
    monkeypatch.setattr(bm25, "MATRIX_BYTES", matrix)
    monkeypatch.setattr(bm25, "SCORE_BYTES", matrix)
    rng = np.random.default_rng(3)
    texts = _texts(rng, DOCS)
    texts[700:720] = texts[:20]  # copies: ties go to the smaller id
    ids = (rng.permutation(DOCS) // (2 if repeats else 1)).tolist()
    shard, asked = _shard(ids, texts, f"file://{tmp_path}")
    plain, queries = shard(), list(_queries(rng, asked, ids, texts))
    want = [plain.search(*q, 10, 0.0) for q in queries]
    leasts = [0.0 if k % 3 == 0 or len(w[1]) < 10 else float(w[1][4]) for k, w in enumerate(want)]
    got = dict(shard().search_all([(*q, least) for q, least in zip(queries, leasts, strict=True)], 10))
    assert len(got) == len(queries)
    for k, ((i, scores), least) in enumerate(zip(want, leasts, strict=True)):
        assert got[k][0].tolist() == i[scores >= least].tolist() and got[k][1].tolist() == scores[scores >= least].tolist()


def test_shared_words_are_added_for_all_queries_at_once(tmp_path):
    """A query's whole text asks for nearly every block; before, each query looked at each of its postings."""
    rng = np.random.default_rng(4)
    texts, ids = _texts(rng, DOCS), list(range(DOCS))
    shard, asked = _shard(ids, texts, f"file://{tmp_path}")
    here, queries = shard(), list(_queries(rng, asked, ids, texts))
    postings = sum(int(here.sizes[terms].sum()) for terms, _, _ in queries)
    assert all(len(i) <= 10 for _, (i, _) in here.search_all([(*q, 0.0) for q in queries], 10))
    short = sum(int(here.sizes[terms].sum()) for terms, _, _ in queries if len(terms) <= bm25.LONG)
    assert short < 0.01 * postings and here.added + bm25.BLOCK * here.blocks["visited"] < 0.5 * postings


def test_a_task_has_one_block_of_queries(spark):
    paths = spark.createDataFrame([(f"p{k:03d}", 1, 1) for k in range(100)], "path string, n_docs long, n_words long")
    dealt = bm25._dealt(paths, 5)
    parts = [p for p in dealt.rdd.glom().collect() if p]
    assert sorted((r["path"], r["block"]) for p in parts for r in p) == [(f"p{k:03d}", b) for k in range(100) for b in range(5)]
    assert all(len({r["block"] for r in p}) == 1 and len(p) <= bm25.SHARDS_A_TASK for p in parts)
    assert len(parts) <= 500 / 2 and max(map(len, parts)) > 1
