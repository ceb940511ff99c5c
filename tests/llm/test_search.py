"""Pruning of the block-max search, and the permutation index: recall, work saved, odd inputs."""

from __future__ import annotations

import numpy as np
import pytest

from billoom.llm import bm25, permutation


def test_block_maxima_skip_blocks(tmp_path):
    rng = np.random.default_rng(8)
    build, texts = bm25.Builder(), []
    for k in range(20000):
        texts.append(" ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.2, int(rng.integers(5, 120))), 3000)))
        build.add(k, texts[-1])
    path, n, total = build.write(f"file://{tmp_path}")
    shard = bm25.load_arrays(path)
    number = bm25._dictionary(shard)
    asked = list(number)
    df = shard["sizes"].astype(int)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    found = bm25.Shard(shard, number, asked, idf, total / n)
    # the stored maxima bound every score of their block
    every = bm25.Shard(shard, number, asked, idf, total / n)
    _, adds = every.visit(np.arange(len(every.most)))
    assert (np.maximum.reduceat(adds, every.starts) <= every.most).all()
    local = np.argsort(every.ids)
    for rare, common in [("w1500", "w1"), ("w900", "w2"), ("w2000", "w3")]:
        terms = np.array([number[rare.encode()], number[common.encode()]])
        ids, scores = found.search(terms, np.ones(2), -1, 10, 0.0)
        want = sorted(((-sum(every.adds[every.starts[every.block_at[t]] :][: every.sizes[t]][every.docs[every.posts[every.block_at[t]] :][: every.sizes[t]] == local[d]].sum() for t in terms), d) for d in range(n) if rare in texts[d].split() or common in texts[d].split()))[:10]
        assert [(d, s) for s, d in want] == [(d, -s) for d, s in zip(ids.tolist(), scores.tolist(), strict=True)]
    assert found.blocks["visited"] < 0.7 * found.blocks["offered"] and found.blocks["scored"] <= found.blocks["visited"]


@pytest.mark.parametrize("n", [300, 3000])
def test_permutation_against_brute_force(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 24)) + 2 * rng.normal(size=(20, 24))[rng.integers(0, 20, n)]
    rows = spark.createDataFrame([(k, v.tolist(), "x") for k, v in enumerate(x)], "vec_id long, embedding array<double>, score string")
    got = permutation.search(rows, rows.filter("vec_id % 100 = 0"), shard_vectors=1000).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        hits += len({int(k) for k in np.argsort(d, kind="stable") if k != q} and set([int(k) for k in np.argsort(d, kind="stable") if k != q][:10]) & set(g.vec_id))
        assert g.sort_values("rank").score.tolist() == sorted(g.score) and np.allclose(sorted(g.score), np.sort(d[g.vec_id]), rtol=0, atol=1e-12)
    assert hits >= 0.9 * 10 * (n // 100)


def test_permutation_looks_at_a_part():
    rng = np.random.default_rng(1)
    n, dims = 20000, 64
    x = rng.normal(size=(n, dims))
    pivots = x[: permutation.PIVOTS]
    s = permutation.Shard.build([v.astype("<f8").tobytes() for v in x], [[k] for k in range(n)], pivots, permutation.PREFIX)
    order = permutation.orders(x[:50], pivots, permutation.PREFIX)
    read = np.mean([sum(int(s.at[p + 1] - s.at[p]) for p in o) for o in order])
    ranked = permutation.SPREAD * n**permutation.POWER
    assert read + ranked * dims < 0.4 * n * dims and permutation.PREFIX * 4 <= permutation.PIVOTS


def test_permutation_odd_rows(spark):
    rows = [(0, [0.0, 0.0]), (100, [1.0, 2.0]), (2, None), (3, [float("inf"), 1.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0]), (5, [1.0, None]), (6, [3.0, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (200, [3.0, 1.0]), (8, [])]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "vec_id long, embedding array<double>, rank int, query_id string")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in permutation.search(df, df.filter("vec_id % 100 = 0")).collect()}
    far = 5.0**0.5
    assert got == {(100, 1): (4, 0.0), (100, 2): (6, far), (100, 3): (200, far), (200, 1): (6, 0.0), (200, 2): (4, far), (200, 3): (100, far)}
    assert permutation.search(df.limit(0), df).count() == 0 == permutation.search(df, df.limit(0)).count()
