"""The n-gram model against a plain Python version."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest

from billoom.llm import kneserney as kn

TEXTS = ["the cat sat on the mat", "The cat  ate\tthe rat", "", None, "a rat sat on a cat on a mat the the the", "the cat sat on the mat", "mat é ü mat"] * 2 + ["the dog sat"]


def plain(train, order):
    cut = lambda t: [w for w in (t or "").translate({c: c + 32 for c in range(65, 91)}).split(" ") if w]
    words = lambda t: [w for x in cut((t or "").replace("\t", " ")) for w in [x]] + ["</s>"]
    top = Counter()
    for t in train:
        w = ["<s>"] * (order - 1) + words(t)
        top.update(tuple(w[k : k + order]) for k in range(len(w) - order + 1))
    raw = Counter()
    for g, n in top.items():
        raw[g[-1]] += n
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        below = Counter()
        for g, n in levels[k + 1].items():
            below[g[1:]] += n if g[1] == "<s>" else 1
        levels[k] = below
    d = {k: kn.discounts([sum(v == j for v in c.values()) for j in (1, 2, 3, 4)]) for k, c in levels.items()}
    heads = {k: defaultdict(lambda: [0, 0, 0, 0]) for k in levels}
    for k, c in levels.items():
        for g, n in c.items():
            h = heads[k][g[:-1]]
            h[0] += n
            h[min(n, 3)] += 1
    big = len(raw)

    def p(g):
        k = len(g)
        low = p(g[1:]) if k > 1 else 1 / (big + 1)
        h = heads[k].get(g[:-1])
        if not h:
            return low
        n = levels[k].get(g, 0)
        return max(n - (0, *d[k])[min(n, 3)], 0) / h[0] + sum(x * y for x, y in zip(d[k], h[1:], strict=True)) / h[0] * low

    def score(t):
        w = ["<s>"] * (order - 1) + words(t)
        grams = [tuple(w[k : k + order]) for k in range(len(w) - order + 1)]
        total = sum(raw.values())
        base = sum(math.log10((raw[g[-1]] + 0.5) / (total + 0.5 * (big + 1))) for g in grams)
        return len(grams), sum(raw[g[-1]] > 0 for g in grams), total, base, sum(math.log10(p(g)) for g in grams)

    return score


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_plain(spark, order):
    df = spark.createDataFrame([(k, t, 7) for k, t in enumerate(TEXTS)], "doc_id long, text string, score int")
    train = [t for k, t in enumerate(TEXTS) if k % 3]
    model = kn.fit(df.filter("doc_id % 3 <> 0"), order=order, shards=4)
    want = plain(train, order)
    for r in kn.score(df, model, keep=["doc_id"]).collect():
        n, known, total, base, score = want(TEXTS[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    model = kn.fit(df, shards=2)
    words = {w for t in TEXTS for w in (t or "").lower().split()} | {"unknownword"}
    for context in ("the", "cat", "zzz"):
        score = lambda t: model.score([kn.tokens(t)])[0][0]
        head = sum(math.log10(1) for _ in ()) + model.score([kn.tokens(context)[:1]])[0][0]
        total = sum(10 ** (model.score([kn.tokens(f"{context} {w}")[:2]])[0][0] - head) for w in words)
        total += 10 ** (score(context) - head)
        assert total == pytest.approx(1)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = kn.fit(none)
    assert kn.score(none, model, keep=["doc_id"]).count() == 0
    one = kn.score(spark.createDataFrame([(1, "x y")], "doc_id long, text string"), model, keep=["doc_id"]).first()
    assert (one["score"], one["base_score"], one["n_known"], one["n_tokens"]) == (0, 0, 0, 3)
