"""The order of the registered n-gram query, its blocks, split pivots, rounds of dealing and arrays."""

from __future__ import annotations

import os

import numpy as np
import pytest

from test_kneserney import TEXTS, plain

from billoom.llm import kneserney as kn
from billoom.llm import queries


def test_query_fits_trigrams(spark, monkeypatch):
    fitted, fit = [], kn.fit
    monkeypatch.setattr(kn, "fit", lambda *a, **k: fitted.append(fit(*a, **k)) or fitted[-1])
    assert queries.op8_kneser_ney(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    files = os.listdir(fitted[0].folder.removeprefix("file://"))
    assert fitted[0].order >= 3 and {"gram3", "from3", "gram2", "from2", "gram1"} <= {f.split("-")[0] for f in files}


def test_blocks_keep_their_rows():
    rng = np.random.default_rng(2)
    ids, counts = [rng.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in range(3)], [rng.integers(0, 1 << 40, 500, dtype=np.uint64) for _ in range(2)]
    a, b = kn.unpack(kn.pack(ids, counts), 3, 2)
    assert sorted(zip(*a, *b, strict=True)) == sorted(zip(*ids, *counts, strict=True))


@pytest.mark.parametrize("n", [1, 2, 17, 5000])
def test_arrays_give_what_was_saved(tmp_path, n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    values = np.stack([rng.choice([1, 1, 1, 7, 300, 1 << 40], len(keys)), rng.choice([1, 1, 2], len(keys)), *np.zeros((2, len(keys)), int)], axis=1).astype(np.uint64)
    kn.save(f"file://{tmp_path}/x", keys, values, (1, 1, 0, 0))
    arrays, want = kn.Arrays(np.memmap(f"{tmp_path}/x", np.uint8, "r"), (1, 1, 0, 0)), np.zeros((2 * len(keys), 4))
    asked = np.concatenate([keys, keys ^ np.uint64(1 << 40)])
    by = np.argsort(asked)
    arrays.find(asked[by], want)
    back = np.empty_like(want)
    back[by] = want
    assert (back[: len(keys)] == values).all() and not back[len(keys) :].any()


@pytest.mark.parametrize("order", [2, 3, 4, 5])
@pytest.mark.parametrize("split, rounds", [(1, 10), (1 << 30, 10), (6, 1)])
def test_splits_and_rounds_change_nothing(spark, monkeypatch, order, split, rounds):
    monkeypatch.setattr(kn, "SPLIT", split)
    monkeypatch.setattr(kn, "ROUND_BITS", rounds)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = plain(TEXTS[:9], order)
    for r in kn.score(df, kn.fit(df.filter("doc_id < 9"), order=order, shards=8), keep=["doc_id"]).collect():
        n, known, total, base, score = want(TEXTS[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (n, known, total, pytest.approx(base), pytest.approx(score))
