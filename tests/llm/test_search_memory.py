"""What a worker of the block-max search holds while it builds and searches a shard."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from billoom.llm import bm25

DOCS, WORDS = 300, 4000


def _texts(spread: int) -> list[str]:
    rng = np.random.default_rng(5)
    return [" ".join(f"word{int(x):06d}" for x in rng.integers(0, spread, WORDS)) for _ in range(DOCS)]


def _shard(texts: list[str], folder: str):
    build = bm25.Builder()
    for k, t in enumerate(texts):
        build.add(k, t)
    return build.write(folder)


def _peak(call) -> int:
    """Bytes of Python objects and numpy arrays."""
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    out = call()
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert out is not None
    return peak


def test_building_holds_numbers_not_words(tmp_path):
    texts = _texts(1_000_000)
    assert _peak(lambda: _shard(texts, f"file://{tmp_path}")) < 7 * sum(map(len, texts))


def test_long_query_reads_postings_in_runs(tmp_path):
    path, n, total = _shard(_texts(5000), f"file://{tmp_path}")
    shard = dict(bm25.load_arrays(path))
    asked = list(bm25._dictionary(shard))
    here = bm25.Shard(shard, bm25._dictionary(shard, asked), asked, np.ones(len(asked)), total / n)
    terms, postings = np.arange(len(asked)), len(shard["docs"])
    assert postings > 600_000
    assert _peak(lambda: here.search(terms, np.ones(len(asked)), -1, 10, 0.0)) < 32 * postings
    # all of them are what a search of single blocks adds up
    ids, scores = here.search(terms, np.ones(len(asked)), -1, 10, 0.0)
    every, want = np.arange(len(here.most)), np.zeros(n)
    for a in range(0, len(every), 7):
        at, adds = here.visit(every[a : a + 7])
        np.add.at(want, at, adds)
    order = np.lexsort((here.ids, -want))[:10]
    assert ids.tolist() == here.ids[order].tolist() and scores.tolist() == want[order].tolist()


def test_words_of_slices_are_those_of_texts(tmp_path):
    """Slices, nulls, white space of all kinds, other letters; only asked words are looked up."""
    odd = [None, "", " \t\n", "  A\x0bb\x0c\r a ", "É é\x85x\xa0y \x1c Z", "b" * 300 + " B", "\x00 a"]
    texts = odd + [f"Word{k % 97} {'x' * (k % 5)} É{k}" for k in range(500)] + odd
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    build, ids, all_texts = bm25.Builder(), rows.column("doc_id").slice(2), rows.column("text").slice(2)
    while len(ids):
        k = build.extend(ids.slice(0, 13), all_texts.slice(0, 13))
        ids, all_texts = ids.slice(k), all_texts.slice(k)
    path, n, total = build.write(f"file://{tmp_path}")
    shard, want = dict(bm25.load_arrays(path)), {k: bm25.words(t) for k, t in enumerate(texts) if k >= 2}
    assert n == len(want) and total == sum(map(len, want.values()))
    number, got = bm25._dictionary(shard), {}
    assert list(number) == sorted({w for ws in want.values() for w in ws})
    ends = np.cumsum(shard["sizes"], dtype=np.int64)
    for word, at in number.items():
        docs = shard["docs"][ends[at] - shard["sizes"][at] : ends[at]].tolist()
        assert docs == sorted(set(docs))
        for d, c in zip(docs, shard["counts"][ends[at] - shard["sizes"][at] : ends[at]].tolist(), strict=True):
            got[int(shard["ids"][d]), word] = c
    assert got == {(k, w): ws.count(w) for k, ws in want.items() for w in ws}
    assert dict(zip(shard["ids"].tolist(), shard["lengths"].tolist(), strict=True)) == {k: len(ws) for k, ws in want.items()}
    some = [b"a", b"nowhere", b"b" * 300, "é".encode()]
    assert bm25._dictionary(shard, some) == {w: number[w] for w in some if w in number}
