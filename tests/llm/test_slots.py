"""Sharding by virtual slots: the law on the shards' bytes, what moves between versions of the map, odd rows."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np

from billoom.llm import slots


def held(result):
    """By shard the rows, after checking that places are gapless."""
    out = defaultdict(list)
    for r in result.rows.collect():
        out[r["shard"]].append(r)
    for rows in out.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    return out


def weight(rows):
    return sum(len((r["text"] or "").encode()) + 1 for r in rows)


def test_bytes_are_near_equal(spark):
    rows = [(k, "ä" * (k * 37 % 101) if k % 7 else None) for k in range(3000)]
    got = held(slots.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 16))
    sizes = [weight(got[s]) for s in range(16)]
    assert sorted((r["doc_id"], r["text"]) for x in got.values() for r in x) == sorted(rows)
    assert max(sizes) - min(sizes) <= max(len((t or "").encode()) + 1 for _, t in rows)


def test_hot_key_null_keys_and_clashing_columns(spark):
    """A key on a third of all rows, a null key on a third, two long texts."""
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, "t" * 50, 1, 2) for k in range(3000)] + [(-5, "x" * 40_000, 1, 2), (-6, "x" * 40_000, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, size int").repartition(3)
    got = held(slots.shard(docs, 4))
    assert sorted((r["doc_id"] or -1, len(r["text"])) for x in got.values() for r in x) == sorted((r[0] or -1, len(r[1])) for r in rows)
    sizes = [weight(got[s]) for s in range(4)]
    assert max(sizes) - min(sizes) <= 40_001


def test_empty_table_and_one_row(spark):
    assert slots.shard(spark.createDataFrame([], "doc_id long, text string"), 4).rows.count() == 0
    assert [(r["doc_id"], r["text"], r["slot"]) for r in slots.shard(spark.createDataFrame([(None, None)], "doc_id long, text string"), 4).rows.collect()] == [(None, None, 0)]


def test_versions(spark):
    """Version 2 evens out version 1 with few moves, version 3 moves cells into the new shard alone; a version is never written again."""
    draw = np.random.default_rng(1)
    load = draw.integers(0, 1000, (slots.SLOTS, slots.PARTS)) * (draw.random((slots.SLOTS, 1)) ** 4 * 10).astype(np.int64)
    first = slots.even_map(16)
    second = slots.rebalanced(first, load, 16)
    third = slots.grown(second, load, 16)
    by = lambda m, n: np.bincount(m.ravel(), load.ravel(), n)
    assert np.ptp(by(second, 16)) <= load.sum() / 16 * 1e-4 < np.ptp(by(first, 16))
    assert (first != second).mean() < 0.2
    moved = second != third
    assert set(third[moved].tolist()) == {16} and by(third, 17)[16] > load.sum() / 17 * 0.9
    assert by(third, 17).max() <= load.sum() / 17 * 1.05
    maps = slots.shard(spark.createDataFrame([(k, "t" * k) for k in range(100)], "doc_id long, text string"), 4).maps
    one, two, three = (maps.read(v) for v in (1, 2, 3))
    assert (one == slots.even_map(4)).all() and set(np.unique(two)) <= set(range(4)) and set(three[two != three].tolist()) <= {4}
    try:
        maps.write(2, one)
    except Exception as e:
        assert "already exists" in str(e)
    else:
        raise AssertionError("a version was overwritten")


def test_text_survives(spark):
    text = "é\x00\n" * 1000
    r = slots.shard(spark.createDataFrame([(1, text)], "doc_id long, text string"), 2).rows.first()
    assert zlib.crc32(r["text"].encode()) == zlib.crc32(text.encode())
