"""The mixture against a plain version: counts, order, targets, and odd rows."""

from __future__ import annotations

import hashlib
import math

import pytest

from billoom.llm import mixing

SCHEMA = "doc_id long, text string, source string, copy string, n_copies string, shuffle_key int, _rate double"


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", "n", 1, 0.5) for r in rows], SCHEMA)


def plain(rows, mean_of, seed):
    out = []
    for doc_id, _, source in rows:
        mean, key, n = mean_of[source or ""], "" if doc_id is None else str(doc_id), 0
        parts = max(1, math.ceil(mean / mixing.PART))
        for part in range(1, parts + 1):
            u = int(hashlib.md5(f"{seed}|{key}|{part}".encode()).hexdigest()[:13], 16) / 16**13
            k, p = 0, math.exp(-mean / parts)
            below = p
            while below <= u:
                k += 1
                p *= mean / parts / k
                below += p
            n += k
        out += [(hashlib.md5(f"{seed}-order|{key}|{c}".encode()).hexdigest(), doc_id, c, n) for c in range(1, n + 1)]
    return sorted(out, key=lambda r: (r[0], r[1] is not None, r[1] or 0))


ROWS = [(k, "ab" * (k % 7), ["big", "big", "big", "small", None][k % 5]) for k in range(120)] + [(7, "x", "big")] * 3 + [(None, "é", "small"), (500, None, "nothing"), (501, "", "nothing"), (502, "z" * 3_000, "long")]


@pytest.mark.parametrize("weights, budget, part", [(None, 1.0, 128.0), ({"small": 3.0, "big": 1.0}, 1.0, 128.0), ({"small": 1.0}, 1.0, 8.0), ({}, 1.0, 128.0)])
def test_against_plain(spark, monkeypatch, weights, budget, part):
    monkeypatch.setattr(mixing, "PART", part)
    sizes: dict[str, int] = {}
    for _, t, s in ROWS:
        sizes[s or ""] = sizes.get(s or "", 0) + len((t or "").encode())
    share = {s: (n**0.5 if weights is None else weights.get(s, 0.0)) for s, n in sizes.items()}
    scale = budget * sum(sizes.values()) / (sum(w for s, w in share.items() if sizes[s]) or 1.0)
    mean_of = {s: share[s] * scale / n if n else 1.0 for s, n in sizes.items()}
    assert part > 8 or max(mean_of.values()) > 3 * part
    got = mixing.mix(table(spark, ROWS).repartition(5), weights=weights, budget=budget, seed=3)
    rows = [(r["shuffle_key"], r["doc_id"], r["copy"], r["n_copies"]) for r in got.collect()]
    assert rows == plain(ROWS, mean_of, 3)
    assert sorted(got.columns) == sorted(["doc_id", "text", "source", "_rate", "copy", "n_copies", "shuffle_key"])


def test_many_sources_are_cut(spark, monkeypatch):
    want = sorted(map(tuple, mixing.mix(table(spark, ROWS), seed=3).collect()), key=repr)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert sorted(map(tuple, mixing.mix(table(spark, ROWS), seed=3).collect()), key=repr) == want


def test_nothing(spark):
    assert mixing.mix(table(spark, [])).count() == 0
