"""Source divergence against a plain version on whole numbers."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from billoom.llm import divergence


def plain(rows):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    docs = [(lang or "", source or "", words(text or "")) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = sorted(w for w, n in Counter(w for d in own for w in set(d[2])).items() if n >= 3)
        counts = defaultdict(Counter)
        for _, source, ws in own:
            counts[source].update(w for w in ws if w in set(kept))

        def shares(c, kept=kept):
            of = sum(c.values()) + len(kept)
            return {w: 1 + 10**9 * (c[w] + 1) // of for w in kept}

        q = shares(sum(counts.values(), Counter()))
        p = {s: shares(c) for s, c in counts.items()}
        for s in counts:
            pair = [(h, sum((p[s][w] - p[h][w]) ** 2 // p[h][w] for w in kept)) for h in counts if h != s]
            term = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, w, v, k) for k, (w, v) in enumerate(items, 1) if part == "pair" or k <= 200]
    return sorted(out)


def told(docs, **options):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(docs, **options).collect())


def rows_of(n, sources, seed=3):
    """Common words in all sources, some in a few of them, and some in one."""
    draw, out = random.Random(seed), []
    for k in range(n):
        s = draw.choice([0, 0, 0, *range(sources)])
        few, one = f"w{'abcdefghij'[s % 10]}{'xyz'[draw.randrange(3)]}", f"only{chr(97 + s % 26)}{chr(97 + s // 26)}"
        ws = [draw.choice(["the", "The", "une", "çedille", few, one, f"q{chr(97 + draw.randrange(26))}{chr(97 + (s + draw.randrange(3)) % 26)}", "x1y", "1,", "Ä-b"]) for _ in range(draw.randrange(30))]
        out.append((k, " ".join(ws), draw.choice(["en", "en", "de"]), f"s{s}"))
    return out


ODD = [(1, None, None, None), (None, "", "", ""), (2, "only one", "fr", "alone"), (3, "123 \x00 ...", "it", "a"), (3, "", "it", "b"), (4, "A a É é [a] `a~", "xx", "n"), (4, "A a É é [a] `a~", "xx", "n"), (5, "a " * 5000, "xx", "m"), (6, "É", "xx", None)]


def test_against_plain(spark):
    rows = rows_of(500, 40) + ODD
    docs = spark.createDataFrame([(*r, "t", 1) for r in rows], "doc_id long, text string, lang string, source string, term string, g int").repartition(6)
    assert told(docs) == plain(rows)


def test_blocks_of_groups_and_small_tasks(spark, monkeypatch):
    """Several blocks of groups, tiles and parts."""
    for name, value in {"TILE_TERMS": 5, "ONE_SIDED": 20, "LIGHT_CELLS": 30, "ENTRIES": 200, "PAIRS": 50, "BROADCAST_GROUPS": 3}.items():
        monkeypatch.setattr(divergence, name, value)
    rows = rows_of(300, 23, seed=5)
    assert told(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), block=7) == plain(rows)


def test_empty_table(spark):
    assert told(spark.createDataFrame([], "doc_id long, text string, lang string, source string")) == []


def test_share_is_exact(spark):
    cases = [(1, 1), (1, 3), (7, 9), (999_999_999_999, 1_000_000_000_000), (8_999_999_999_999_990, 8_999_999_999_999_999), (5 * 10**12, 3 * 10**14)]
    got = spark.createDataFrame(cases, "c long, n long").selectExpr("c", "n", f"{divergence.share('c', 'n')} AS p").collect()
    assert all(r["p"] == 1 + 10**9 * r["c"] // r["n"] for r in got)
