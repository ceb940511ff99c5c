"""run() of the corpus pipeline against a plain Python version, and the license scan against its SQL."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from billoom.llm import langid, queries, simhash

LIMIT, END = 4096, 1


def trigrams(text):
    kept = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
    return [f" {kept} "[k : k + 3] for k in range(len(kept))] if kept else []


def in_a_language(rows):
    counts: dict[str, Counter] = {}
    for doc_id, text, lang, *_ in rows:
        if lang is not None and text is not None and (doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 != 1):
            counts.setdefault(lang, Counter()).update(trigrams(text))
    rate = {k: {g: n / c.total() for g, n in c.items() if n / c.total() >= langid.MIN_RATE} for k, c in counts.items()}
    best = {g: max(r.get(g, 0) for r in rate.values()) for r in rate.values() for g in r}
    sets = {k: {g for g, x in r.items() if x >= langid.MIN_RATIO * best[g]} for k, r in rate.items()}
    shares = lambda gs: [sum(g in s for g in gs) / len(gs) for s in sets.values()]
    return [r for r in rows if (gs := trigrams(r[1])) and max(shares(gs)) >= corpus_pipeline.LEAST_COVERAGE]


def simhash_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    n = simhash.SHINGLE_WORDS
    shingles = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def one_of_each(rows):
    prints, left, out = [simhash_of(r[1]) for r in rows], set(range(len(rows))), []
    while left:
        group, front = set(), {min(left)}
        while front:
            group |= front
            left -= front
            front = {j for j in left for i in front if (prints[i] ^ prints[j]).bit_count() <= 3}
        out.append(min((rows[i] for i in group), key=lambda r: (r[0] is None, r[0] or 0)))
    return out


def drawn(rows, seed=5):
    sizes = Counter()
    for r in rows:
        sizes[r[3] or ""] += len((r[1] or "").encode())
    scale = sum(sizes.values()) / sum(math.sqrt(n) for n in sizes.values())
    out = []
    for r in rows:
        mean = math.sqrt(sizes[r[3] or ""]) * scale / sizes[r[3] or ""]
        u = int(hashlib.md5(f"{seed}|{'' if r[0] is None else r[0]}|1".encode()).hexdigest()[:13], 16) / 16**13
        p = below = math.exp(-mean)
        copies = 0
        while below <= u:
            copies += 1
            p *= mean / copies
            below += p
        out += [r] * copies
    return out


def pieces(rows):
    tokenizer, out = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json")), Counter()
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, END]
        for k, at in enumerate(range(0, len(ids), LIMIT)):
            cut = ids[at : at + LIMIT]
            out[str(r[0]), k, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    return out


def corpus():
    rng, rows = np.random.default_rng(11), []
    bags = {"en": "the house and dog are here with some old trees over there when rain comes down again".split(), "de": "der hund und das haus sind hier mit alten bäumen dort wenn regen wieder auf die straße fällt".split()}
    for k in range(90):
        lang = "en" if k % 3 else "de"
        words = [str(w) for w in rng.choice(bags[lang], 9000 if k == 7 else int(rng.integers(15, 90)))]
        rows.append((k, " ".join(words), lang if k % 5 else None, ["big", "big", "small", None][k % 4], 0))
    rows += [(200 + k, rows[k][1].upper() if k % 2 else rows[k][1] + " .", "en", "big", 0) for k in range(20)]
    rows += [(300, None, "en", "big", 0), (301, "", "de", "small", 0), (302, "12 34 -", None, "big", 0), (303, "ыы ээ щщ", None, "big", 0), (None, "the dog and the old house are here", "en", "small", 0)]
    # an id with another text, and a row that is there twice
    return rows + [(4, "the rain comes down over some old trees and the house again when dog are here there with", "en", "big", 0), rows[10]]


def test_run(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    kept = one_of_each(in_a_language(rows))
    assert 0 < len(kept) <= len(rows) - 14 and not {300, 301, 302, 303} & {r[0] for r in kept}
    want = pieces(drawn(kept))
    ids = ["None" if pd.isna(d) else str(int(d)) for d in got.doc_id]
    assert Counter(zip(ids, got.piece, got.start, got.length, got.ids_crc32, strict=True)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= LIMIT
    assert got.sequence_id.nunique() <= 1.1 * got.length.sum() / LIMIT + 1


def test_run_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_license_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(queries.OP9_SQL).df()
    got = queries.op9_license_scan(spark, folder).toPandas()
    text = lambda df: sorted(map(repr, df.astype(object).where(df.notna(), None)[["doc_id", "path", "license", "score", "via", "from_dir"]].values.tolist()))
    assert text(got) == text(want) and set(got.via) == {"own", "inherited", "none"}
