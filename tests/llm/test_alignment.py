"""Alignment of two tokenizers' tokens against a plain version that encodes and compares whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from billoom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(texts):
    a_of, b_of = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_of.encode_special_tokens = True
    names = {i: t for t, i in a_of.get_vocab().items()}
    alphabet = alignment.byte_level_alphabet()

    def bytes_b(i):
        p = b_of.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_of.is_byte(i) else p.replace("▁", " ").encode()

    found = []
    for t in texts:
        a, b = (a_of.encode(" " + t, add_special_tokens=False).ids, b_of.encode(t)) if t else ([], [])
        in_a, in_b = [bytes(alphabet[c] for c in names[i]) for i in a], [bytes_b(i) for i in b]
        if not t or not b"".join(in_a) == b"".join(in_b) == (" " + t).encode():
            found.append(None)
            continue

        def spans(parts):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            return out

        sa, sb = spans(in_a), spans(in_b)
        links = [(a[i], b[j]) for i, (s, e) in enumerate(sa) for j, (u, v) in enumerate(sb) if s < v and u < e]
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, before = [], 0
        for end in ends:
            groups.append(",".join(str(x) for x, (s, e) in zip(a, sa, strict=True) if before < e <= end) + "|" + ",".join(str(x) for x, (s, e) in zip(b, sb, strict=True) if before < e <= end))
            before = end
        found.append((len(a), len(b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(p for x in found if x for p in set(x[3]))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    return [(*x[:3], len(x[3]), sum(count[p] == best[p[0]] for p in x[3]), sum(count[p] for p in x[3]), x[4]) if x else (0, 0, 0, 0, 0, 0, "") for x in found]


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b c", "\n", "\n x", "x\n y\t z", "\x00 a", "a\x1c b", "a \x1c b", "a\xa0 b", "a \xa0b", "a᠎ b", "a ᠎b",
    "<|endoftext|>", "a <|endoftext|> b", "<s> </s> <unk> <0x41>", "▁", "a▁b", "a ▁b", "a▁ b", "ﬁne ½ ①", "é a ́b", "日本語 の テスト 日本語", "🙂 🙂🙂 👩‍👩‍👧", "it's 1,000.00 o'clock",
    "word " * 300, "x" * 5000, "word " * 300, "don't stop, don't stop; the the the",
]


def test_whole_texts(spark):
    draw = random.Random(7)
    words = ["the", "The", "über", "naïve", "straße", "co-op", "x1", "9,99", "…", "\t", "", " ", "é", "\n", "end.", "(a)", "Ünïcödé", "zzzzqqq", "の"]
    texts = [*ODD, *(" ".join(draw.choice(words) for _ in range(draw.randint(1, 60))) for _ in range(120))]
    rows = [(k if k != 3 else None, t, "x", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, a int").repartition(5)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.alignments(docs, A, B).collect()}
    want = {k if k != 3 else None: x for k, x in enumerate(plain(texts))}
    assert {k: (want[k], got.get(k)) for k in want if want[k] != got.get(k)} == {}


def test_large_ids_are_cut_into_parts(spark, monkeypatch):
    texts = [f"the {'the ' * (k % 3)}w{k % 11} a. b" for k in range(400)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    monkeypatch.setattr(alignment, "LEAST_PART", 40)
    monkeypatch.setattr(alignment, "MOST_PART", 40)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.alignments(docs, A, B).collect()}
    assert got == dict(enumerate(plain(texts)))


def test_empty_table_and_repeated_rows(spark):
    assert alignment.alignments(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    rows = [(1, "a b"), (1, "a b"), (None, None), (None, "b")]
    got = alignment.alignments(spark.createDataFrame(rows, "doc_id long, text string"), A, B)
    assert sorted((r["doc_id"] or 0, *(r[c] for c in COLUMNS)) for r in got.collect()) == sorted((d or 0, *x) for (d, _), x in zip(rows, plain([t for _, t in rows]), strict=True))


@pytest.mark.parametrize("a, b, links, cuts", [([2, 3], [1, 3], [(0, 0), (0, 1), (1, 1)], [3]), ([1, 2], [1, 2], [(0, 0), (1, 1)], [1, 2]), ([4], [1, 4], [(0, 0), (0, 1)], [4])])
def test_align(a, b, links, cuts):
    i, j, ends = alignment.align(np.array(a), np.array(b))
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == links and ends.tolist() == cuts
