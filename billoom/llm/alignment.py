"""Alignment of the tokens that two tokenizers make of the same text.

Both are run over a space and the text. Where a token of A and a token of B end at the same byte the text is cut into groups; an A
token and a B token whose bytes overlap are linked. How many documents hold a pair of ids linked is counted over the corpus, and each
document gets what its links amount to by those counts.

A text is cut before spaces between other characters, where both tokenizers always cut, and each distinct piece is encoded and
aligned once in a worker. What a document holds is a sum over its pieces.

Counting: each task turns its documents' pairs into postings (row, times) of (a, b) and writes them in blocks by a. The blocks are
shuffled by a and arrive sorted, so that Spark spills them. All postings of an A id give the counts of its pairs and their maximum, and go out
again as contributions of documents, which are added up by document. An A id with more postings than a task's share is cut into parts;
the counts of its pairs are summed first and come to each part before its blocks.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, default_partitions, few_rows
from .wordcodes import in_blocks

#: A cut before a space: no space (nor what stands for one in B) before it, no white space after it.
_CUT = re.compile("(?<=[^ \u2581]) (?=[^\\s\u180e])")
_BYTE = re.compile("<0x([0-9A-F]{2})>$")
#: Pieces encoded in one call.
RUN = 1000
#: Distinct pieces, and links of theirs, that a worker keeps before it starts anew.
MOST_PIECES, MOST_LINKS = 400_000, 4_000_000
#: Postings that a task gathers before it writes blocks of them, and contributions before it hands them on.
BLOCK = 1 << 20
#: Rows that stand together, as a power of two, when rows are dealt to buckets.
ROWS_TOGETHER = 8
#: Postings of an A id, or of a part of one, that meet in a task.
LEAST_PART, MOST_PART = 10_000, 1 << 20


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, ends) of two ways to cut the same bytes, given by where their tokens end: links of tokens i and j, and where both end.

    The ends of either kind cut the bytes into stretches, each in one token of a and one of b; two tokens that overlap share one stretch.
    """
    stretches = np.union1d(a, b)
    return np.searchsorted(a, stretches), np.searchsorted(b, stretches), np.intersect1d(a, b)


class Growing:
    """Rows of whole numbers that grow at the end."""

    def __init__(self, *width: int):
        self.all, self.n = np.zeros((1024, *width), np.int64), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.all):
            self.all = np.concatenate([self.all[: self.n], np.zeros((self.n + 2 * len(more), *self.all.shape[1:]), np.int64)])
        self.all[self.n : self.n + len(more)] = more
        self.n += len(more)

    def rows(self) -> np.ndarray:
        return self.all[: self.n]


class Aligner:
    """Numbers of tokens, groups and links, links and groups of whole texts. One for each worker process."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        alphabet = byte_level_alphabet()
        tokens = {i: bytes(map(alphabet.__getitem__, t)) if all(c in alphabet for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.bytes_a = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.bytes_b = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.long_a, self.long_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        # Ids as text, as they stand within a group's side and at its end.
        self.written = [f"{i}{c}" for of, end in ((self.bytes_a, "|"), (self.bytes_b, ";")) for i in range(len(of)) for c in (",", end)]
        self._start()

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = _BYTE.match(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def _start(self) -> None:
        """Forget all pieces: of each its place, tokens, groups and links, and whether its bytes are right."""
        self.known: dict[str, int] = {}
        self.sizes, self.groups, self.ends, self.pairs = Growing(5), [], Growing(), Growing()

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, ...]:
        """Ids of A and the pieces that they are of, then of B."""
        a, of_a = [], []
        for at in range(0, len(pieces), RUN):
            got = self.a.encode([" " + p for p in pieces[at : at + RUN]], is_pretokenized=True, add_special_tokens=False)
            a.append(np.array(got.ids, np.int64))
            of_a.append(np.array(got.word_ids, np.int64) + at)
        b = self.b.encode(pieces, num_threads=1)
        many = np.array(list(map(len, b)), np.int64)
        flat = np.fromiter(itertools.chain.from_iterable(b), np.int64, int(many.sum()))
        return np.concatenate(a), np.concatenate(of_a), flat, np.repeat(np.arange(len(pieces)), many)

    def _wrong(self, pieces: list[str], a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray) -> np.ndarray:
        """Pieces whose tokens' bytes are not a space and the piece."""
        n, want = len(pieces), [(" " + p).encode() for p in pieces]
        out, whole = np.zeros(n, bool), b"".join(want)
        for ids, of, long, tokens in ((a, of_a, self.long_a, self.bytes_a), (b, of_b, self.long_b, self.bytes_b)):
            total = np.zeros(n, np.int64)
            np.add.at(total, of, long[ids])
            out |= total != np.array(list(map(len, want)), np.int64)
            joined = b"".join(map(tokens.__getitem__, ids.tolist()))
            if joined != whole:
                ends = np.cumsum(total)
                out |= np.array([joined[e - t : e] != w for e, t, w in zip(ends.tolist(), total.tolist(), want, strict=True)])
        return out

    def _learn(self, pieces: list[str]) -> None:
        n = len(pieces)
        a, of_a, b, of_b = self._encoded(pieces)
        wrong = self._wrong(pieces, a, of_a, b, of_b)
        if wrong.any():
            (a, of_a), (b, of_b) = ((ids[~wrong[of]], of[~wrong[of]]) for ids, of in ((a, of_a), (b, of_b)))
        end_a, end_b = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b])
        i, j, cuts = align(end_a, end_b)
        count = lambda of: np.bincount(of, minlength=n)
        sizes = np.stack([count(of_a), count(of_b), count(of_a[np.searchsorted(end_a, cuts)]), count(of_a[i]), wrong], axis=1).astype(np.int64)
        # Groups as text: in each the tokens of A, then those of B.
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        last = lambda g: np.r_[g[1:] != g[:-1], np.ones(min(1, len(g)), bool)]
        flat = np.empty(len(a) + len(b), np.int64)
        flat[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = 2 * a + last(group_a)
        flat[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = 2 * (len(self.bytes_a) + b) + last(group_b)
        text, ends = list(map(self.written.__getitem__, flat.tolist())), np.cumsum(sizes[:, 0] + sizes[:, 1]).tolist()
        self.known.update(zip(pieces, range(len(self.groups), len(self.groups) + n), strict=True))
        self.groups += ["".join(text[s:e]) for s, e in zip([0, *ends], ends, strict=False)]
        self.sizes.add(sizes)
        self.ends.add(self.pairs.n + np.cumsum(sizes[:, 3]))
        self.pairs.add(a[i] << 32 | b[j])

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of a and b, groups, links) by text and the digests of the groups; text, pair (a << 32 | b) and times of each text's links."""
        if len(self.known) > MOST_PIECES or self.pairs.n > MOST_LINKS:
            self._start()
        cut = [_CUT.split(t) if t else [] for t in texts]
        found = [list(map(self.known.get, x)) for x in cut]
        if fresh := list(dict.fromkeys(p for x, f in zip(cut, found, strict=True) if None in f for p, k in zip(x, f, strict=True) if k is None)):
            self._learn(fresh)
            found = [list(map(self.known.get, x)) if None in f else f for x, f in zip(cut, found, strict=True)]
        at = [np.array(f, np.int64) for f in found]
        sizes, pairs = self.sizes.rows(), self.pairs.rows()
        starts = np.r_[0, self.ends.rows()]
        sums = np.array([sizes[x].sum(axis=0) for x in at], np.int64).reshape(-1, 5)
        wrong = sums[:, 4] > 0
        sums[wrong] = 0
        groups = self.groups
        digests = [hashlib.sha256("".join([groups[k] for k in f])[:-1].encode()).hexdigest() if n else "" for f, n in zip(found, sums[:, 0].tolist(), strict=True)]
        # Pieces of each text with their numbers, then their links.
        whole = [np.empty(0, np.int64) if w else x for x, w in zip(at, wrong, strict=True)]
        text = np.repeat(np.arange(len(texts)), list(map(len, whole)))
        keys, times = np.unique(text * len(sizes) + np.concatenate([*whole, np.empty(0, np.int64)]), return_counts=True)
        text, piece = keys // max(1, len(sizes)), keys % max(1, len(sizes))
        many = starts[piece + 1] - starts[piece]
        places = np.repeat(starts[piece] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        text, times, pair = np.repeat(text, many), np.repeat(times, many), pairs[places]
        order = np.lexsort((pair, text))
        text, times, pair = text[order], times[order], pair[order]
        first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])][: len(text)])
        return sums[:, :4], digests, text[first], pair[first], np.add.reduceat(times, first) if len(first) else times


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


_DOCS = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
_ENCODED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, base long, n int, b binary, rows binary, times binary"


def encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each document (a is null), and blocks of postings by A id.

    A block has for n postings, sorted by B id, the B id, the row beyond ``base`` and the times in that row (unsigned 32-bit each).
    """

    def none(n: int, *types) -> list[pa.Array]:
        return [pa.nulls(n, t) for t in types]

    def blocks(row: np.ndarray, pair: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(pair, kind="stable")
        row, pair, times, base = row[order], pair[order], times[order], int(row.min())
        a, first = np.unique(pair >> 32, return_index=True)
        ends = np.r_[first[1:], len(pair)]
        cut = lambda x: pa.array([x[s:e].tobytes() for s, e in zip(first, ends, strict=True)], pa.binary())
        n, long = len(a), pa.int64()
        return pa.RecordBatch.from_arrays([*none(n, long, long, long, long, long, long, pa.string()), pa.array(a.astype(np.int32)), pa.array(np.full(n, base)), pa.array((ends - first).astype(np.int32)), cut((pair & 0xFFFFFFFF).astype("<u4")), cut((row - base).astype("<u4")), cut(times.astype("<u4"))], _NAMES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = aligner(path_a, path_b), []
        for b in few_rows(batches):
            rows, ids = b.column("row").to_numpy(), b.column("doc_id")
            for at, texts in in_blocks(b.column("text").to_pylist()):
                sums, digests, text, pair, times = of.texts(texts)
                row, n = rows[at : at + len(texts)], len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(row), ids.slice(at, n), *(pa.array(sums[:, k]) for k in range(4)), pa.array(digests, pa.string()), *none(n, pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())], _NAMES)
                if len(text):
                    held.append((row[text], pair, times))
                # Rows of one task count up from its first, so 32 bits hold what lies between them.
                if sum(len(x[0]) for x in held) >= BLOCK:
                    yield blocks(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
        if held:
            yield blocks(*map(np.concatenate, zip(*held, strict=True)))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, _ENCODED)


_NAMES = [c.split()[0] for c in _ENCODED.split(", ")]


def _u4(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(column[k].as_py(), "<u4").astype(np.int64)


def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, count) of each batch of blocks: in how many rows a pair stands."""
    for x in batches:
        keys = [np.empty(0, np.int64)] + [np.int64(a) << 32 | _u4(x.column("b"), k) for k, a in enumerate(x.column("a").to_pylist())]
        pair, count = np.unique(np.concatenate(keys), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array((pair >> 32).astype(np.int32)), pa.array(pair & 0xFFFFFFFF), pa.array(count)], ["a", "b", "count"])


def _added(row: np.ndarray, best: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums by row, in order of row."""
    rows, at = np.unique(row, return_inverse=True)
    sums = np.zeros((2, len(rows)), np.int64)
    np.add.at(sums[0], at, best)
    np.add.at(sums[1], at, total)
    return rows, sums[0], sums[1]


def contributions(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, rows, n_best, count_sum) from runs of one (a, part): first totals of its pairs, if it has parts, then its blocks.

    What goes out are blocks too: sums by row of all runs since the last, for each bucket of rows.
    """
    run, held = None, []
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def close() -> None:
        """All postings of a run, at most MOST_PART and a block."""
        b, row, times, totals = ([x[k] for x in held if x[k] is not None] for k in range(4))
        if not b:
            return
        b, row, times = map(np.concatenate, (b, row, times))
        ids, at, count = np.unique(b, return_inverse=True, return_counts=True)
        if totals:
            known, all_of = np.array(totals, np.int64).T
            order = np.argsort(known)
            count, most = all_of[order][np.searchsorted(known[order], ids)], all_of.max()
        else:
            most = count.max()
        out.append((row, np.where(count[at] == most, times, 0), count[at] * times))

    def blocks() -> pa.RecordBatch:
        row, best, total = _added(*map(np.concatenate, zip(*out, strict=True)))
        out.clear()
        bucket = (row >> ROWS_TOGETHER) % buckets
        order = np.argsort(bucket, kind="stable")
        found, first = np.unique(bucket[order], return_index=True)
        cut = lambda x: pa.array([y.tobytes() for y in np.split(x[order].astype("<i8"), first[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), cut(row), cut(best), cut(total)], ["bucket", "rows", "n_best", "count_sum"])

    for x in batches:
        a, part, base, total = (x.column(c).to_pylist() for c in ("a", "part", "base", "total"))
        for k in range(x.num_rows):
            if (a[k], part[k]) != run:
                close()
                run, held = (a[k], part[k]), []
                if sum(len(y[0]) for y in out) >= BLOCK:
                    yield blocks()
            if total[k] is None:
                held.append((_u4(x.column("b"), k), base[k] + _u4(x.column("rows"), k), _u4(x.column("times"), k), None))
            else:
                held.append((None, None, None, (total[k]["b"], total[k]["count"])))
    close()
    if out:
        yield blocks()


def row_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, n_best, count_sum) from all blocks of the rows of some buckets: added up as they come, so that a task holds its rows once."""
    held, fresh = (np.empty(0, np.int64),) * 3, []
    for x in batches:
        fresh += [tuple(np.frombuffer(x.column(c)[k].as_py(), "<i8") for c in ("rows", "n_best", "count_sum")) for k in range(x.num_rows)]
        if sum(len(y[0]) for y in fresh) >= max(BLOCK, len(held[0])):
            held, fresh = _added(*map(np.concatenate, zip(held, *fresh, strict=True))), []
    held = _added(*map(np.concatenate, zip(held, *fresh, strict=True)))
    yield pa.RecordBatch.from_arrays(list(map(pa.array, held)), ["row", "n_best", "count_sum"])


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs(doc_id, text, ...).

    path_a: a byte-level BPE of the tokenizers library; path_b: a sentencepiece model that puts a space before the text. Null and empty
    texts, and those whose bytes either tokenizer alters, have zeros and ''. Every row is a document: rows that repeat an id or a text count each and
    are returned each; a null doc_id stays null; other columns are ignored; an empty table gives an empty result.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "alignment")
    n = default_partitions(spark)
    both = scratch.keep(encoded(docs, path_a, path_b), "encoded")
    blocks = both.filter("a IS NOT NULL").select("a", "base", "n", "b", "rows", "times")
    # A row for each A id at most, which the vocabulary bounds.
    sizes = scratch.keep(blocks.groupBy("a").agg(F.sum("n").alias("n")), "sizes")
    all_of = sizes.agg(F.sum("n")).first()[0] or 0
    share = min(MOST_PART, max(LEAST_PART, all_of // n))
    large = sizes.filter(F.col("n") > share).select("a", F.ceil(F.col("n") / share).cast("int").alias("parts"))
    pairs = blocks.join(F.broadcast(large.select("a")), "a", "left_semi").select("a", "b").mapInArrow(pair_counts, "a int, b long, count long")
    totals = pairs.groupBy("a", "b").agg(F.sum("count").alias("count")).join(F.broadcast(large), "a")
    totals = totals.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.struct("b", "count").alias("total"))
    dealt = blocks.join(F.broadcast(large), "a", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("base", "a"), F.col("parts")).cast("int"), F.lit(0)))
    stream = dealt.select("a", "part", "base", "b", "rows", "times").unionByName(totals, allowMissingColumns=True)
    stream = stream.repartition(n, "a", "part").sortWithinPartitions("a", "part", F.col("total").isNull())
    given = stream.mapInArrow(lambda batches: contributions(batches, n), "bucket int, rows binary, n_best binary, count_sum binary")
    sums = given.repartition(n, "bucket").mapInArrow(row_sums, "row long, n_best long, count_sum long")
    rows = both.filter("a IS NULL").select("row", *_DOCS, "groups_sha256")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return rows.join(sums, "row", "left").select(*_DOCS, *zero, "groups_sha256")
