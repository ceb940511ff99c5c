"""Exact top-k search: sharded inverted index, BM25, block-max WAND pruning, exact merge with global statistics.

A shard is one file: its documents' ids and lengths, a sorted dictionary, for each term the documents
that hold it with their counts, in document order and blocks of 64, and of each block the greatest count and the length of its
shortest document. Shards are cut from the input's own partitions, so building shuffles nothing. Document
frequencies are added up over all shards' dictionaries before any is searched, so a shard's scores are those of one
index over everything. Queries are parsed into files, a block of them each; the driver sees numbers of blocks and names of shards alone.

Under the global statistics a block's greatest count and least length give its maximum (a bound: BM25 rises with the count and
falls with the length). A search walks a query's terms in groups, rare ones first, holding exact partial scores. A
document stays while its partial score plus the block maxima, at its place, of the terms still to come (the weak-AND
bound) reaches the k-th best partial score; blocks without such a document are skipped: their postings are neither read
nor scored. Groups of terms stand for single cursors, so that the steps are array operations. Ties with the k-th
stay, so the answer is that of scoring everything.

The bounds of many words together reach the k-th score nearly everywhere, so a long query's postings are all added up.
Queries that share words stand together; the words that many of them and of a shard's documents have are added for
all of them at once, as a product of two matrices, the others posting by posting.

A term adds qtf * idf * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)), idf = ln(1 + (N - df + 0.5) / (df + 0.5)), with all but
qtf rounded to a multiple of 2^-24: sums are then exact in doubles, in any order.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, give_back, load_arrays, save_arrays

K1, B = 1.2, 0.75
#: Bytes of text and documents at which a shard is closed.
SHARD_BYTES, SHARD_DOCS = 1 << 26, 1 << 16
BLOCK = 64
#: A query's terms are cut into groups where so much of their postings has been seen.
GROUPS = (1 / 50, 1 / 10, 1)
#: Bytes of texts whose words are numbered together, in building.
SLICE_BYTES = 1 << 20
#: Postings put in order at a time.
RUN_POSTS = 1 << 19
#: Blocks of postings that a query looks at together.
RUN_BLOCKS = 1 << 12
#: Shards that a task searches one after another, at most.
SHARDS_A_TASK = 16
#: Bytes of query texts in a block.
QUERY_BYTES = 1 << 23
#: A query of more different words is long: nearly every block of its words can hold one of the best, so they are all added up, without bounds.
LONG = 8
#: Long queries that are searched together.
RUN_QUERIES = 128
#: Terms that so large a share of all pairs of a run's queries and a shard's documents have are added by a product of matrices, in which a pair costs as much less than a posting.
COMMON = 1 / 60
#: Bytes of the scores of those terms in a shard, and of the scores of the queries that are multiplied by them at a time.
MATRIX_BYTES, SCORE_BYTES = 3 << 23, 1 << 23
#: Words that tell kinds of queries apart, most kinds, rounds of k-means, and queries that are looked at for it and at a time.
KIND_WORDS, KINDS, KIND_ROUNDS, KIND_SAMPLE = 256, 8, 8, 1 << 11
SCALE = float(1 << 24)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then runs of bytes other than space and \\x09-\\x0d."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _blocks(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each block of postings begins, and the number of blocks of each term."""
    blocks = -(-sizes // BLOCK)
    within = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return np.repeat(np.cumsum(sizes) - sizes, blocks) + BLOCK * within, blocks


class Builder:
    """Collects documents until the shard is full; write() gives its manifest row.

    Words are cut and numbered in Arrow, a slice of texts at a time, and kept as numbers: no word of a text becomes a Python object.
    """

    def __init__(self):
        self.ids, self.lengths, self.words, self.slices, self.n, self.bytes = [], [], [], [], 0, 0

    def add(self, doc_id: int, text: str | None) -> None:
        self.extend(pa.array([doc_id], pa.int64()), pa.array([text], pa.string()))

    def extend(self, ids: pa.Array, texts: pa.Array, shard_bytes: int = SHARD_BYTES) -> int:
        """Take documents from the front, to the end of a slice or until the shard is full; their number."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        n = min(len(ids), SHARD_DOCS - self.n, 1 + int(np.searchsorted(ends, min(SLICE_BYTES, shard_bytes - self.bytes))))
        # Arrow's own lower-casing (23.0) goes wrong on slices of large strings.
        low = _bytes(pc.fill_null(texts.slice(0, n).cast(pa.large_binary()), b"")).tobytes().translate(LOWER)
        cut = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.concatenate([[0], ends[:n]])), pa.py_buffer(low)))
        flat, doc = cut.flatten(), pc.list_parent_indices(cut).to_numpy()
        there = pc.not_equal(flat, "")  # white space at either end of a text leaves an empty word
        coded, doc = flat.filter(there).dictionary_encode(), doc[there.to_numpy(zero_copy_only=False)]
        held, counts = np.unique(doc * len(flat) + coded.indices.to_numpy(), return_counts=True)
        doc_of, term = np.divmod(held, max(1, len(flat)))
        self.slices.append(((self.n + doc_of).astype(np.uint16), term.astype(np.int32), _small(counts)))
        self.words.append(coded.dictionary.cast(pa.binary()))
        self.ids.append(np.array(ids.slice(0, n)))  # a copy: a view would hold the whole batch, texts and all
        self.lengths.append(np.bincount(doc, minlength=n))
        self.n, self.bytes = self.n + n, self.bytes + int(ends[n - 1])
        return n

    def full(self, shard_bytes: int) -> bool:
        return self.bytes >= shard_bytes or self.n == SHARD_DOCS

    def write(self, folder: str) -> tuple[str, int, int]:
        """Writes the shard and gives up what was collected."""
        give_back()
        # Documents of like length stand together: a block's least length is then near that of all in it, and its maximum tight.
        lengths = np.concatenate(self.lengths)
        by = np.argsort(lengths, kind="stable")
        ids, lengths, rank = np.concatenate(self.ids)[by], _small(lengths[by]), np.empty(self.n, np.uint16)
        rank[by] = np.arange(self.n, dtype=np.uint16)
        # The slices' words to places in one sorted dictionary.
        firsts = np.cumsum([0, *map(len, self.words)]).tolist()
        coded, self.words = pa.concat_arrays(self.words), []
        coded = coded.dictionary_encode()
        sort = pc.array_sort_indices(coded.dictionary)
        place = np.empty(len(sort), np.int32)
        place[sort.to_numpy()] = np.arange(len(sort), dtype=np.int32)
        names, place = coded.dictionary.take(sort), place[coded.indices.to_numpy()]
        del coded, sort
        n = sum(len(s[0]) for s in self.slices)
        docs, term, counts = np.empty(n, np.uint16), np.empty(n, np.int32), np.empty(n, np.result_type(np.uint8, *(s[2] for s in self.slices)))
        at = 0
        for k, (d, t, c) in enumerate(self.slices):
            z = at + len(d)
            docs[at:z], term[at:z], counts[at:z], self.slices[k] = rank[d], place[firsts[k] + t], c, None
            at = z
        del place
        # Postings by term, then document: terms of some RUN_POSTS postings at a time, for all at once their order takes more room than they do.
        sizes = sum((np.bincount(term[a : a + RUN_POSTS], minlength=len(names)) for a in range(0, n, RUN_POSTS)), np.zeros(len(names), np.int64))
        seen, at = np.cumsum(sizes), 0
        to_docs, to_counts = np.empty_like(docs), np.empty_like(counts)
        cuts = np.unique(np.searchsorted(seen, np.arange(0, n + RUN_POSTS, RUN_POSTS), side="left")).tolist()
        for a, z in zip(cuts, [*cuts[1:], len(names)], strict=True):
            some = np.flatnonzero((term >= a) & (term < z))
            some = some[np.argsort(term[some].astype(np.int64) << 16 | docs[some])]
            to_docs[at : at + len(some)], to_counts[at : at + len(some)] = docs[some], counts[some]
            at += len(some)
        del term
        docs, counts = to_docs, to_counts
        at = _blocks(sizes)[0]
        parts = {
            "ids": ids,
            "lengths": lengths,
            "names": _bytes(names.cast(pa.large_binary())),
            "name_sizes": _small(pc.binary_length(names).to_numpy()),
            "sizes": _small(sizes),
            "docs": docs,
            "counts": counts,
            "block_count": _small(np.maximum.reduceat(counts, at) if len(at) else counts),
            "block_length": _small(np.minimum.reduceat(lengths[docs], at) if len(at) else counts),
        }
        path = f"{folder}/{uuid.uuid4().hex}.npz"
        save_arrays(path, **parts)
        del names, docs, counts, to_docs, to_counts, parts
        give_back()
        return path, self.n, int(lengths.sum(dtype=np.int64))


def build(docs: DataFrame, scratch: Scratch, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The manifest (path, n_docs, n_words) of the shards of docs(doc_id, text). Null ids take no part."""
    folder = scratch.path("shards")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], Builder()
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            while len(ids):
                n = now.extend(ids, texts, shard_bytes)
                ids, texts = ids.slice(n), texts.slice(n)
                if now.full(shard_bytes):
                    done.append(now.write(folder))
                    now = Builder()
        if now.n:
            done.append(now.write(folder))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "n_docs", "n_words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // shard_bytes)))
    return scratch.keep(rows.mapInArrow(scan, "path string, n_docs long, n_words long"), "manifest")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of things that end at ``ends``, with no more than ``most`` in each but for single ones."""
    a = 0
    while a < len(ends):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, z
        a = z


def _bytes(names: pa.LargeBinaryArray) -> np.ndarray:
    """The names end to end."""
    ends = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
    return np.frombuffer(names.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


def _names(shard) -> pa.LargeBinaryArray:
    """A shard's dictionary, sorted."""
    sizes = shard["name_sizes"]
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(shard["names"])])


def _dictionary(shard, asked: list[bytes] | None = None) -> dict[bytes, int]:
    """Places of all words of a shard, or of those asked that it holds."""
    if asked is None:
        return {w: k for k, w in enumerate(_names(shard).to_pylist())}
    return {w: k for w, k in zip(asked, _places(shard, asked).tolist(), strict=True) if k >= 0}


def _places(shard, asked: list[bytes] | pa.LargeBinaryArray) -> np.ndarray:
    """The place of each asked word in a shard's dictionary, -1 where it is not in it."""
    # A table of the asked words alone: a shard has many more.
    of = pc.fill_null(pc.index_in(_names(shard), asked if isinstance(asked, pa.Array) else pa.array(asked, pa.large_binary())), -1).to_numpy()
    there, place = np.flatnonzero(of >= 0), np.full(len(asked), -1)
    place[of[there]] = there
    return place


def _alike(terms: list[np.ndarray], n_words: int) -> np.ndarray:
    """An order of queries by kind, by k-means over the commonest of their words, and of a kind by length: those that stand together share more words."""
    column = np.full(n_words, -1)
    common = np.argsort(-np.bincount(np.concatenate([*terms, np.empty(0, np.int64)]), minlength=n_words), kind="stable")[:KIND_WORDS]
    column[common] = np.arange(len(common))

    def rows(some: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(some), len(common)))
        for row, t in zip(x, some, strict=True):
            at = column[t]
            row[at[at >= 0]] = 1
        return x / np.maximum(1, np.sqrt(x.sum(axis=1, keepdims=True)))

    x = rows(terms[:: -(-len(terms) // KIND_SAMPLE)])
    x = x[x.any(axis=1)]
    centres = x[:1]
    while 0 < len(centres) < KINDS:  # each the farthest from those before
        near = (x @ centres.T).max(axis=1)
        if near.min() > 0.99:
            break
        centres = np.concatenate([centres, x[near.argmin()][None]])
    for _ in range(KIND_ROUNDS if len(x) else 0):
        kind = (x @ centres.T).argmax(axis=1)
        centres = np.stack([x[kind == k].sum(axis=0) for k in range(len(centres))])
        centres /= np.maximum(1e-9, np.sqrt((centres**2).sum(axis=1, keepdims=True)))
    kind = [(rows(terms[a : a + KIND_SAMPLE]) @ centres.T).argmax(axis=1) for a in range(0, len(terms), KIND_SAMPLE) if len(x)]
    return np.lexsort((np.array(list(map(len, terms))), np.concatenate(kind) if kind else np.zeros(len(terms))))


class Shard:
    """The asked terms in one shard: their block maxima under global statistics, and the scaled scores of the blocks that were visited.

    ``blocks`` counts blocks: offered to queries, visited by them, and different ones scored; ``added`` the postings that were added one by one to a long query's scores.
    """

    def __init__(self, shard, number: dict[bytes, int] | np.ndarray, asked: list[bytes] | pa.LargeBinaryArray, idf: np.ndarray, average: float):
        self.ids, sizes = shard["ids"], shard["sizes"].astype(np.int64)
        place = number if isinstance(number, np.ndarray) else np.array([number.get(w, -1) for w in asked], np.int64)
        there = np.flatnonzero(place >= 0)
        self.sizes = np.zeros(len(asked), np.int64)
        self.sizes[there] = sizes[place[there]]
        # Of each block of an asked term: number in the shard, postings there, and places for its scores here.
        _, blocks = _blocks(sizes)
        first_block, first_post = np.cumsum(blocks) - blocks, np.cumsum(sizes) - sizes
        self.block_at = np.concatenate([[0], np.cumsum(-(-self.sizes // BLOCK))])
        mine = np.diff(self.block_at)[there]
        which = _ranges(first_block[place[there]], mine)
        within = which - np.repeat(first_block[place[there]], mine)
        self.posts = np.repeat(first_post[place[there]], mine) + BLOCK * within
        self.lengths = np.minimum(BLOCK, np.repeat(sizes[place[there]], mine) - BLOCK * within)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.docs, self.counts = shard["docs"], shard["counts"]
        self.norm = K1 * (1 - B + B * shard["lengths"].astype(np.float64) / average)
        self.idf = np.repeat(idf[there], mine)
        self.most = self._scores(self.idf, shard["block_count"][which], K1 * (1 - B + B * shard["block_length"][which].astype(np.float64) / average))
        self.first, self.last = self.docs[self.posts].astype(np.int64), self.docs[self.posts + self.lengths - 1].astype(np.int64)
        # A posting's score is below ln(2 N + 2) (k1 + 1) 2^24, under 2^31 for N below 10^24.
        self.adds, self.scored = np.empty(int(self.lengths.sum()), np.int32), np.zeros(len(which), bool)
        self.blocks, self.added = {"offered": 0, "visited": 0, "scored": 0}, 0
        self.unique, self.at_unique, self.of = np.unique(self.ids, return_index=True, return_inverse=True)
        self.repeats = len(self.unique) if len(self.unique) < len(self.ids) else 0
        #: Of each asked term its first score here; the documents beside the scores, once all are scored, and arrays that are used again: new memory costs more than what is done in it.
        self.add_at, self.asked_docs, self.room, self.matrices = np.cumsum(self.sizes) - self.sizes, None, np.empty(0), (np.empty(0),) * 2

    @staticmethod
    def _scores(idf: np.ndarray, tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        tf = tf.astype(np.float64)
        return np.floor(idf * (tf * (K1 + 1) / (tf + norm)) * SCALE + 0.5)

    def visit(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scaled scores) of the postings in these blocks, those scored that were not before."""
        self.blocks["visited"] += len(blocks)
        if len(new := blocks[~self.scored[blocks]]):
            self.blocks["scored"] += len(new)
            self.scored[new] = True
            idx = _ranges(self.posts[new], self.lengths[new])
            self.adds[_ranges(self.starts[new], self.lengths[new])] = self._scores(np.repeat(self.idf[new], self.lengths[new]), self.counts[idx], self.norm[self.docs[idx]])
        sizes = self.lengths[blocks]
        return self.docs[_ranges(self.posts[blocks], sizes)].astype(np.int64), self.adds[_ranges(self.starts[blocks], sizes)]

    def _score_all(self) -> None:
        """Score all blocks, and lay their documents beside the scores."""
        if self.asked_docs is not None:
            return
        self.asked_docs = np.empty(len(self.adds), np.uint16)
        for a in range(0, len(self.posts), RUN_BLOCKS):
            sizes = self.lengths[a : a + RUN_BLOCKS]
            idx = _ranges(self.posts[a : a + RUN_BLOCKS], sizes)
            docs, into = self.docs[idx], slice(int(self.starts[a]), int(self.starts[a]) + len(idx))
            self.asked_docs[into] = docs
            self.adds[into] = self._scores(np.repeat(self.idf[a : a + RUN_BLOCKS], sizes), self.counts[idx], self.norm[docs])
        self.blocks["scored"] += int((~self.scored).sum())
        self.scored[:] = True
        ends = np.append(self.add_at, len(self.adds))
        self.lists = [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.sizes), [None, pa.py_buffer(ends * x.itemsize), pa.py_buffer(x)]) for x in (self.asked_docs, self.adds)]

    def _kth(self, scores: np.ndarray, k: int) -> float:
        """The k-th best score of different ids, 0 if there are fewer."""
        if self.repeats:
            best = np.zeros(self.repeats)
            np.maximum.at(best, self.of, scores)
            scores = best
        return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0.0

    def search(self, terms: np.ndarray, weights: np.ndarray, own: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scaled scores) of the k best, ties to the smaller id; only scores over 0 and from ``least`` on."""
        n = len(self.ids)
        held = self.sizes[terms] > 0
        terms, weights = terms[held], weights[held]
        order = np.argsort(self.sizes[terms], kind="stable")
        terms, weights = terms[order], weights[order]
        if not len(terms):
            return np.empty(0, np.int64), np.empty(0)
        seen = np.cumsum(self.sizes[terms])
        cuts = np.unique(np.concatenate([[0], np.searchsorted(seen, np.array(GROUPS) * seen[-1], side="right"), [len(terms)]]))
        groups = []
        for a, z in zip(cuts[:-1], np.minimum(cuts[1:], len(terms)), strict=True):
            t = terms[a:z]
            counts = self.block_at[t + 1] - self.block_at[t]
            blocks = _ranges(self.block_at[t], counts)
            q = np.repeat(weights[a:z], counts)
            bound = self.most[blocks] * q
            at = np.cumsum(np.bincount(self.first[blocks], bound, n + 1) - np.bincount(self.last[blocks] + 1, bound, n + 1))[:n]
            groups.append((blocks, q, at))
            self.blocks["offered"] += len(blocks)
        score, alive, rest = np.zeros(n), self.ids != own, sum(g[2] for g in groups)
        for blocks, q, at in groups:
            upto = np.concatenate([[0], np.cumsum(alive)])
            used = upto[self.last[blocks] + 1] > upto[self.first[blocks]]
            blocks, q = blocks[used], q[used]
            # A long query's postings are looked at in runs of blocks: all at once they can be those of the whole shard.
            for a in range(0, len(blocks), RUN_BLOCKS):
                run, of = blocks[a : a + RUN_BLOCKS], q[a : a + RUN_BLOCKS]
                at_doc, adds = self.visit(run)
                score += np.bincount(at_doc, adds * np.repeat(of, self.lengths[run]) if (of != 1).any() else adds, n)
            score[~alive] = 0
            rest = rest - at
            least = max(least, self._kth(score, k))
            alive &= (score + rest >= least) & (score + rest > 0)
        best = np.flatnonzero(alive & (score > 0))
        best = best[np.lexsort((self.ids[best], -score[best]))]
        if self.repeats:
            best = best[np.sort(np.unique(self.ids[best], return_index=True)[1])]
        return self.ids[best[:k]], score[best[:k]]

    def _best(self, score: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best of all documents' scores, as search() gives them."""
        if self.repeats:
            at = np.flatnonzero((score >= max(least, self._kth(score, k))) & (score > 0))
        else:
            # k runs of documents with a best of so much: the k-th best document has no less.
            whole = len(score) // BLOCK * BLOCK
            most = score[:whole].reshape(-1, BLOCK).max(axis=1)
            if len(most) >= k:
                least = max(least, np.partition(most, len(most) - k)[len(most) - k])
            at = np.concatenate([_ranges(BLOCK * (runs := np.flatnonzero(most >= least)), np.full(len(runs), BLOCK)), np.arange(whole, len(score))])
            at = at[(score[at] >= least) & (score[at] > 0)]
        at = at[np.lexsort((self.ids[at], -score[at]))]
        if self.repeats:
            at = at[np.sort(np.unique(self.ids[at], return_index=True)[1])]
        return self.ids[at[:k]], score[at[:k]]

    def search_all(self, queries: list[tuple[np.ndarray, np.ndarray, int, float]], k: int) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
        """(its number, what search() finds) of each (terms, weights, own, least)."""
        long = []
        for at, q in enumerate(queries):
            if len(q[0]) > LONG:
                long.append(at)
            else:
                yield at, self.search(*q[:3], k, q[3])
        for a in range(0, len(long), RUN_QUERIES):
            run = long[a : a + RUN_QUERIES]
            yield from zip(run, self.search_long([queries[at] for at in run], k), strict=True)

    def search_long(self, queries: list[tuple[np.ndarray, np.ndarray, int, float]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """search() of each (terms, weights, own, least), all postings added up.

        Terms that many of these queries and documents have are added for all of them at once, by a product of matrices
        of whole numbers; it is exact in doubles, as any other sum of them.
        """
        self._score_all()
        n, pairs = len(self.ids), np.bincount(np.concatenate([q[0] for q in queries]), minlength=len(self.sizes)) * self.sizes
        common = np.flatnonzero(pairs > COMMON * len(queries) * n)
        common = common[np.argsort(-pairs[common], kind="stable")[: MATRIX_BYTES // (8 * n)]]
        column = np.full(len(self.sizes), -1)
        column[common] = np.arange(len(common))
        some = max(1, min(len(queries), SCORE_BYTES // (8 * n)))
        self.matrices = tuple(old if len(old) >= cells else np.empty(cells) for old, cells in zip(self.matrices, (len(common) * n, some * n), strict=True))
        adds, scores = (m[: rows * n].reshape(rows, n) for m, rows in zip(self.matrices, (len(common), some), strict=True))
        adds[:] = 0
        for row, at, size in zip(adds, self.add_at[common].tolist(), self.sizes[common].tolist(), strict=True):
            row[self.asked_docs[at : at + size]] = self.adds[at : at + size]
        for a in range(0, len(queries), some):
            run = queries[a : a + some]
            asks = np.zeros((len(run), len(common)))
            for row, (terms, weights, _, _) in zip(asks, run, strict=True):
                there = column[terms] >= 0
                row[column[terms[there]]] = weights[there]
            for score, (terms, weights, own, least) in zip(np.matmul(asks, adds, out=scores[: len(run)]), run, strict=True):
                there = (column[terms] < 0) & (self.sizes[terms] > 0)
                self._add(score, terms[there], weights[there])
                self._drop(score, own)
                yield self._best(score, k, least)

    def _drop(self, score: np.ndarray, own: int) -> None:
        at = int(np.searchsorted(self.unique, own))
        if at < len(self.unique) and self.unique[at] == own:
            score[self.at_unique[at]] = 0
            if self.repeats:
                score[self.ids == own] = 0

    def _add(self, score: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        """Add all postings of terms."""
        order = np.argsort(weights, kind="stable")
        terms, weights = terms[order], weights[order]
        for a, z in _runs(np.cumsum(self.sizes[terms]), RUN_POSTS):
            sizes = self.sizes[terms[a:z]]
            m = int(sizes.sum())
            self.added += m
            if len(self.room) < m:
                self.room = np.empty(m)
            # Arrow lays the terms' postings end to end as it does strings.
            docs, adds = (np.frombuffer(lists.take(pa.array(terms[a:z])).buffers()[2], dtype, m) for lists, dtype in zip(self.lists, (np.uint16, np.int32), strict=True))
            sums = self.room[:m]
            sums[:] = adds
            if (many := int(np.searchsorted(weights[a:z], 1, side="right"))) < z - a:
                sums[int(sizes[:many].sum()) :] *= np.repeat(weights[a + many : z], sizes[many:])
            np.add.at(score, docs, sums)


def _dealt(manifest: DataFrame, blocks: int) -> DataFrame:
    """(path, block) for each shard and block of queries; a task has one block and a run of shards, so it gives a block's best of all of them."""
    spark = manifest.sparkSession
    paths = sorted(r["path"] for r in manifest.select("path").collect())
    run = min(SHARDS_A_TASK, max(1, len(paths) * blocks // (8 * spark.sparkContext.defaultParallelism)))
    shards = spark.createDataFrame([(p, n // run) for n, p in enumerate(paths)], "path string, run long")
    runs = -(-len(paths) // run)
    pairs = shards.select("path", "run", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return pairs.repartitionById(runs * blocks, (F.col("block") * runs + F.col("run")).cast("int")).select("path", "block").sortWithinPartitions("path")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, shard_bytes: int = SHARD_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, doc_id, score): for each row of queries(doc_id, text) the k best of docs(doc_id, text) by BM25, exactly.

    A query's own id is no candidate; documents that share no word with it are none either. Ties go to the smaller
    doc_id. Null ids take no part; null texts are empty and count as documents of length 0. Of rows that repeat a
    doc_id each counts in the statistics and the best scoring stands for the id; of queries that repeat an id the
    least text asks. Empty tables or queries without words: no rows. Other columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "bm25")
    manifest = build(docs, scratch, shard_bytes)
    n, total = manifest.agg(F.sum("n_docs"), F.sum("n_words")).first()
    asked = queries.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    asked = scratch.keep(asked, "queries")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not total or not size:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    blocks, average, folder = -(-size // query_bytes), total / n, scratch.path("blocks")

    def parse(key, t):
        """A block's queries to a file; its words, numbered, come out."""
        number: dict[bytes, int] = {}
        terms, weights = [], []
        for text in t.column("text").to_pylist():
            got = Counter(words(text))
            terms.append(np.fromiter((number.setdefault(w, len(number)) for w in got), np.int64, len(got)))
            weights.append(np.fromiter(got.values(), np.float64, len(got)))
        block, order = key[0].as_py(), _alike(terms, len(number))
        terms, weights = [terms[k] for k in order], [weights[k] for k in order]
        ends = np.cumsum([0, *map(len, terms)])
        save_arrays(f"{folder}/queries-{block}.npz", ids=t.column("doc_id").to_numpy()[order], ends=ends, terms=np.concatenate(terms), weights=np.concatenate(weights), names=np.frombuffer(b" ".join(number), np.uint8))
        return pa.table({"block": pa.array([block] * len(number), pa.int64()), "n": pa.array(range(len(number)), pa.int64()), "word": pa.array(list(number), pa.binary())})

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                shard = load_arrays(path)
                names, sizes, shard = _names(shard), shard["sizes"].astype(np.int64), None
                for at in range(0, len(sizes), 1 << 16):
                    yield pa.RecordBatch.from_arrays([names[at : at + (1 << 16)].cast(pa.binary()), pa.array(sizes[at : at + (1 << 16)])], ["word", "df"])
        names = None
        give_back()

    def weigh(key, t):
        block, df = key[0].as_py(), np.zeros(t.num_rows, np.int64)
        df[t.column("n").to_numpy()] = t.column("df").to_numpy()
        save_arrays(f"{folder}/idf-{block}.npz", idf=np.array([math.log(1 + (n - d + 0.5) / (d + 0.5)) for d in df.tolist()]))
        return pa.table({"block": pa.array([block], pa.int64())})

    dealt = asked.withColumn("_block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    wanted = scratch.keep(dealt.groupBy("_block").applyInArrow(parse, "block long, n long, word binary"), "words")
    held = manifest.select("path").repartition(max(spark.sparkContext.defaultParallelism, manifest.count() // 4)).mapInArrow(frequencies, "word binary, df long")
    known = held.groupBy("word").agg(F.sum("df").alias("df"))
    # The vocabulary grows with the input: a merge join, whatever its size.
    weighed = wanted.join(known.hint("merge"), "word", "left").select("block", "n", F.coalesce("df", F.lit(0)).alias("df"))
    written = {r["block"] for r in scratch.keep(weighed.groupBy("block").applyInArrow(weigh, "block long"), "weighed").collect()}  # a row for each block

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q = None, None
        best: dict[int, tuple[np.ndarray, list]] = {}
        for b in batches:
            for path, block in zip(b.column("path").to_pylist(), b.column("block").to_pylist(), strict=True):
                if block not in written:
                    continue
                shard = here = None  # one shard and one block at a time
                if block != now:
                    now, q = block, None
                    q = dict(load_arrays(f"{folder}/queries-{block}.npz")) | dict(load_arrays(f"{folder}/idf-{block}.npz"))
                    q["names"] = pa.array(q["names"].tobytes().split(b" "), pa.large_binary())
                give_back()
                shard = dict(load_arrays(path))
                here = Shard(shard, _places(shard, q["names"]), q["names"], q["idf"], average)
                held = best.setdefault(block, (q["ids"], [(np.empty(0, np.int64), np.empty(0))] * len(q["ids"])))[1]
                del shard["names"], shard["name_sizes"]
                asks = [(q["terms"][a:z], q["weights"][a:z], own, float(h[1][-1]) if len(h[0]) == k else 0.0) for a, z, own, h in zip(q["ends"][:-1].tolist(), q["ends"][1:].tolist(), q["ids"].tolist(), held, strict=True)]
                for at, (ids, scores) in here.search_all(asks, k):
                    if len(ids):
                        ids, scores = np.concatenate([held[at][0], ids]), np.concatenate([held[at][1], scores])
                        order = np.lexsort((ids, -scores))
                        order = order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]
                        held[at] = ids[order], scores[order]
        shard = here = q = None
        give_back()
        for of, held in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(of, [len(h[0]) for h in held])), pa.array(np.concatenate([h[0] for h in held])), pa.array(np.concatenate([h[1] for h in held]) / SCALE)], ["query_id", "doc_id", "score"])

    out = _dealt(manifest, blocks).mapInArrow(scan, "query_id long, doc_id long, score double")
    best = out.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= k)
    return scratch.keep(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "found")
