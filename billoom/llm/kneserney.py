"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, mapped by workers.

Counting. Tasks count their texts' n-grams of the highest order and deal them, as compressed blocks of columns, to
shards by what stands between the first word and the last (the pivot). A shard then holds all of an n-gram's context and all
of its tail (the n-gram without its first word), so it writes the counts, what is known of each context (its total; how many n-grams
have count one, two, more), the continuation counts of the tails and what is known of the tails' contexts, and
passes on only the counts two words shorter. Pivots that stand for much of the text (by a table of token counts of
fixed size) are split: their n-grams are dealt by context and their tails pass through one more exchange.
What is split changes no count. There are as many shards as the volume of text asks for; over 1024 of them are
dealt in several rounds.

Words are 64-bit hashes; the texts' own counts of words are carried along for the plain unigram base. An n-gram's
key is a 64-bit hash: an index of its first bits, then 40 bits in sorted arrays, so a look-up of an
n-gram that is not there goes wrong once in about 10^11. N-grams of count one take their key alone, small counts a byte.

Scoring. Every worker maps the arrays from the shared folder and looks up a block of texts at a time, in
order of hash; p(w | v) = max(c(vw) - D, 0) / c(v.) + gamma(v) p(w), down to a uniform share 1 / (V + 1) that also is the
probability of any word not known.
"""

from __future__ import annotations

import json
import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, open_store, own_names, write_whole

ORDER = 3
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Ids of the end of a text and of what stands before its first word; no word has them.
END, START = 1, 0
TASK_TOKENS = 4 << 20
SCORE_TOKENS = 1 << 19
#: Bytes of text whose n-grams make a shard, and (as a power of two) the most shards dealt in one round.
SHARD_BYTES = 32 << 20
ROUND_BITS = 10
#: A pivot is split if its share is more than this part of a shard's.
SPLIT = 4
#: Bytes of arrays a worker has mapped (or holds, where the shared folder cannot be mapped) at a time.
HELD_BYTES = 128 << 20


def tokens(text: str | None) -> np.ndarray:
    """The ids of a text's words, then its end: A-Z lowered, words are what ASCII white space parts."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    ids = np.empty(len(words) + 1, np.uint64)
    ids[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    np.maximum(ids[:-1], np.uint64(2), out=ids[:-1])
    ids[-1] = END
    return ids


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_keys(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit keys of n-grams given by columns of word ids."""
    out = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + c)
    return out


def windows(ids: list[np.ndarray], order: int) -> list[np.ndarray]:
    """Columns of the n-grams that end at each token of each text; before the first word stand START ids."""
    pad = np.zeros(order - 1, np.uint64)
    flat = np.concatenate([x for t in ids for x in (pad, t)]) if ids else np.empty(0, np.uint64)
    ends = np.ones(len(flat), bool)
    if order > 1:
        at = np.cumsum([0, *(len(t) + order - 1 for t in ids)])[:-1]
        for k in range(order - 1):
            ends[at + k] = False
    at = np.flatnonzero(ends)
    return [flat[at - k] for k in range(order - 1, -1, -1)]


# Blocks: rows in order of their columns of ids, as places in the block's list of different ids, and counts; compressed.
# The list has the 256 commonest ids first, then the next up to 65,536, each part sorted and kept as differences (modulo 2^64).


def _planes(column: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(column.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _column(raw: np.ndarray, width: int) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = raw.reshape(width, -1).T
    return wide.view("<u8").ravel().astype(np.uint64)


def pack(ids: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    words, at, times = np.unique(np.concatenate(ids), return_inverse=True, return_counts=True)
    part = np.empty(len(words), np.uint8)
    part[np.argsort(-times, kind="stable")] = np.searchsorted([256, 65536], np.arange(len(words)), side="right")
    order = np.argsort(part, kind="stable")
    place = np.empty(len(words), np.uint32)
    place[order] = np.arange(len(words), dtype=np.uint32)
    words, at = words[order], place[at].reshape(len(ids), -1)
    by = np.lexsort((at[-1], at[0], *at[-2:0:-1]))  # the middle first: a shard has few of those
    parts = [np.array([len(by), len(words)], "<u4").tobytes(), _planes(np.diff(words, prepend=np.uint64(0)), 8)]
    parts += [_planes(c[by], 4) for c in at] + [_planes(c[by], 5) for c in counts]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(block: bytes, n_ids: int, n_counts: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    (n, m), at = raw[:8].view("<u4").tolist(), 8
    words, at = np.cumsum(_column(raw[at : at + 8 * m], 8), dtype=np.uint64), at + 8 * m
    out: list[np.ndarray] = []
    for k in range(n_ids + n_counts):
        width = 4 if k < n_ids else 5
        column = _column(raw[at : at + width * n], width)
        out.append(words[column] if k < n_ids else column)
        at += width * n
    return out[:n_ids], out[n_ids:]


def summed(key: np.ndarray, columns: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Rows of equal key as one, in order of key; counts added (without counts: how many rows), columns taken from any of them."""
    by = np.argsort(key)
    key = key[by]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    add = lambda c: np.add.reduceat(c[by], first) if len(first) else c[by]
    return key[first], [c[by[first]] for c in columns], [add(c) for c in counts] or [np.diff(first, append=len(key)).astype(np.uint64)]


@dataclass
class Dealing:
    """To which shard an n-gram goes. ``hot``: by length, which 16-bit classes of pivots are split."""

    order: int
    bits: int
    hot: dict[int, np.ndarray]

    def paired(self, level: int) -> bool:
        """Whether shards of this level hold whole tails too; levels between are what split pivots leave."""
        return level > 2 and (self.order - level) % 2 == 0

    def is_hot(self, pivot: list[np.ndarray]) -> np.ndarray:
        return self.hot[len(pivot)][(gram_keys(pivot) >> np.uint64(48)).astype(np.int64)]

    def _shard(self, key: np.ndarray) -> np.ndarray:
        return (_mix(key + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(key), np.int64)

    def grams(self, ids: list[np.ndarray]) -> np.ndarray:
        if len(ids) == 1:
            return self._shard(gram_keys(ids))
        pivot, whole = (ids[1:-1], ids[:-1]) if self.paired(len(ids)) else (ids[:-1], ids)
        return self._shard(np.where(self.is_hot(pivot), gram_keys(whole), gram_keys(pivot)))

    def contexts(self, ids: list[np.ndarray]) -> np.ndarray:
        """Of the contexts of n-grams one word longer."""
        return self.grams([*ids, ids[0]]) if self.paired(len(ids) + 1) else self._shard(gram_keys(ids))


# A file of arrays: rows parted into those of the usual values (keys alone), of values of a byte, two bytes, eight bytes; each in order of key.

USUAL = {"gram": (1,), "gram1": (1, 1), "from": (1, 1, 0, 0)}


def usual(kind: str) -> tuple[int, ...]:
    return USUAL["gram1" if kind == "gram1" else kind[:4]]


def save(path: str, keys: np.ndarray, values: np.ndarray, rule: tuple[int, ...]) -> None:
    """keys sorted; values (rows, len(rule))."""
    plain, most = (values == np.array(rule, np.uint64)).all(axis=1), values.max(axis=1, initial=0)
    parts, head = [], []
    for width, rows in ((0, plain), (1, ~plain & (most < 256)), (2, ~plain & (most >= 256) & (most < 65536)), (8, ~plain & (most >= 65536))):
        if n := int(rows.sum()):
            k = keys[rows]
            bits = max(0, math.ceil(math.log2(n)) - 4)
            first = (k >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(n, np.int64)
            rest = (k << np.uint64(bits)) >> np.uint64(24)
            held = [np.searchsorted(first, np.arange((1 << bits) + 1)).astype("<u4" if n < 1 << 32 else "<u8"), (rest >> np.uint64(8)).astype("<u4"), (rest & np.uint64(255)).astype("<u1")]
            held += [values[rows].astype(f"<u{width}")] if width else []
            head.append({"n": n, "bits": bits, "width": width})
            parts += held
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 4) % 8)

    def write(stream) -> None:
        stream.write(len(text).to_bytes(4, "little") + text)
        for a in parts:
            stream.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 8))

    write_whole(path, write)


class Arrays:
    """A file of save() over mapped or read bytes."""

    def __init__(self, data: np.ndarray, rule: tuple[int, ...]):
        size = int.from_bytes(data[:4].tobytes(), "little")
        at, self.tiers, self.rule, self.bytes = 4 + size, [], np.array(rule, np.float64), len(data)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            size = np.dtype(kind).itemsize * n
            out = data[at : at + size].view(kind)
            at += size + -size % 8
            return out

        for t in json.loads(data[4 : 4 + size].tobytes()):
            index = take("<u4" if t["n"] < 1 << 32 else "<u8", (1 << t["bits"]) + 1)
            high, low = take("<u4", t["n"]), take("<u1", t["n"])
            self.tiers.append((t["bits"], index, high, low, take(f"<u{t['width']}", t["n"] * len(rule)).reshape(-1, len(rule)) if t["width"] else None))

    def find(self, keys: np.ndarray, want: np.ndarray) -> None:
        """Fill rows of want with the values of the keys that are here."""
        left = np.arange(len(keys))
        for bits, index, high, low, values in self.tiers:
            k = keys[left]
            first = (k >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(k), np.int64)
            rest = (k << np.uint64(bits)) >> np.uint64(24)
            a, b = (rest >> np.uint64(8)).astype(np.uint32), (rest & np.uint64(255)).astype(np.uint8)
            lo, hi = index[first].astype(np.int64), index[first + 1].astype(np.int64)
            end, most = hi.copy(), len(high) - 1
            for _ in range(int((hi - lo).max(initial=0)).bit_length()):
                mid = np.minimum((lo + hi) >> 1, most)
                x = high[mid]
                less = ((x < a) | ((x == a) & (low[mid] < b))) & (lo < hi)
                lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, np.minimum(mid, hi))
            at = np.minimum(lo, most)
            hit = (lo < end) & (high[at] == a) & (low[at] == b)
            want[left[hit]] = self.rule if values is None else values[at[hit]]
            left = left[~hit]
            if not len(left):
                return


# Rows of the counting jobs: blocks of n-grams (gramK), of context sums (fromK), or what is to be told of a file.
COUNTS = ("n", "total", "raw", "n1", "n2", "n3", "n4")
ROWS = "kind string, shard long, block binary, " + ", ".join(f"{c} long" for c in COUNTS)
_ARROW = pa.schema([("kind", pa.string()), ("shard", pa.int64()), ("block", pa.binary()), *((c, pa.int64()) for c in COUNTS)])


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)] if rows else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)


def _blocks(kind: str, shard: np.ndarray, ids: list[np.ndarray], counts: list[np.ndarray]) -> list[tuple]:
    """A row for each shard that has n-grams."""
    by = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(shard[by]) != 0, True]) if len(by) else np.zeros(1, np.int64)
    return [(kind, int(shard[by[a]]), pack([c[by[a:z]] for c in ids], [c[by[a:z]] for c in counts]), *(None,) * 7) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def _shape(kind: str, order: int) -> tuple[int, int]:
    """Columns of ids and of counts in a block."""
    level = int(kind[4:])
    return (level - 1, 4) if kind.startswith("from") else (level, 1 if level == order else 2)


def _batches_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for b in batches:
        for text in b.column("text"):
            held.append(tokens(text.as_py()))
            size += len(held[-1])
            if size >= TASK_TOKENS:
                yield held
                held, size = [], 0
    if held:
        yield held


def pivot_counts(texts: DataFrame, order: int) -> tuple[dict[int, np.ndarray], int]:
    """By length of pivot, how many places fall in each of 65,536 classes of pivots; and the number of tokens."""
    lengths = sorted({max(1, level - 2) for level in range(2, order + 1)}) or [1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(lengths), 1 << 16), np.int64)
        for held in _batches_of_texts(batches):
            starts = [np.concatenate([np.zeros(1, np.uint64), t]) for t in held]
            for k, n in enumerate(lengths):
                total[k] += np.bincount((gram_keys(windows(starts, n)) >> np.uint64(48)).astype(np.int64), minlength=1 << 16)
        for k, n in enumerate(lengths):
            at = np.flatnonzero(total[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n)), pa.array(at), pa.array(total[k][at])], ["length", "at", "n"])

    out = {n: np.zeros(1 << 16, np.int64) for n in lengths}
    for r in texts.mapInArrow(scan, "length long, at long, n long").groupBy("length", "at").agg(F.sum("n").alias("n")).collect():  # 65,536 a length at most
        out[r["length"]][r["at"]] = r["n"]
    return out, int(out[lengths[0]].sum())


def counted(texts: DataFrame, deal: Dealing) -> DataFrame:
    """Blocks of the texts' n-grams of the highest order with their counts."""
    order = deal.order

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _batches_of_texts(batches):
            columns = windows(held, order)
            _, ids, n = summed(gram_keys(columns), columns, [])
            yield from _rows(_blocks(f"gram{order}", _coarse(deal.grams(ids), deal.bits, 1), ids, n)).to_batches()

    return texts.mapInArrow(scan, ROWS)


def _coarse(shard: np.ndarray, bits: int, rounds: int) -> np.ndarray:
    """The shard as far as so many rounds of dealing tell."""
    return shard >> max(0, bits - rounds * ROUND_BITS)


def dealt_on(rows: DataFrame, deal: Dealing, level: int) -> DataFrame:
    """Rows whose blocks of this level have come to their shards, by as many further rounds as those need."""
    kinds = (f"gram{level}", f"from{level + 1}")
    for rounds in range(2, -(-deal.bits // ROUND_BITS) + 1):

        def scan(batches: Iterator[pa.RecordBatch], rounds=rounds) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            size, of = 0, None

            def told() -> pa.Table:
                ids = [np.concatenate(c) for c in zip(*(h[0] for h in held), strict=True)]
                counts = [np.concatenate(c) for c in zip(*(h[1] for h in held), strict=True)]
                _, ids, counts = summed(gram_keys(ids), ids, counts)
                shard = deal.contexts(ids) if of[0].startswith("from") else deal.grams(ids)
                return _rows(_blocks(of[0], _coarse(shard, deal.bits, rounds), ids, counts))

            for b in batches:
                for r in b.to_pylist():
                    if r["kind"] not in kinds or r["block"] is None:
                        yield from _rows([tuple(r.values())]).to_batches()
                        continue
                    if held and ((r["kind"], r["shard"]) != of or size >= TASK_TOKENS):
                        yield from told().to_batches()
                        held, size = [], 0
                    of = (r["kind"], r["shard"])
                    held.append(unpack(r["block"], *_shape(r["kind"], deal.order)))
                    size += len(held[-1][1][0])
            if held:
                yield from told().to_batches()

        rows = rows.repartition("kind", "shard").sortWithinPartitions("kind", "shard").mapInArrow(scan, ROWS)
    return rows


def reduced(rows: DataFrame, folder: str, deal: Dealing, level: int) -> DataFrame:
    """Each shard of the level's blocks added up and written; what follows and what is told of files comes out, other rows pass."""
    order = deal.order

    def name(kind: str, shard: int) -> str:
        return f"{folder}/{kind}-{shard:07d}-{level}"

    def contexts_of(ids: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        return summed(gram_keys(ids[:-1]), ids[:-1], [n, *((x).astype(np.uint64) for x in (n == 1, n == 2, n > 2))])

    def keep(kind: str, shard: int, keys: np.ndarray, counts: list[np.ndarray]) -> list[tuple]:
        """Write a file; what is to be told of it."""
        n = counts[0]
        if not len(keys):
            return []
        if kind == "gram1":
            counts = [n, counts[-1]]
        save(name(kind, shard), keys, np.stack(counts if kind == "gram1" or kind.startswith("from") else counts[:1], axis=1), usual(kind))
        if kind.startswith("from"):
            return []
        return [(kind, shard, None, len(keys), int(n.sum()), int(counts[-1].sum()), *(int((n == k).sum()) for k in (1, 2, 3, 4)))]

    def shorter(ids: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """The tails: each counted once for each n-gram (those at the start of a text as often as these), and as often as in the texts."""
        n = counts[0]
        once = np.where(ids[1] == START, n, np.uint64(1)) if len(ids) > 2 else np.ones(len(n), np.uint64)
        return summed(gram_keys(ids[1:]), ids[1:], [once, counts[-1]])

    def passed(ids: list[np.ndarray], counts: list[np.ndarray]) -> list[tuple]:
        return _blocks(f"gram{len(ids)}", _coarse(deal.grams(ids), deal.bits, 1), ids, counts)

    def shard(key, t):
        kind, of = key[0].as_py(), key[1].as_py()
        if kind not in (f"gram{level}", f"from{level + 1}"):
            return t
        blocks = [b for b in t.column("block").to_pylist() if b is not None]
        out = _rows([tuple(r.values()) for r in t.to_pylist() if r["block"] is None])
        if not blocks:
            return out
        parts = [unpack(b, *_shape(kind, order)) for b in blocks]
        ids = [np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True)]
        counts = [np.concatenate(c) for c in zip(*(p[1] for p in parts), strict=True)]
        del blocks, parts
        keys, ids, counts = summed(gram_keys(ids), ids, counts)
        rows = keep(kind, of, keys, counts)
        if kind.startswith("gram") and level > 1:
            heads = contexts_of(ids, counts[0])
            if deal.paired(level):
                rows += keep(f"from{level}", of, heads[0], heads[2])
                split = deal.is_hot(ids[1:-1])
                some = lambda m: ([c[m] for c in ids], [c[m] for c in counts])
                if split.any():
                    rows += passed(*shorter(*some(split))[1:])
                keys, ids, counts = shorter(*some(~split))
                rows += keep(f"gram{level - 1}", of, keys, counts)
                heads = contexts_of(ids, counts[0])
                rows += keep(f"from{level - 1}", of, heads[0], heads[2])
            else:
                split = deal.is_hot(heads[1])
                rows += keep(f"from{level}", of, heads[0][~split], [c[~split] for c in heads[2]])
                part = [c[split] for c in heads[1]]
                rows += _blocks(f"from{level}", _coarse(deal.contexts(part), deal.bits, 1), part, [c[split] for c in heads[2]])
            rows += passed(*shorter(ids, counts)[1:])
        return pa.concat_tables([out, _rows(rows)])

    return dealt_on(rows, deal, level).groupBy("kind", "shard").applyInArrow(shard, ROWS)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ of the counts of counts n1..n4; where those are too few to tell, 0.5, 1 and 1.5."""
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return tuple(x if 0 < x < k else k / 2 for k, x in enumerate(d, 1))


@dataclass
class Model:
    """Where the arrays are, and the few numbers that belong to all of them."""

    order: int
    folder: str
    deal: Dealing
    discount: dict[int, tuple[float, float, float]]
    total: int
    words: int
    raw: int
    base: tuple[int, int, int]
    _open: OrderedDict = field(default_factory=OrderedDict)

    def __getstate__(self):
        return self.__dict__ | {"_open": OrderedDict()}

    def _arrays(self, kind: str, shard: int) -> list[Arrays]:
        """The files of a shard: mapped where the shared folder is a file system of this machine, else read, and held up to HELD_BYTES."""
        from pyarrow import fs

        if (kind, shard) not in self._open:
            out = []
            for level in range(int(kind[4:]) - kind.startswith("from"), self.order + 1):
                store, inner = open_store(f"{self.folder}/{kind}-{shard:07d}-{level}")
                if store.get_file_info(inner).type == fs.FileType.File:
                    if store.type_name == "local":
                        data = np.memmap(inner, np.uint8, "r")
                    else:
                        with store.open_input_file(inner) as f:
                            data = np.frombuffer(f.read(), np.uint8)
                    while self._open and sum(a.bytes for x in self._open.values() for a in x) + len(data) > HELD_BYTES:
                        self._open.popitem(last=False)
                    out.append(Arrays(data, usual(kind)))
            self._open[kind, shard] = out
        self._open.move_to_end((kind, shard))
        return self._open[kind, shard]

    def find(self, kind: str, ids: list[np.ndarray]) -> np.ndarray:
        """(rows, values) of the n-grams or contexts; zeros where they are not known."""
        shard, key = (self.deal.contexts(ids) if kind.startswith("from") else self.deal.grams(ids)), gram_keys(ids)
        bits = np.uint64(self.deal.bits)
        by = np.argsort((shard.astype(np.uint64) << (np.uint64(64) - bits) | key >> bits) if bits else key)  # by shard, then key (but for its last bits)
        key, shard = key[by], shard[by]
        new = np.r_[True, (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])] if len(key) else np.empty(0, bool)
        back = np.empty(len(by), np.int64)
        back[by] = np.cumsum(new) - 1
        key, shard = key[new], shard[new]
        want = np.zeros((len(key), len(usual(kind))))
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(key) else [0]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            for arrays in self._arrays(kind, int(shard[a])):
                arrays.find(key[a:z], want[a:z])
        return want[back]

    def _cut(self, n: np.ndarray, level: int) -> np.ndarray:
        d = (0.0, *self.discount[level])
        return np.maximum(n - np.take(d, np.minimum(n, 3).astype(np.int64)), 0)

    def score(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability, known tokens, base score) of each text."""
        columns = windows(ids, self.order)
        c1, raw = self.find("gram1", columns[-1:]).T
        d, (n1, n2, more) = self.discount[1], self.base
        uniform = 1.0 / (self.words + 1)
        left = (d[0] * n1 + d[1] * n2 + d[2] * more) / self.total if self.total else 1.0
        p = self._cut(c1, 1) / max(self.total, 1) + left * uniform
        for level in range(2, self.order + 1):
            grams = columns[-level:]
            n = self.find(f"gram{level}", grams)[:, 0]
            heads = self.find(f"from{level}", grams[:-1])
            seen = heads[:, 0] > 0
            total = np.where(seen, heads[:, 0], 1)
            left = np.where(seen, heads[:, 1:] @ np.array(self.discount[level]) / total, 1.0)
            p = np.where(seen, self._cut(n, level) / total, 0) + left * p
        base = np.log10((raw + 0.5) / (self.raw + 0.5 * (self.words + 1)))
        sizes = np.array([len(t) for t in ids])
        at = np.cumsum(sizes) - sizes
        return np.add.reduceat(np.log10(p), at), np.add.reduceat((raw > 0).astype(np.int64), at), np.add.reduceat(base, at)


def fit(docs: DataFrame, order: int = ORDER, shards: int | None = None) -> Model:
    """The model of all rows of docs(text, ...). A null text is empty: its end is counted. No rows: every word has probability 1."""
    folder = f"{Scratch(docs.sparkSession, 'kneserney').folder}/arrays"
    texts = docs.select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(shards or max(docs.sparkSession.sparkContext.defaultParallelism, size / SHARD_BYTES))))
    # A task takes at least as much text as a block counts, so that blocks are few and full.
    texts = texts.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, size // (6 * TASK_TOKENS)))
    places, tokens_ = pivot_counts(texts, order)
    deal = Dealing(order, bits, {n: x > max(1, tokens_ >> bits) // SPLIT for n, x in places.items()})
    rows = counted(texts, deal)
    for level in range(order, 0, -1):
        rows = reduced(rows, folder, deal, level)
    told = {r["kind"]: r for r in rows.filter("n IS NOT NULL").groupBy("kind").agg(*(F.sum(c).alias(c) for c in COUNTS)).collect()}  # a row for each level
    sums = {k: [told[f"gram{k}"][c] if f"gram{k}" in told else 0 for c in ("n1", "n2", "n3", "n4", "total", "n", "raw")] for k in range(1, order + 1)}
    n1, n2, _, _, total, words, raw = sums[1]
    return Model(order, folder, deal, {k: discounts(v[:4]) for k, v in sums.items()}, total, words, raw, (n1, n2, words - n1 - n2))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row of docs(text, ...) with n_tokens, n_known, train_tokens, base_score and score added (clashing ones are replaced).

    A null or empty text is its end alone; repeated rows score alike; an empty table gives an empty result; a text of any
    length is one block of look-ups.
    """
    from pyspark.sql.types import StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = [c for c in keep if c not in added]
    (held_text,) = own_names(keep, "_text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out: list[tuple] = []
            held: list[np.ndarray] = []

            def told() -> None:
                if held:  # noqa: B023
                    s, known, base = m.score(held)  # noqa: B023
                    out.extend(zip([len(t) for t in held], known.tolist(), base.tolist(), s.tolist(), strict=True))  # noqa: B023
                    held.clear()  # noqa: B023

            size = 0
            for text in b.column(held_text).to_pylist():
                held.append(tokens(text))
                size += len(held[-1])
                if size >= SCORE_TOKENS:
                    told()
                    size = 0
            told()
            n, known, base, s = zip(*out, strict=True) if out else ((), (), (), ())
            columns = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([m.raw] * len(n), pa.int64()), pa.array(base, pa.float64()), pa.array(s, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *columns], [*keep, *added])

    rows = docs.select(*keep, F.col("text").cast("string").alias(held_text))
    schema = StructType([f for f in rows.schema.fields if f.name != held_text])
    for c in added:
        schema = schema.add(c, "double" if "score" in c else "long")
    return rows.mapInArrow(scan, schema)
