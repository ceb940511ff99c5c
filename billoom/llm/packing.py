"""Packing documents into fixed-length sequences by patterns of non-negative least squares.

The driver sees only the histogram of piece lengths (at most ``capacity`` numbers). Lengths fall in the cells of a
grid; all patterns of up to ``depth`` cells that fill a sequence are enumerated, so a cell stands in many of them; non-negative
least squares fits how often each is repeated to the histogram. Repeats are rounded down, and as many sequences
of each pattern are made as pieces can fill to the token, all parts but the last from their cells. What is left goes best-fit-decreasing,
whole runs of equal lengths at a time, into the gaps and then into new sequences. Best fit alone packs the same histogram
for comparison: should that need fewer sequences, another grid or a smaller part of the repeats is taken, so patterns never cost any. The plan
is a list of slots for each length (their number depends on the capacity, not on the corpus); a piece finds its slot by
its rank among the pieces of its length, which two-level counting gives without bringing a length's pieces together.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, default_partitions, few_rows, own_names
from .wordcodes import BLOCK_CHARACTERS, coder, in_blocks

CAPACITY = 4096
END_ID = 1
#: Fits that are tried in turn: cells of the histogram, and the most documents of a pattern.
FITS = ((64, 4), (16, 4), (64, 3))
#: Patterns have no part under a sixteenth of the capacity: short pieces are kept for the gaps.
SHORTEST = 16
#: Parts of the fitted repeats that are tried, until the whole packing needs no more sequences than best fit alone.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by active sets."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    slack = a.T @ b
    eps = 1e-9 * max(1.0, float(np.abs(slack).max(initial=0)))
    for _ in range(rounds):
        free = np.where(active, -np.inf, slack)
        if not n or free.max() <= eps:
            break
        active[int(free.argmax())] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            low = s <= 0
            if not low.any():
                break
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                s, at = np.empty(0), np.empty(0, np.int64)
                break
        x[:] = 0
        x[at] = s
        slack = a.T @ (b - a @ x)
    return x


def patterns(total: int, depth: int) -> list[tuple[int, ...]]:
    """All descending tuples of up to depth positive numbers whose sum is total."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < depth:
            for k in range(min(left, most), 0, -1):
                if k * (depth - len(head)) < left:
                    break
                grow((*head, k), left - k, k)

    grow((), total, total)
    return out


Class = tuple[list[tuple[int, int]], int]
"""A number of sequences alike: [(length, times), ...] and how many there are."""


def fit_patterns(hist: np.ndarray, capacity: int, grid: int, depth: int) -> tuple[list[tuple[int, ...]], np.ndarray, int]:
    """(patterns as cells, how often each is repeated, lengths in a cell): the non-negative least squares fit to the histogram."""
    step = -(-capacity // grid)
    cells = -(-capacity // step)
    target = np.zeros(cells + 1)
    np.add.at(target, [-(-k // step) for k in range(1, capacity + 1)], hist[1 : capacity + 1])
    kinds = [p for p in patterns(capacity // step, depth) if min(p) * SHORTEST * step >= capacity and all(target[k] for k in p)]
    a = np.zeros((cells + 1, len(kinds)))
    for k, p in enumerate(kinds):
        np.add.at(a[:, k], list(p), 1)
    return kinds, nnls(a, target), step


def fill(hist: np.ndarray, capacity: int, kinds: list[tuple[int, ...]], repeats: np.ndarray, step: int) -> list[Class]:
    """Sequences of the patterns, as often as repeats (rounded down) say and pieces allow; takes what they hold out of hist."""
    repeats = np.floor(repeats + 1e-9).astype(np.int64)
    out: list[Class] = []

    def filled(cells_: tuple[int, ...]) -> dict[int, int] | None:
        """Lengths of pieces that are left, one from each cell but the last, and one more, that fill a sequence to the token."""
        used: dict[int, int] = {}
        has = lambda n: hist[n] > used.get(n, 0)
        for c in cells_[:-2]:
            n = next((n for n in range(min(capacity, c * step), (c - 1) * step, -1) if has(n)), None)
            if n is None:
                return None
            used[n] = used.get(n, 0) + 1
        room = capacity - sum(n * t for n, t in used.items())
        if len(cells_) == 1:
            return {room: 1} if has(room) else None
        for n in range(min(room - 1, cells_[-2] * step), (cells_[-2] - 1) * step, -1):
            rest = room - n
            if has(n) and hist[rest] > used.get(rest, 0) + (rest == n):
                for k in (n, rest):
                    used[k] = used.get(k, 0) + 1
                return used
        return None

    for k in np.argsort(-repeats, kind="stable"):
        left = int(repeats[k])
        while left > 0 and (now := filled(kinds[k])):
            times = min(left, *(int(hist[n]) // t for n, t in now.items()))
            for n, t in now.items():
                hist[n] -= times * t
            out.append((list(now.items()), times))
            left -= times
    return out


def plan(hist: np.ndarray, capacity: int = CAPACITY, fits: tuple[tuple[int, int], ...] = FITS) -> list[Class]:
    """Sequences for a histogram (hist[n] pieces of length n, 1 <= n <= capacity): as many of the fitted patterns as cost nothing against best fit alone."""
    hist = np.asarray(hist, np.int64)
    full = [([(capacity, 1)], int(hist[capacity]))] if hist[capacity] else []
    rest = hist.copy()
    rest[capacity] = 0
    count = lambda classes: sum(c for _, c in classes)
    alone = _best_fit(rest.copy(), capacity, [])
    fitted = [fit_patterns(rest, capacity, grid, depth) for grid, depth in fits]
    for share in SHARES:
        for kinds, repeats, step in fitted:
            left = rest.copy()
            both = _best_fit(left, capacity, fill(left, capacity, kinds, share * repeats, step))
            if count(both) <= count(alone):
                return full + both
    return full + alone


def _best_fit(hist: np.ndarray, capacity: int, begun: list[Class]) -> list[Class]:
    """The sequences begun, with all of hist put into their gaps or new ones, best-fit-decreasing."""
    out: list[Class] = []
    room: dict[int, list[Class]] = {}
    spaces: list[int] = []

    def put(c: Class) -> None:
        if c[1]:
            space = capacity - sum(n * t for n, t in c[0])
            if space:
                if space not in room:
                    bisect.insort(spaces, space)
                    room[space] = []
                room[space].append(c)
            else:
                out.append(c)

    for c in begun:
        put(c)
    for n in range(capacity, 0, -1):
        left = int(hist[n])
        while left:
            at = bisect.bisect_left(spaces, n)
            if at < len(spaces):
                space = spaces[at]
                items, count = room[space].pop()
                if not room[space]:
                    del room[space]
                    spaces.pop(at)
            else:
                space, items, count = capacity, [], left
            each = space // n
            whole = min(count, left // each)
            rest = left - whole * each if whole < count else 0
            put(([*items, (n, each)], whole))
            if rest:
                put(([*items, (n, rest)], 1))
            if items:
                put((items, count - whole - bool(rest)))
            left -= whole * each + rest
    return out + [c for s in spaces for c in room[s]]


def slots(classes: list[Class]) -> dict[str, np.ndarray]:
    """For each length, in order: the ranks from which a run of slots begins, its first sequence, place and times."""
    rows, ranks, base = [], {}, 0
    for items, count in classes:
        offset = 0
        for n, times in items:
            first = ranks.get(n, 0)
            rows.append((n, first, base, offset, times))
            ranks[n] = first + count * times
            offset += n * times
        base += count
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 5)
    return {"length": a[:, 0], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3], "times": a[:, 4]}


def place(table: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence_id, offset) of the piece of this rank among the pieces of this length."""
    key = table["length"] << 44 | table["rank"]
    at = np.searchsorted(key, length << 44 | rank, side="right") - 1
    over = rank - table["rank"][at]
    return table["sequence"][at] + over // table["times"][at], table["offset"][at] + over % table["times"][at] * length


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids binary]): each row's ids and end_id, cut only where longer than capacity.

    Null and empty texts are the end id alone; repeated rows are pieces of their own; other columns are ignored.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    end = np.array([end_id], "<u4").tobytes()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(vocabulary, "word")
        for b in few_rows(batches):
            docs, texts = b.column("doc_id"), b.column("text").to_pylist()
            for at, block in in_blocks(texts, BLOCK_CHARACTERS):
                row, piece, start, size, crc, held = [], [], [], [], [], []
                for k, ids in enumerate(code.ids(block)):
                    ids += end
                    for j, s in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[s : s + 4 * capacity]
                        row.append(at + k)
                        piece.append(j)
                        start.append(s // 4)
                        size.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            held.append(part)
                columns = [docs.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(held, pa.binary())] * with_ids, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, schema)


def pack(parts: DataFrame, capacity: int = CAPACITY, fits: tuple[tuple[int, int], ...] = FITS, tie: str | None = None) -> DataFrame:
    """All rows of parts(doc_id, piece, length, ...) with sequence_id long and offset long added (replaced if there); other columns stay whatever their names.

    parts must be stable when read twice (a table). Lengths run from 1 to capacity. tie: a column that numbers the rows, which deals rows of one
    id (or without one) to all tasks. Rows that repeat an id and piece are pieces of their own. An empty table gives an empty result.
    """
    parts = parts.drop("sequence_id", "offset")
    buckets = 4 * default_partitions(parts.sparkSession)
    bucket, rank, first_rank, many = own_names(parts.columns, "_bucket", "_rank", "_first", "_n")
    keep, ties = parts.columns, [tie] if tie else []
    parts = parts.withColumn(bucket, F.pmod(F.xxhash64(*(ties or ["doc_id", "piece"])), F.lit(buckets)))
    counts = Scratch(parts.sparkSession, "packing").keep(parts.groupBy(bucket, "length").agg(F.count("*").alias(many)), "counts")
    hist = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum(many).alias("n")).collect():  # at most capacity rows
        if not 1 <= r["length"] <= capacity:
            raise ValueError(f"a piece of {r['length']} tokens; the capacity is {capacity}")
        hist[r["length"]] = r["n"]
    table = slots(plan(hist, capacity, fits))
    before = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(bucket, "length", F.coalesce(F.sum(many).over(before), F.lit(0)).alias(first_rank))
    within = F.row_number().over(Window.partitionBy(bucket, "length").orderBy("doc_id", "piece", *ties)) - 1
    ranked = parts.withColumn(rank, within).join(first, [bucket, "length"]).withColumn(rank, F.col(rank) + F.col(first_rank)).select(*keep, rank)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where = place(table, b.column("length").to_numpy(), b.column(rank).to_numpy()) if b.num_rows else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(x) for x in where], [*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(scan, StructType(ranked.select(*keep).schema.fields[:]).add("sequence_id", "long").add("offset", "long"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """pieces() of docs, written once, and their places."""
    rows = pieces(docs, vocabulary, capacity, with_ids=with_ids).withColumn("_row", F.monotonically_increasing_id())
    return pack(Scratch(docs.sparkSession, "pieces").keep(rows, "pieces"), capacity, tie="_row").drop("_row")


def lower_bound(lengths: list[int], capacity: int = CAPACITY) -> int:
    """No packing has fewer sequences than this."""
    return -(-sum(lengths) // capacity)
