"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots, the first PREFIX of PIVOTS. Shards of the vectors hold an
inverted file for each pivot: the vectors that have it among their nearest, with its place in their order. A query adds up,
over its own pivots' files, how far each vector's places lie from its own (Spearman's footrule; a pivot that is absent
counts as just beyond the last place), takes the vectors with the least sums (all that tie with the last one
too), and ranks those by exact Euclidean distance in double precision. Of n vectors in a shard SPREAD * n ** POWER are
ranked so, at every size alike: on the test tables the true neighbours lie among about n ** 0.75.

A query reads PREFIX ** 2 / PIVOTS postings a vector and compares a few vectors in a hundred whole, against all components of all
vectors in a scan.

Equal vectors are one entry that keeps as many of its smallest ids as an answer can use, so a vector that a third of
all rows share costs nothing. Pivots are different vectors, the first by hash; every row is indexed. Shards and blocks of
queries are files in the shared folder; the driver sees the pivots alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, load_arrays, save_arrays, search_pairs

PIVOTS = 512
PREFIX = 64
SPREAD, POWER = 1.25, 0.75
SHARD_VECTORS = 1 << 15
#: Queries that are searched one after the other on a shard.
QUERY_BLOCK = 128


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Of each vector the numbers of its nearest pivots, nearest first (ties: the first pivot)."""
    d = (pivots**2).sum(axis=1) - 2 * x @ pivots.T
    return np.argsort(d, axis=1, kind="stable")[:, :prefix].astype(np.int32)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id long, vec binary of doubles): rows without null, zero, null components or non-finite ones."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vecs = [], []
            for k, v in zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist(), strict=True):
                if k is not None and v and None not in v:
                    x = np.array(v, "<f8") + 0.0
                    if np.isfinite(x).all() and x.any():
                        ids.append(k)
                        vecs.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary())], ["vec_id", "vec"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).mapInArrow(scan, "vec_id long, vec binary")


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(vec, ids array<long>): each different vector with its ``keep`` smallest ids; cut in each task before the shuffle."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def told() -> pa.RecordBatch:
            pairs = [(v, k) for v, ks in held.items() for k in sorted(set(ks))[:keep]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[1] for p in pairs], pa.int64()), pa.array([p[0] for p in pairs], pa.binary())], ["vec_id", "vec"])

        for b in batches:
            for k, v in zip(b.column("vec_id").to_pylist(), b.column("vec").to_pylist(), strict=True):
                ks = held.setdefault(v, [])
                ks.append(k)
                if len(ks) > 4 * keep:
                    ks[:] = sorted(set(ks))[:keep]
            if len(held) > 100_000:
                yield told()
        yield told()

    few = rows.mapInArrow(first, "vec_id long, vec binary").distinct()
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).filter(F.col("r") <= keep)
    return ranked.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


class Shard:
    """Inverted files of one shard: for each pivot its vectors and places; the vectors and their ids beside them."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, starts: np.ndarray, posts: np.ndarray, places: np.ndarray, at: np.ndarray, prefix: int):
        self.x, self.ids, self.starts, self.posts, self.places, self.at, self.prefix = x, ids, starts, posts, places, at, prefix

    @classmethod
    def build(cls, vecs: list[bytes], ids: list[list[int]], pivots: np.ndarray, prefix: int) -> Shard:
        x = np.frombuffer(b"".join(vecs), "<f8").reshape(len(vecs), -1)
        order = orders(x, pivots, prefix)
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        at = np.searchsorted(flat[by], np.arange(len(pivots) + 1))
        starts = np.cumsum([0, *map(len, ids)])
        return cls(x, np.concatenate([np.array(i, np.int64) for i in ids]), starts, (by // order.shape[1]).astype(np.int32), (by % order.shape[1]).astype(np.int16), at, prefix)

    def search(self, q: np.ndarray, order: np.ndarray, k: int, spread: float, power: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest found, ties to the smaller id."""
        n, most = len(self.x), len(order)
        # The footrule of two prefixes is most * (most + 1), less twice (most - the larger of both places) for each pivot that they share.
        score = np.full(n, most * (most + 1), np.int32)
        for place, p in enumerate(order.tolist()):
            files = slice(self.at[p], self.at[p + 1])
            score[self.posts[files]] += 2 * (np.maximum(self.places[files], np.int16(place)).astype(np.int32) - most)
        want = min(n, max(k, math.ceil(spread * n**power)))
        near = np.flatnonzero(score <= np.partition(score, want - 1)[want - 1])
        d = _distances(self.x[near], q)
        if len(near) > k:
            close = d <= np.partition(d, k - 1)[k - 1]
            near, d = near[close], d[close]
        sizes = self.starts[near + 1] - self.starts[near]
        ids = np.concatenate([self.ids[a:b] for a, b in zip(self.starts[near], self.starts[near + 1], strict=True)])
        d = np.repeat(d, sizes)
        best = np.lexsort((ids, d))[:k]
        return ids[best], d[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = PIVOTS, prefix: int = PREFIX, spread: float = SPREAD, power: float = POWER, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query row (vec_id, embedding) the k nearest of vectors (vec_id, embedding) found.

    A query's own id is no candidate. Vectors null, empty, zero, or with null or non-finite components take no part, nor
    do those of another dimension than most, nor null ids. Equal distances go to the smaller id. Rows that repeat an
    id and vector count once; an id on several vectors is a candidate with each of them, so it can come more than once in an answer, and a query
    id on several vectors has one answer, the k nearest to any of them. Fewer candidates than k: all of them; none, or an empty table: no row. Other columns are ignored.
    """
    spark, scratch, take = vectors.sparkSession, Scratch(vectors.sparkSession, "permutation"), k + 1
    entries = scratch.keep(distinct_vectors(usable(vectors), take), "vectors")
    size = entries.groupBy(F.octet_length("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    schema = "query_id long, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    entries = entries.filter(F.octet_length("vec") == size["size"])
    chosen = [r["vec"] for r in entries.orderBy(F.xxhash64("vec"), "vec").limit(pivots).select("vec").collect()]
    pivot = np.frombuffer(b"".join(chosen), "<f8").reshape(len(chosen), -1)
    prefix, shards, folder = min(prefix, len(pivot)), -(-size["count"] // shard_vectors), scratch.path("files")

    def build(key, t):
        s = Shard.build(t.column("vec").to_pylist(), t.column("ids").to_pylist(), pivot, prefix)
        path = f"{folder}/shard-{key[0].as_py()}.npz"
        save_arrays(path, x=s.x, ids=s.ids, starts=s.starts, posts=s.posts, places=s.places, at=s.at)
        return pa.table({"path": [path]})

    def ask(key, t):
        path = f"{folder}/queries-{key[0].as_py()}.npz"
        save_arrays(path, ids=t.column("vec_id").to_numpy(), x=np.frombuffer(b"".join(t.column("vec").to_pylist()), "<f8").reshape(t.num_rows, -1))
        return pa.table({"path": [path]})

    dealt = entries.withColumn("_shard", F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(shards))).groupBy("_shard")
    index = scratch.keep(dealt.applyInArrow(build, "path string"), "index")
    asked = scratch.keep(usable(queries).filter(F.octet_length("vec") == size["size"]).distinct(), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)))
    written = {int(r["path"].rpartition("-")[2].removesuffix(".npz")) for r in scratch.keep(asked.groupBy("_block").applyInArrow(ask, "path string"), "blocks").collect()}  # a row for each block

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        for b in batches:
            for path, block in zip(b.column("path").to_pylist(), b.column("block").to_pylist(), strict=True):
                if block in written:
                    if path != now:
                        f = load_arrays(path)
                        now, shard = path, Shard(f["x"], f["ids"], f["starts"], f["posts"], f["places"], f["at"], prefix)
                    f = load_arrays(f"{folder}/queries-{block}.npz")
                    of, (q, back) = f["ids"], np.unique(f["x"], axis=0, return_inverse=True)
                    best = [shard.search(v, o, take, spread, power) for v, o in zip(q, orders(q, pivot, prefix), strict=True)]
                    mine = [(a[a != i][:k], d[a != i][:k]) for i, (a, d) in ((i, best[j]) for i, j in zip(of.tolist(), back.ravel().tolist(), strict=True))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(of, [len(m[0]) for m in mine])), pa.array(np.concatenate([m[0] for m in mine])), pa.array(np.concatenate([m[1] for m in mine]))], ["query_id", "vec_id", "score"])

    near = search_pairs(index, blocks).mapInArrow(scan, schema)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return scratch.keep(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "found")
