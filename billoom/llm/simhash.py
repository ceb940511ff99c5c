"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits; two documents link when at most 3 bits differ. The fingerprint is cut into
two 32-bit segments, so linked fingerprints agree within one bit in one segment (1 + 1 + 2 > 3). Every
distinct fingerprint posts itself in the table of each segment under its own value and probes the values
one bit away; of two values one bit apart only the one lacking the bit probes, which halves the probes.
Each bucket is searched for links by complete distance, but only a spanning forest of the links leaves
it: what follows has as many rows as a bucket has fingerprints, never all its pairs.

Copies have one fingerprint and are one node. A bucket with over ``hot_bucket`` different fingerprints is
dealt again by 16-bit halves of the other segment (again within one bit), so no bucket holds more than a
fixed number of them, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, MapType, StructField, StructType, VariantType

from .common import Scratch, boxed

SEED = 42
MAX_BITS = 3
SHINGLE_WORDS = 3
HOT_BUCKET = 4096
BROADCAST_KEYS = 100_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose bits are counted at a time, which bounds memory for very long texts.
BLOCK = 1 << 16
#: Texts taken from a batch at a time, and fingerprints posted at a time.
TEXTS, POSTED = 250, 2000


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash. No words (null, empty, white space): 0."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return 0
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(line, SEED)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1).tolist()
    ends = ends[words - 1 :].tolist()
    n, ones = len(ends), np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        got = [digest(line[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=False)]
        bits = np.unpackbits(np.array(got, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp long, *keep) of every row; fp is the unsigned fingerprint read as a signed long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
            fps = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps), *(b.column(c) for c in keep)], ["doc_id", "fp", *keep])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    return rows.mapInArrow(scan, StructType([StructField("doc_id", LongType()), StructField("fp", LongType()), *(rows.schema[c] for c in keep)]))


def _flips(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of each value itself, then of each with one zero bit set."""
    grid = values[:, None] | (np.int64(1) << np.arange(bits, dtype=np.int64))
    row, col = np.nonzero(grid != values[:, None])
    return np.concatenate([np.arange(len(values)), row]), np.concatenate([values, grid[row, col]])


def _batch(key: np.ndarray, fp: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(own)], ["key", "fp", "own"])


def _segment(fp: np.ndarray, k: int) -> np.ndarray:
    return (fp.view(np.uint64) >> np.uint64(32 * k)).astype(np.int64) & 0xFFFFFFFF


def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Table entries (own) and probes of each fingerprint in both segments."""
    for b in batches:
        whole = b.column("fp").to_numpy()
        for at in range(0, len(whole), POSTED):
            fp = whole[at : at + POSTED]
            for k in (0, 1):
                row, value = _flips(_segment(fp, k), 32)
                yield _batch(np.int64(k << 32) | value, fp[row], np.arange(len(row)) < len(fp))


def post_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of what stands in a hot bucket: entries and probes by halves of the other segment, within that bucket."""
    for b in batches:
        keys, whole = b.column("key").to_numpy(), b.column("fp").to_numpy()
        for at in range(0, len(whole), POSTED):
            key, fp = keys[at : at + POSTED], whole[at : at + POSTED]
            other = np.where(key >> 32 == 0, _segment(fp, 1), _segment(fp, 0))
            for q in (0, 1):
                row, value = _flips(other >> (16 * q) & 0xFFFF, 16)
                yield _batch(np.int64(1) << 62 | key[row] << 17 | np.int64(q << 16) | value, fp[row], np.arange(len(row)) < len(fp))


def spanning_links(fps: np.ndarray, bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the graph that links fingerprints at most ``bits`` apart: exact, at most len - 1 pairs."""
    unseen, front, out = np.unique(fps), [], []
    while unseen.size:
        if not front:
            front, unseen = [unseen[0]], unseen[1:]
        at = front.pop()
        near = np.bitwise_count((unseen ^ at).view(np.uint64)) <= bits
        if near.any():
            found = unseen[near]
            out += [(int(at), int(x)) for x in found]
            front += list(found)
            unseen = unseen[~near]
    return out


def search_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of one key. The rows come sorted by key; a run may span batches."""
    keys, fps, own = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def runs(keys, fps, own):
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        ends = np.r_[first[1:], len(keys)]
        took = np.add.reduceat(own.astype(np.int64), first) if len(first) else first
        links: list[tuple[int, int]] = []
        for k in np.flatnonzero((ends - first > 1) & (took > 0)):
            links += spanning_links(fps[first[k] : ends[k]])
        a = np.array(links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

    for b in batches:
        keys, fps, own = (np.concatenate([x, b.column(n).to_numpy(zero_copy_only=False)]) for x, n in ((keys, "key"), (fps, "fp"), (own, "own")))
        if len(keys):
            last = int(np.searchsorted(keys, keys[-1]))
            yield runs(keys[:last], fps[:last], own[:last])
            keys, fps, own = keys[last:], fps[last:], own[last:]
    yield runs(keys, fps, own)


def links(nodes: DataFrame, scratch: Scratch, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(a, b): verified links whose components are those of all links between the distinct fingerprints ``nodes.fp``."""
    schema = "key long, fp long, own boolean"
    tables = nodes.select(F.explode(F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32)))).alias("key"))
    hot = scratch.keep(tables.groupBy("key").count().filter(F.col("count") > hot_bucket).select("key"), "hot")
    posts, n_hot = nodes.select("fp").mapInArrow(post, schema), hot.count()
    if n_hot:
        side = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
        # Written first: one Python worker a task at a time.
        again = scratch.keep(posts.join(side, "key", "left_semi").select("key", "fp"), "hot-posts").mapInArrow(post_again, schema)
        posts = posts.join(side, "key", "left_anti").unionByName(again)
    return posts.repartition("key").sortWithinPartitions("key").mapInArrow(search_buckets, "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): connected components by alternating large-star and small-star, root the least node.

    All steps are grouped minima and joins; each round is written, so a lost executor costs one round.
    """
    edge = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now, before = scratch.keep(edge(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges"), None
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    was = sign(now)
    while was[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = scratch.keep(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, now = now, scratch.keep(small.filter("u <> v").distinct(), "edges")
        scratch.drop(before, large)
        if (sum_ := sign(now)) == was:
            break
        was = sum_
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _grouped(docs: DataFrame, words: int, hot_bucket: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, *keep, root, component_id) of every row; root is the component's least fingerprint."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, words, keep), "fingerprints")
    nodes = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes, scratch, hot_bucket), scratch)
    linked = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of = linked.join(first, "root").select("fp", "root", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", *keep, "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs(doc_id, text, ...); other columns (also of these names) are ignored.

    component_id is the smallest doc_id reachable over links. A null text counts as empty (fingerprint 0,
    linked like any other); a null doc_id is never a component_id unless all ids reached are null;
    repeated rows are kept, each with the same component; rows of one id and different texts may be in different
    components; an empty table gives an empty result.
    """
    return _grouped(docs, words, hot_bucket).select("doc_id", "fp", "component_id")


def _has_map(kind: DataType) -> bool:
    inner = [f.dataType for f in kind.fields] if isinstance(kind, StructType) else [kind.elementType] if isinstance(kind, ArrayType) else []
    return isinstance(kind, (MapType, VariantType)) or any(map(_has_map, inner))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each component one row of docs, all columns: that with the smallest doc_id (null after all), then the least hash of the row.

    So rows that repeat an id with different texts each count for themselves. Rows equal in all columns that can be compared (not
    maps and variants, nor what holds them) are one. Columns may have any names.
    """
    row = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if not _has_map(f.dataType)])
    marked = docs.select(boxed(docs).alias("_doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row.alias("_row"))
    found = _grouped(marked, SHINGLE_WORDS, HOT_BUCKET, ("_row",)).groupBy("root", "doc_id", "_row").agg(F.count("*").alias("n"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row", "n")).alias("s"))
    stays = first.select(F.col("s.doc_id").alias("_id"), F.col("s._row").alias("_stays"), F.col("s.n").alias("_times"))
    stays = Scratch(docs.sparkSession, "simhash-stays").keep(stays, "stays")
    # Survivors grow with the input: a merge join at every size, no broadcast that only holds on small inputs.
    kept = marked.select("_doc", "doc_id", "_row").join(stays.hint("merge"), F.col("_row") == F.col("_stays")).filter(F.col("doc_id").eqNullSafe(F.col("_id")))
    once = kept.filter("_times = 1").select("_doc.*")
    if stays.filter("_times > 1").limit(1).count():
        once = once.unionByName(kept.filter("_times > 1").dropDuplicates(["_row", "_id"]).select("_doc.*"))
    return once
