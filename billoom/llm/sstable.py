"""Sorted-string-table shards of token ids, keyed by document.

A shard is one file: data blocks, a block index, a Bloom filter, a footer.

* key: doc_id + 2**63 as eight big-endian bytes, so byte order is numeric order; a null doc_id is the empty key, which is first.
* data block: entries (varints: bytes shared with the key before, further key bytes, value bytes; then those
  bytes), every 16th with its whole key; then the places of those (u32 each) and their number (u32). The
  block is compressed with zstd and followed by the CRC-32 of what is stored.
* value: the document's ids, little-endian unsigned 32-bit integers.
* index: for each block its last key, offset, size, entries and ids before it in the shard.
* footer: offsets and sizes of index and filter, entries, ids, magic.

A look-up asks the filter, then searches the index and the block's whole keys by halving. Shards are ranges of
doc_id in ascending order.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, default_partitions, few_rows, open_store, write_whole
from .wordcodes import BLOCK_CHARACTERS, coder, in_blocks

MAGIC = b"BLSST001"
FOOTER = struct.Struct("<QQQQQQ8s")
INDEX = struct.Struct("<QIIQB")
RESTART = 16
BLOCK_BYTES = 64 << 10
BITS_PER_KEY = 10
PROBES = 7
END_ID = 2
#: Bytes of text that make a shard.
SHARD_BYTES = 256 << 20


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = data[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7


def _bloom_bits(keys: np.ndarray, size: int) -> np.ndarray:
    """Places of hashes in a filter of size bits: PROBES for each, by double hashing."""
    step = (keys >> np.uint64(33)) | np.uint64(1)
    return (keys[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(size)


class TableWriter:
    """Entries come in ascending order of key; equal keys are allowed and keep their order."""

    def __init__(self, stream):
        self.stream, self.at, self.entries, self.ids = stream, 0, 0, 0
        self.zstd, self.index, self.hashes = zstandard.ZstdCompressor(level=1), [], []
        self._new_block()

    def _new_block(self) -> None:
        self.block, self.size, self.restarts, self.last, self.count, self.before = [], 0, [], b"", 0, self.ids

    def _write(self, data: bytes) -> int:
        self.stream.write(data)
        self.at += len(data)
        return self.at - len(data)

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(self.size)
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += [entry, value]
        self.size += len(entry) + len(value)
        self.hashes.append(xxhash.xxh64_intdigest(key))
        self.last, self.count, self.entries, self.ids = key, self.count + 1, self.entries + 1, self.ids + len(value) // 4
        if self.size >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.count:
            raw = b"".join(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            stored = self.zstd.compress(raw)
            at = self._write(stored + struct.pack("<I", zlib.crc32(stored)))
            self.index.append(INDEX.pack(at, len(stored) + 4, self.count, self.before, len(self.last)) + self.last)
            self._new_block()

    def finish(self) -> None:
        self._end_block()
        index = b"".join(self.index)
        index_at = self._write(index)
        size = max(64, BITS_PER_KEY * self.entries)
        bits = np.zeros(size, bool)
        bits[_bloom_bits(np.array(self.hashes, np.uint64), size).astype(np.int64).ravel()] = True
        bloom = struct.pack("<Q", size) + np.packbits(bits).tobytes()
        bloom_at = self._write(bloom)
        self._write(FOOTER.pack(index_at, len(index), bloom_at, len(bloom), self.entries, self.ids, MAGIC))


class Table:
    """A shard open for reading."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        end = self.file.size()
        index_at, index_size, bloom_at, bloom_size, self.entries, self.ids, magic = FOOTER.unpack(self._read(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a table of this format")
        bloom = self._read(bloom_at, bloom_size)
        self.bloom_size, self.bloom = struct.unpack_from("<Q", bloom)[0], np.unpackbits(np.frombuffer(bloom, np.uint8, offset=8))
        index, at, self.blocks, self.lasts = self._read(index_at, index_size), 0, [], []
        while at < len(index):
            *block, n = INDEX.unpack_from(index, at)
            at += INDEX.size + n
            self.blocks.append(block)
            self.lasts.append(index[at - n : at])
        self.zstd = zstandard.ZstdDecompressor()

    def _read(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def _block(self, k: int) -> bytes:
        stored = self._read(*self.blocks[k][:2])
        if zlib.crc32(stored[:-4]) != struct.unpack("<I", stored[-4:])[0]:
            raise ValueError("a block is damaged")
        return self.zstd.decompress(stored[:-4])

    @staticmethod
    def _entries(raw: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        end, key = len(raw) - 4 - 4 * struct.unpack("<I", raw[-4:])[0], b""
        while at < end:
            shared, at = _read_varint(raw, at)
            more, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + more]
            at += more + size
            yield key, raw[at - size : at]

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.blocks)):
            yield from self._entries(self._block(k))

    def may_hold(self, key: bytes) -> bool:
        places = _bloom_bits(np.array([xxhash.xxh64_intdigest(key)], np.uint64), self.bloom_size).astype(np.int64)
        return bool(self.bloom[places].all())

    def get(self, key: bytes) -> list[bytes]:
        """The values under a key, in order."""
        out: list[bytes] = []
        k = bisect.bisect_left(self.lasts, key) if self.may_hold(key) else len(self.blocks)
        while k < len(self.blocks):
            raw = self._block(k)
            n = struct.unpack("<I", raw[-4:])[0]
            places = struct.unpack(f"<{n}I", raw[-4 - 4 * n : -4])
            whole = lambda i: next(self._entries(raw, places[i]))[0]  # noqa: E731, B023
            start = max(0, bisect.bisect_left(range(n), key, key=whole) - 1)
            for found, value in self._entries(raw, places[start]):
                if found == key:
                    out.append(value)
                elif found > key:
                    return out
            if self.lasts[k] > key:
                return out
            k += 1
        return out


def write_tables(docs: DataFrame, vocabulary: str, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Encode every row of docs(doc_id, text, ...), write the shards, return their manifest.

    (shard int, path, entries long, ids long, first_key binary, last_key binary, ids_before long), a table. Null and
    empty texts are the end id alone; a null doc_id comes first; rows that repeat a doc_id are all kept, in order of a hash of their text;
    an empty table gives no shard. Other columns are ignored. A repeated attempt of a task writes under another name.
    """
    spark = docs.sparkSession
    scratch, end = Scratch(spark, "sstables"), np.array([end_id], "<u4").tobytes()
    folder = scratch.folder

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, code, ends, told = TaskContext.get().partitionId(), coder(vocabulary, "byte_level"), [], []

        def write(stream) -> None:
            table = TableWriter(stream)
            for b in few_rows(batches):
                keys, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
                for at, block in in_blocks(texts, BLOCK_CHARACTERS):
                    for doc, ids in zip(keys[at : at + len(block)], code.ids(block), strict=True):
                        key = key_of(doc)
                        if not ends:
                            ends.append(key)
                        ends[1:] = [key]
                        table.add(key, ids + end)
            table.finish()
            told.append((table.entries, table.ids))

        write_whole(path := f"{folder}/shards/{shard:06d}-{uuid.uuid4().hex[:8]}.sst", write)
        (entries, ids), names = told[0], ["shard", "path", "entries", "ids", "first_key", "last_key"]
        if entries:
            yield pa.RecordBatch.from_pydict(dict(zip(names, ([shard], [path], [entries], [ids], [ends[0]], [ends[-1]]), strict=True)), schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("entries", pa.int64()), ("ids", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Rows of one id are told apart by their text, so that they have an order, and many of them several shards.
    shards = shards or max(default_partitions(spark), -(-size // SHARD_BYTES))
    rows = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text")
    written = scratch.keep(rows.mapInArrow(scan, "shard int, path string, entries long, ids long, first_key binary, last_key binary"), "written")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return scratch.keep(written.withColumn("ids_before", F.coalesce(F.sum("ids").over(before), F.lit(0))), "manifest")


def read_tables(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids binary) of every document in the shards; start: ids of all documents before it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, at in zip(b.column("path").to_pylist(), b.column("ids_before").to_pylist(), strict=True):
                docs, starts, values, size = [], [], [], 0
                for key, value in Table(path).scan():
                    docs.append(id_of(key))
                    starts.append(at)
                    values.append(value)
                    at += len(value) // 4
                    size += len(value)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(values, pa.binary())], ["doc_id", "start", "ids"])
                        docs, starts, values, size = [], [], [], 0
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(values, pa.binary())], ["doc_id", "start", "ids"])

    n = max(1, manifest.count())
    return manifest.select("path", "ids_before").repartition(n).mapInArrow(scan, "doc_id long, start long, ids binary")


def checked(read: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of read_tables()."""
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def look_up(spark: SparkSession, manifest: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, ids binary) of the documents named by ids.doc_id, by filter and binary search; unknown ids give no row.

    Each id goes to the shards whose key range holds it; ids are dealt by shard.
    """
    asked = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    bounds = [(r["path"], bytes(r["first_key"]), bytes(r["last_key"])) for r in manifest.select("path", "first_key", "last_key", "shard").orderBy("shard").collect()]
    lasts = [b[2] for b in bounds]

    def route(batches):
        for b in batches:
            docs, paths = [], []
            for d in b.column("doc_id").to_pylist():
                k = bisect.bisect_left(lasts, key_of(d))
                while k < len(bounds) and bounds[k][1] <= key_of(d):
                    docs.append(d)
                    paths.append(bounds[k][0])
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(paths, pa.string())], ["doc_id", "path"])

    def find(batches):
        path, shard = None, None
        for b in batches:
            docs, values = [], []
            for d, p in zip(b.column("doc_id").to_pylist(), b.column("path").to_pylist(), strict=True):
                if p != path:
                    path, shard = p, Table(p)
                got = shard.get(key_of(d))
                docs += [d] * len(got)
                values += got
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(values, pa.binary())], ["doc_id", "ids"])

    return asked.mapInArrow(route, "doc_id long, path string").repartition("path").sortWithinPartitions("path", "doc_id").mapInArrow(find, "doc_id long, ids binary")
