"""Sharding by fixed virtual slots.

A record's key is hashed to one of a fixed number of slots; a map from slots to shards says where it goes. The map is a table of
versions: the first gives each shard an even run of slots, later ones are edits of the one before that move few slots,
to even out the bytes of the shards or to fill a new shard. Records move only with their slot.

Slots have parts. All parts of a slot stand in one shard, but for a slot that holds more than its share, as when one key
is on a third of all rows (or null): the parts of such a slot, rows dealt in turn, are placed each for itself.

The driver edits the map from the bytes of (slot, part), a table of fixed size. The records go to shard files in one
shuffle, to buckets of about equal bytes within each shard.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, default_partitions

SLOTS, PARTS = 4096, 16
#: A slot with more than this share of a shard's even load is placed by parts.
SPLIT_SHARE = 1 / 64
#: Bytes of records in a bucket, which one task writes.
BUCKET_BYTES = 64 << 20
#: Exchanges of two slots tried after the moves.
EXCHANGES = 2000
_MAP = "version int, slot int, part int, shard int"


def slot_of(key: str = "doc_id", slots: int = SLOTS):
    """The slot of a record, by its key alone; all records with a null key have one slot."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(slots)).cast("int")


def marked(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with slot, part (rows of a task in turn) and size (bytes of the text and 1)."""
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + 1
    return docs.withColumns({"slot": slot_of(key), "part": F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int"), "size": size})


def loads(rows: DataFrame) -> np.ndarray:
    """Bytes by (slot, part): a fixed number of sums."""
    out = np.zeros((SLOTS, PARTS), np.int64)
    for r in rows.groupBy("slot", "part").agg(F.sum("size").alias("size")).collect():
        out[r["slot"], r["part"]] = r["size"]
    return out


def even_map(shards: int) -> np.ndarray:
    """Version 1: runs of slots, knowing nothing of their load."""
    return np.repeat((np.arange(SLOTS) * shards // SLOTS).astype(np.int64)[:, None], PARTS, axis=1)


def _units(load: np.ndarray, shards: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bytes, [(slot, part)]) of what moves as one: whole slots, or parts of those that are too large."""
    most, out = max(1.0, load.sum() / shards * SPLIT_SHARE), []
    for s, total in enumerate(load.sum(axis=1).tolist()):
        if total > most:
            out += [(int(load[s, p]), [(s, p)]) for p in range(PARTS)]
        else:
            out.append((total, [(s, p) for p in range(PARTS)]))
    return out


def rebalanced(now: np.ndarray, load: np.ndarray, shards: int) -> np.ndarray:
    """The next version: bytes near equal, with few moves.

    Shards above the mean give up units, largest first, that don't take them below it; what was given up goes, largest first, to the
    shard with least. Then units of the fullest and the emptiest shard change places while that narrows the gap.
    """
    units, out = _units(load, shards), now.copy()
    mean, total = load.sum() / shards, np.zeros(shards)
    held: list[list[int]] = [[] for _ in range(shards)]
    for k, (size, cells) in enumerate(units):
        shard = int(now[cells[0]])
        held[shard].append(k)
        total[shard] += size
    free: list[int] = []
    for s in range(shards):
        for k in sorted(held[s], key=lambda k: (-units[k][0], k)):
            if total[s] > mean and units[k][0] and total[s] - units[k][0] >= mean * (1 - SPLIT_SHARE / 4):
                held[s].remove(k)
                total[s] -= units[k][0]
                free.append(k)
    heap = [(t, s) for s, t in enumerate(total)]
    heapq.heapify(heap)
    for k in sorted(free, key=lambda k: (-units[k][0], k)):
        t, s = heapq.heappop(heap)
        held[s].append(k)
        heapq.heappush(heap, (t + units[k][0], s))
    for t, s in heap:
        total[s] = t
    for _ in range(EXCHANGES):
        a, b = int(total.argmax()), int(total.argmin())
        gap = total[a] - total[b]
        mine = np.array([units[k][0] for k in held[a]])
        theirs = np.array([0, *(units[k][0] for k in held[b])])
        order = theirs.argsort(kind="stable")
        # of theirs, the one that lies half the gap below each of mine; 0 stands for none in exchange
        at = np.clip(np.searchsorted(theirs[order], mine - gap / 2), 0, len(theirs) - 1)
        change = mine - theirs[order][at]
        good = np.where((change > 0) & (change < gap), np.abs(change - gap / 2), np.inf)
        if not np.isfinite(good.min(initial=np.inf)):
            break
        i, j = int(good.argmin()), int(order[at[good.argmin()]])
        x = held[a].pop(i)
        held[b].append(x)
        if j:
            held[a].append(held[b].pop(j - 1))
        total[a] -= change[i]
        total[b] += change[i]
    for s in range(shards):
        for k in held[s]:
            for cell in units[k][1]:
                out[cell] = s
    return out


def grown(now: np.ndarray, load: np.ndarray, shards: int) -> np.ndarray:
    """The next version with one shard more, number ``shards``: it takes units until it has an even load, and nothing else moves."""
    units, out = _units(load, shards), now.copy()
    want, total = load.sum() / (shards + 1), np.zeros(shards)
    held: list[list[int]] = [[] for _ in range(shards)]
    for k, (size, cells) in enumerate(units):
        held[int(now[cells[0]])].append(k)
        total[int(now[cells[0]])] += size
    for s in range(shards):
        held[s].sort(key=lambda k: (units[k][0], -k))
    got = 0
    while got < want and total.max() > 0:
        s = int(total.argmax())
        k = held[s].pop()
        if got + units[k][0] <= want * (1 + SPLIT_SHARE) or not got:
            for cell in units[k][1]:
                out[cell] = shards
            got += units[k][0]
        total[s] -= units[k][0]
    return out


def _cells(**columns: np.ndarray) -> pa.Table:
    """(slot, part, ...) from arrays by slot and part: SLOTS x PARTS rows."""
    slot, part = np.indices((SLOTS, PARTS), np.int32)
    return pa.table({"slot": slot.ravel(), "part": part.ravel()} | {k: v.ravel().astype(np.int32) for k, v in columns.items()})


@dataclass
class SlotMaps:
    """The versions of a map as a table (version, slot, part, shard) in a folder; a version is written once and never changed."""

    spark: SparkSession
    folder: str

    def write(self, version: int, shards: np.ndarray) -> None:
        self.spark.createDataFrame(_cells(version=np.full_like(shards, version), shard=shards)).select("version", "slot", "part", "shard").coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/version={version}")

    def read(self, version: int) -> np.ndarray:
        out = np.zeros((SLOTS, PARTS), np.int64)
        for r in self.table(version).collect():
            out[r["slot"], r["part"]] = r["shard"]
        return out

    def table(self, version: int) -> DataFrame:
        """(version, slot, part, shard), of fixed size."""
        return self.spark.read.schema(_MAP).parquet(f"{self.folder}/version={version}")


def _buckets(shards: np.ndarray, load: np.ndarray, n: int, tasks: int) -> tuple[np.ndarray, int]:
    """For each (slot, part) a bucket: within a shard, runs of slots of about BUCKET_BYTES, in all at least as many as tasks."""
    each = min(max(math.ceil(tasks / n), math.ceil(load.sum() / n / BUCKET_BYTES)), SLOTS * PARTS // n)
    out = np.zeros_like(shards)
    for s in range(n):
        mine = shards == s
        sizes = load[mine]
        ends = np.cumsum(sizes)
        out[mine] = s * each + np.minimum((ends - sizes) * each // max(1, int(ends[-1]) if len(ends) else 1), each - 1)
    return out, n * each


@dataclass
class Shards:
    """Records in shards: ``rows`` as read from the shard files, and the map's versions."""

    rows: DataFrame
    maps: SlotMaps
    version: int


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id") -> Shards:
    """Writes docs(doc_id, text) to ``shards`` shards of near equal bytes and reads them back.

    rows has doc_id, text, shard, slot long (the record's place in its shard, gapless from 0), virtual_slot and even_shard (where version 1 has it).
    Near equal: no single slot, or part of a slot that was split, would narrow the gap by moving; what is too large to be split
    further (a record, or several of one key in one part) can keep shards apart. A null key is a key; a null text has size 1;
    rows that repeat a key have its slot, equal rows are kept each; an empty table gives an empty result. Other columns are ignored.
    docs is read twice, so it should be a table, or else be written before.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "slots")
    plain = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([] if key == "doc_id" else [key])), key)
    load = loads(plain)
    maps = SlotMaps(spark, f"{scratch.folder}/maps")
    maps.write(1, even_map(shards))
    maps.write(2, rebalanced(maps.read(1), load, shards))
    maps.write(3, grown(maps.read(2), load, shards))
    placed = maps.read(2)
    bucket, n = _buckets(placed, load, shards, default_partitions(spark))
    even = even_map(shards)
    place = spark.createDataFrame(_cells(shard=placed, even_shard=even, bucket=bucket))
    # The map has SLOTS x PARTS rows at any size of the input.
    dealt = plain.join(F.broadcast(place), ["slot", "part"]).repartitionById(n, F.col("bucket"))
    path = scratch.path("shards")
    columns = ["doc_id", "text", F.col("slot").alias("virtual_slot"), "even_shard", "shard"]
    dealt.sortWithinPartitions("slot", "doc_id").select(*columns).write.partitionBy("shard").parquet(path)
    back = spark.read.schema("doc_id long, text string, virtual_slot int, even_shard int, shard int").parquet(path)
    # A bucket's task writes its file, and there are at most SLOTS x PARTS buckets.
    name = F.col("_metadata.file_name").alias("file")
    files = back.select("shard", name).groupBy("shard", "file").agg(F.count("*").alias("n"))
    files = scratch.keep(files.select("file", (F.sum("n").over(Window.partitionBy("shard").orderBy("file")) - F.col("n")).alias("before")), "files")
    rows = back.select("*", name, F.col("_metadata.row_index").alias("at")).join(F.broadcast(files), "file")
    return Shards(rows.withColumn("slot", F.col("before") + F.col("at")).drop("file", "at", "before"), maps, 2)
