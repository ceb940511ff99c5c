"""The store: documents and their bills on Parquet, its mutations as DataFrame operations, history and cache.

documents has a row for each sha256, bills one for each (sha256, page). Both are dealt to buckets by the hash of sha256, and a bucket is a few
files. The latest manifest names the files that count, with their rows and their least and greatest created_at, and is written last, so
a write that is cut off leaves the store as it was. A write adds a file to each bucket that it touches and writes again only those
files that hold a document it replaces. Files of documents have Bloom filters, which tell misses of the cache without reading them.
"""

from __future__ import annotations

import functools
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from billoom.functions import render

from . import totals
from .staged import hadoop_path

DOCUMENTS = "sha256 string, fingerprint string, source_path string, file_name string, page_count int, has_text_layer boolean, model string, created_at string"
BILLS = "sha256 string, page int, status string, vendor string, vendor_address string, invoice_number string, bill_date string, due_date string, currency string, net_total double, tax_total double, gross_total double, iban string, confidence double, quality_warning string, payload string, created_at string"


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of the rows of each key the one greatest in ``order``."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).filter("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those of equal keys, and the others of new added. Of new's rows of one key any one stays.

    A full join by key would shuffle both; what new replaces is taken out of old instead, and new is small beside it.
    """
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.dropDuplicates(keys))


def replace_bills(old: DataFrame, new: DataFrame) -> DataFrame:
    """The bills of a document that is written again are replaced as a set: pages that it no longer has go."""
    return old.join(new.select("sha256").distinct(), "sha256", "left_anti").unionByName(new.dropDuplicates(["sha256", "page"]))


def forget(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows without those of the documents gone.sha256."""
    return rows.join(gone.select("sha256").distinct(), "sha256", "left_anti")


def stored_bills(bills: DataFrame, documents: DataFrame) -> DataFrame:
    """Bills with their document's file name, path and model; bills without a document don't show."""
    return bills.join(documents.select("sha256", "file_name", "source_path", "model"), "sha256")


def bills_of(bills: DataFrame, documents: DataFrame, sha256: str) -> DataFrame:
    """One document's bills in order of page."""
    one = F.col("sha256") == sha256
    return stored_bills(bills.filter(one), documents.filter(one)).orderBy("page")


def history(bills: DataFrame, documents: DataFrame, limit: int, order: tuple[str, ...] = ("created_at", "write_seq", "page", "sha256")) -> DataFrame:
    """The latest ``limit`` stored bills, newest first, ties to the later row; none for a limit below 1."""
    return stored_bills(bills, documents).orderBy(*[F.desc(c) for c in order]).limit(max(0, limit))


def history_lines(rows: DataFrame) -> DataFrame:
    """(line): rows of history() as text."""
    return rows.select(render.history_line(*[F.col(c) for c in ("created_at", "vendor", "bill_date", "gross_total", "currency", "page", "file_name")]).alias("line"))


def bill_count(bills: DataFrame) -> DataFrame:
    return bills.agg(F.count("*").alias("bills"))


def newest_documents(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.desc("created_at"), "sha256")


def placed_documents(documents: DataFrame) -> DataFrame:
    """documents with place: 1 for the newest, ties by sha256; without a time they come last. Numbered by ranges of time, never in one task."""
    age = F.coalesce(-F.unix_micros(F.col("created_at").try_cast("timestamp")), F.lit(2**63 - 1))
    return totals.numbered(documents.withColumn("_age", age), "_age", "place", ("sha256",)).drop("_age")


def cache_probe(incoming: DataFrame, documents: DataFrame, bills: DataFrame) -> DataFrame:
    """incoming(sha256, fingerprint, ...) with hit: stored under the same fingerprint and with at least one bill.

    A null or empty hash never hits (the file could not be read).
    """
    ready = documents.select("sha256", "fingerprint").join(bills.select("sha256").distinct(), "sha256", "left_semi").distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & (F.coalesce(F.length("sha256"), F.lit(0)) > 0)
    return incoming.join(ready, ["sha256", "fingerprint"], "left").withColumn("hit", hit).select(*incoming.columns, "hit")


def cache_plan(incoming: DataFrame, documents: DataFrame, bills: DataFrame, use_cache: bool = True) -> DataFrame:
    """incoming with hit and save: what is answered from the store, and whose answer is written to it. Without the cache it is neither read nor written."""
    probed = cache_probe(incoming, documents, bills) if use_cache else incoming.withColumn("hit", F.lit(False))
    return probed.withColumn("save", ~F.col("hit") & F.lit(use_cache))


def history_rows(rows: DataFrame) -> DataFrame:
    """The nine columns of the history, a missing total as null."""
    names = {"file_name": "file", "page": "page", "status": "status", "vendor": "vendor", "bill_date": "date", "gross_total": "gross_total", "currency": "currency", "model": "model", "created_at": "created_at"}
    return rows.select(*[F.col(c).alias(n) for c, n in names.items()])


def from_stored(rows: DataFrame) -> DataFrame:
    """Rows (path, page, page_count, status, payload, created_at) as bills answered from the cache: the payload's fields, an error for other statuses, a note."""
    from billoom.operators.replies import record

    fields = record(F.try_parse_json("payload"))
    error = F.when(F.col("status") != "ok", F.concat(F.lit("stored as "), "status")).otherwise("")
    return rows.select("path", "page", "page_count", "status", error.alias("error"), F.lit(True).alias("from_cache"), F.array(F.concat(F.lit("answered from the cache, stored "), "created_at")).alias("notes"), fields.alias("f")).select("*", "f.*").drop("f")


#: Buckets of a new store, and files of a bucket from which a write merges them.
BUCKETS, MOST_FILES = 64, 8
#: Rows of keys up to which they go to all tasks; more are joined by shuffling.
FEW_KEYS = 1_000_000
#: Bloom filter: bits a key and probes.
BITS_PER_KEY, PROBES = 10, 7
#: Times that a write is tried against others' writes.
ATTEMPTS = 5
#: Beside DOCUMENTS and BILLS, what the files hold: a document's number of bills, the write that a bill came with.
_FILES = {"documents": f"{DOCUMENTS}, bill_count long", "bills": f"{BILLS}, write_seq long"}


class Conflict(RuntimeError):
    """Another has written the store since it was read."""


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of 64-bit hashes in a filter, by double hashing."""
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(33)) | np.uint64(1)
    return (h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


def bloom(hashes: np.ndarray) -> bytes:
    """The filter of 64-bit hashes; of none it is empty."""
    if not len(hashes):
        return b""
    marks = np.zeros(math.ceil(len(hashes) * BITS_PER_KEY / 64) * 64, np.uint8)
    marks[_probes(hashes, len(marks)).ravel()] = 1
    return np.packbits(marks).tobytes()


def in_bloom(filter_: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter; what is in it always is."""
    if not filter_:
        return np.zeros(len(hashes), bool)
    marks = np.unpackbits(np.frombuffer(filter_, np.uint8))
    return marks[_probes(hashes, len(marks))].all(axis=1)


def _pass_filters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys that a filter of their bucket lets through. Rows come by bucket, each one's filters (bits) before its keys."""
    bucket, filters = None, []
    for b in batches:
        keep = np.zeros(len(b), bool)
        for k, rows in b.groupby("bucket", sort=False):
            if k != bucket:
                bucket, filters = k, []
            is_filter = rows["bits"].notna()
            filters += list(rows.loc[is_filter, "bits"])
            hashes = rows.loc[~is_filter, "hash"].to_numpy(np.int64)
            found = np.zeros(len(hashes), bool)
            for f in filters:
                found |= in_bloom(f, hashes)
            keep[b.index.get_indexer(rows.index[~is_filter])] = found
        yield b.loc[keep, ["bucket", "sha256", "fingerprint"]]


def _columns(table: str) -> list[str]:
    return [c.split()[0] for c in _FILES[table].split(", ")]


@dataclass
class Store:
    """Both tables under a folder of any file system that Spark reaches."""

    spark: SparkSession
    folder: str
    buckets: int = BUCKETS
    #: Files of bills that the last history() read.
    files_read: int = field(default=0, init=False)

    def _path(self, name: str):
        return hadoop_path(self.spark, f"{self.folder}/{name}")

    # Manifests

    def _numbers(self) -> list[int]:
        fs, path = self._path("")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, number: int | None = None) -> dict:
        """The latest one, or that of a number: {number, buckets, files: [{table, bucket, path, rows, least, greatest, filter}]}; number 0 where there is none."""
        number = number if number is not None else max(self._numbers(), default=0)
        if not number:
            return {"number": 0, "buckets": self.buckets, "files": []}
        return json.loads(self.spark.read.text(f"{self.folder}/manifest-{number:012d}.json", wholetext=True).first()[0])

    def _commit(self, before: dict, files: list[dict]) -> None:
        """The manifest after ``before``. Of two writers at once one finds its number taken."""
        fs, fresh = self._path(f".manifest-{uuid.uuid4().hex}")
        stream = fs.create(fresh)
        stream.write(bytearray(json.dumps({"number": before["number"] + 1, "buckets": before["buckets"], "files": files}).encode()))
        stream.close()
        jvm, target = self.spark._jvm, self._path(f"manifest-{before['number'] + 1:012d}.json")[1]
        # Without an option a rename never replaces what is there.
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri() if fresh.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, target, options)
        except Exception as e:
            fs.delete(fresh, False)
            if fs.exists(target):
                raise Conflict("the store was written by another at the same time") from e
            raise

    def _retire(self, number: int) -> None:
        """Forget a manifest, and delete the files that none of the later ones names. The one before the latest stays for who reads it still."""
        kept = [n for n in self._numbers() if n != number]
        if number < 1 or number not in self._numbers() or not kept:
            return
        named = {p for n in kept for f in self.manifest(n)["files"] for p in (f["path"], f.get("filter"))}
        for f in self.manifest(number)["files"]:
            for p in (f["path"], f.get("filter")):
                if p and p not in named:
                    self._delete(p)
        self._delete(f"manifest-{number:012d}.json")

    def clean(self) -> int:
        """Delete folders of writes that no manifest names (writers that were cut off); how many. Not while another writes."""
        named = {f["path"].split("/")[1] for n in self._numbers() for f in self.manifest(n)["files"]}
        fs, path = self._path("files")
        gone = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName() not in named] if fs.exists(path) else []
        return sum(bool(fs.delete(p, True)) for p in gone)

    # Reading

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64("sha256"), F.lit(buckets)).cast("int")

    def _read(self, table: str, files: list[dict], whole: bool = False) -> DataFrame:
        paths = [f"{self.folder}/{f['path']}" for f in files if f["table"] == table]
        rows = self.spark.read.schema(_FILES[table]).parquet(*paths) if paths else self.spark.createDataFrame([], _FILES[table])
        return rows if whole else rows.drop("bill_count", "write_seq")

    def documents(self) -> DataFrame:
        return self._read("documents", self.manifest()["files"])

    def bills(self) -> DataFrame:
        return self._read("bills", self.manifest()["files"])

    def numbered_bills(self) -> DataFrame:
        """BILLS and write_seq, the write that each came with, by which history() tells rows of one created_at apart."""
        return self._read("bills", self.manifest()["files"], whole=True)

    def find(self, sha256: str, fingerprint: str) -> DataFrame:
        """The document of this hash and fingerprint, from its bucket's files."""
        return self._of(sha256, "documents").filter((F.col("sha256") == sha256) & (F.col("fingerprint") == fingerprint))

    def _of(self, sha256: str, table: str) -> DataFrame:
        m = self.manifest()
        bucket = self.spark.range(1).select(F.lit(sha256).alias("sha256")).select(self._bucket(m["buckets"])).first()[0]
        return self._read(table, [f for f in m["files"] if f["bucket"] == bucket])

    def bills_of(self, sha256: str) -> DataFrame:
        """One document's bills in order of page, from its bucket's files."""
        return bills_of(self._of(sha256, "bills"), self._of(sha256, "documents"), sha256)

    def probe(self, incoming: DataFrame) -> DataFrame:
        """incoming(sha256, fingerprint, ...) with hit, as cache_probe() of the whole store.

        Keys are shuffled by bucket and pass its files' filters; what is left is looked up in the files of its buckets. Misses read no file
        of documents; while at most FEW_KEYS are left, stored rows are not shuffled. A null or empty hash never hits.
        """
        m = self.manifest()
        docs = [f for f in m["files"] if f["table"] == "documents"]
        miss = incoming.withColumn("hit", F.lit(False))
        if not docs:
            return miss
        keys = incoming.select("sha256", "fingerprint").filter("sha256 <> '' AND fingerprint IS NOT NULL").distinct()
        keys = keys.select(self._bucket(m["buckets"]).alias("bucket"), "sha256", "fingerprint", F.xxhash64("sha256", "fingerprint").alias("hash"))
        paths = self.spark.createDataFrame([(f["path"], f["bucket"]) for f in docs], "path string, bucket int")
        filters = self.spark.read.parquet(*sorted({f"{self.folder}/{f['filter']}" for f in docs})).join(F.broadcast(paths), "path").select("bucket", "bits", F.lit(0).cast("long").alias("hash"))
        stream = keys.unionByName(filters, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket", F.col("bits").isNull())
        left = stream.mapInPandas(_pass_filters, "bucket int, sha256 string, fingerprint string").persist()
        by_bucket = {r["bucket"]: r["count"] for r in left.groupBy("bucket").count().collect()}
        if not by_bucket:
            left.unpersist()
            return miss
        few = sum(by_bucket.values()) <= FEW_KEYS
        side = F.broadcast if few else lambda t: t
        stored = self._read("documents", [f for f in docs if f["bucket"] in by_bucket], whole=True).filter("bill_count > 0").select("sha256", "fingerprint")
        found = stored.join(side(left.drop("bucket")), ["sha256", "fingerprint"], "left_semi").withColumn("_hit", F.lit(True))
        hit = F.coalesce(F.col("_hit"), F.lit(False))
        return incoming.join(side(found), ["sha256", "fingerprint"], "left").withColumn("hit", hit).select(*incoming.columns, "hit")

    def history(self, limit: int) -> DataFrame:
        """history() of the store: files are read newest first until the rest can hold none of the latest ``limit`` bills.

        The documents of what is left after the cut are read from its buckets.
        """
        m = self.manifest()
        files = sorted((f for f in m["files"] if f["table"] == "bills"), key=lambda f: (f["greatest"] or "", f["path"]), reverse=True)
        docs, order, take = [f for f in m["files"] if f["table"] == "documents"], [F.desc(c) for c in ("created_at", "write_seq", "page", "sha256")], 0
        self.files_read = 0
        while limit > 0:
            # Twice as many files each time, and at least enough to hold the rows.
            take, rows = max(1, 2 * take), 0
            rows = sum(f["rows"] for f in files[:take])
            while take < len(files) and rows < limit:
                rows += files[take]["rows"]
                take += 1
            self.files_read = min(take, len(files))
            bills = self._read("bills", files[:take], whole=True)
            newest = bills.orderBy(*order).limit(limit)
            buckets = {r[0] for r in newest.select(self._bucket(m["buckets"])).distinct().collect()}
            out = stored_bills(newest, self._read("documents", [f for f in docs if f["bucket"] in buckets])).orderBy(*order)
            if take >= len(files):
                return out if out.count() == limit else history(bills, self._read("documents", docs), limit)
            stand = out.agg(F.count("*"), F.min("created_at")).first()
            if stand[0] == limit and (files[take]["greatest"] or "") < (stand[1] or ""):
                return out
        return history(self._read("bills", [], whole=True), self._read("documents", []), 0)

    # Writing

    def _put(self, rows: DataFrame, table: str, path: str, buckets: int) -> None:
        """rows to a file for each bucket."""
        rows.withColumn("bucket", self._bucket(buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{path}/{table}")

    def _told(self, path: str, table: str) -> list[dict]:
        """Entries of the manifest for the files of one table of a write; those of documents get their filters."""
        fs, at = self._path(f"{path}/{table}")
        if not fs.exists(at) or not any(f.getPath().getName().startswith("bucket=") for f in fs.listStatus(at)):
            return []
        rows = self.spark.read.schema(f"{_FILES[table]}, bucket int").parquet(f"{self.folder}/{path}/{table}")
        name = F.concat(F.lit(f"{path}/{table}/bucket="), F.col("bucket").cast("string"), F.lit("/"), F.col("_metadata.file_name"))
        named = rows.select(name.alias("path"), "bucket", "created_at", *(["sha256", "fingerprint", "bill_count"] if table == "documents" else []))
        # As many rows as files, at most some for each bucket.
        out = [{"table": table, "bucket": r["bucket"], "path": r["path"], "rows": r["n"], "least": r["least"], "greatest": r["greatest"]} for r in named.groupBy("path", "bucket").agg(F.count("*").alias("n"), F.min("created_at").alias("least"), F.max("created_at").alias("greatest")).collect()]
        if table == "documents":
            # No column with nulls among them: pandas would make the hashes floating-point.
            hashes = named.select("path", F.xxhash64("sha256", "fingerprint").alias("hash"), (F.col("bill_count") > 0).alias("counts"))
            built = hashes.groupBy("path").applyInPandas(lambda b: pd.DataFrame({"path": [b["path"].iat[0]], "bits": [bloom(b.loc[b["counts"], "hash"].to_numpy())]}), "path string, bits binary")
            built.write.parquet(f"{self.folder}/{path}/filters")
            out = [e | {"filter": f"{path}/filters"} for e in out]
        return out

    def _write(self, documents: DataFrame, bills: DataFrame, gone: DataFrame | None = None) -> None:
        """New rows first, once; then, against the manifest of that moment, the files that hold documents which they replace; then the manifest.

        If another was quicker, the last two are done again.
        """
        write, before = f"files/w-{uuid.uuid4().hex}", self.manifest()
        try:
            buckets, seq = before["buckets"], F.lit(before["number"] + 1).cast("long")
            counted = bills.filter("sha256 IS NOT NULL").dropDuplicates(["sha256", "page"])
            many = counted.groupBy("sha256").agg(F.count("*").alias("bill_count"))
            told = documents.filter("sha256 IS NOT NULL").dropDuplicates(["sha256"]).join(many, "sha256", "left").withColumn("bill_count", F.coalesce("bill_count", F.lit(0)))
            self._put(told.select(*_columns("documents")), "documents", f"{write}/new", buckets)
            self._put(counted.withColumn("write_seq", seq).select(*_columns("bills")), "bills", f"{write}/new", buckets)
            new = self._told(f"{write}/new", "documents") + self._told(f"{write}/new", "bills")
            touched = [self._read(t, new).select("sha256") for t in ("documents", "bills")] + ([gone.select("sha256")] if gone is not None else [])
            keys = functools.reduce(DataFrame.unionByName, touched).distinct()
            for k in range(ATTEMPTS):
                before = self.manifest()
                try:
                    self._commit(before, self._merged(before, new, keys, f"{write}/{k}"))
                    break
                except Conflict:
                    self._delete(f"{write}/{k}")
                    if k + 1 == ATTEMPTS:
                        raise
        except BaseException:
            self._delete(write)
            raise
        self._retire(before["number"] - 1)

    def _delete(self, name: str) -> None:
        fs, at = self._path(name)
        fs.delete(at, True)

    def _merged(self, before: dict, new: list[dict], keys: DataFrame, path: str) -> list[dict]:
        """The files that count after a write: what holds none of ``keys`` stays, the rest is written again without them; many files of a bucket become one."""
        hit = {r[0] for r in keys.select(self._bucket(before["buckets"])).distinct().collect()}
        out = list(new)
        side = F.broadcast(keys) if keys.count() <= FEW_KEYS else keys
        for table in ("documents", "bills"):
            files = [f for f in before["files"] if f["table"] == table]
            near = [f for f in files if f["bucket"] in hit]
            held: set[str] = set()
            if near:
                name = F.col("_metadata.file_name").alias("file")
                held = {r[0] for r in self._read(table, near, whole=True).select("sha256", name).join(side, "sha256", "left_semi").select("file").distinct().collect()}
            again = [f for f in near if f["path"].rpartition("/")[2] in held]
            for b in hit:
                mine = [f for f in near if f["bucket"] == b]
                if len(mine) >= MOST_FILES:
                    again += [f for f in mine if f not in again]
            if again:
                self._put(self._read(table, again, whole=True).join(side, "sha256", "left_anti"), table, path, before["buckets"])
                out += self._told(path, table)
            out += [f for f in files if f not in again]
        return out

    def create(self) -> None:
        """Empty tables where there are none."""
        if not self._numbers():
            self.clear()

    def save(self, documents: DataFrame, bills: DataFrame) -> None:
        """Write documents with their bills again, or for the first time: pages that a document no longer has go.

        Bills are kept for documents that are not among ``documents`` too, but only those saved with their document make it a hit. Null
        hashes are not stored; of rows of one key any one is.
        """
        self._write(documents, bills)

    def forget(self, gone: DataFrame) -> None:
        """Delete the documents gone.sha256 and their bills."""
        self._write(self.spark.createDataFrame([], DOCUMENTS), self.spark.createDataFrame([], BILLS), gone)

    def clear(self) -> None:
        """Both tables empty; the schema stays. What was there stays readable to who reads it until the next write."""
        before = self.manifest()
        self._commit(before, [])
        self._retire(before["number"] - 1)

    def wipe(self, archive: str, inbox: str, confirmed: bool = False, named: str = "") -> dict[str, int]:
        """Empty both tables, the archive and the store's own inbox, entry by entry (the folders stay); how many bills, documents and files went, and failed to go.

        ``named``: a folder that a run was told to watch. It may be any that its owner keeps documents in, so neither it nor what lies
        above or below it is ever emptied.
        """
        if not confirmed:
            raise ValueError("a wipe must be confirmed")
        told = {"bills": self.bills().count(), "documents": self.documents().count(), "archived": 0, "waiting": 0, "failed": 0}
        self.clear()
        whole = lambda p: (lambda x: x[0].makeQualified(x[1]).toString().rstrip("/") + "/")(hadoop_path(self.spark, p))
        for name, folder in (("archived", archive), ("waiting", inbox)):
            if named and (whole(folder).startswith(whole(named)) or whole(named).startswith(whole(folder))):
                continue
            fs, path = hadoop_path(self.spark, folder)
            for entry in fs.listStatus(path) if fs.exists(path) else ():
                told[name if fs.delete(entry.getPath(), True) else "failed"] += 1
        return told
