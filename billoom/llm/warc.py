"""WARC archives and their capture index, merged externally.

Writers put a gzip member for each record into archives and leave, for each task, locally sorted capture runs:
lines of URL key, timestamp, page_id and a JSON object that says where the record is. Runs are merged by a
loser tree, at most ``FAN_IN`` at a time; passes repeat until few enough are left, and the last pass is cut into
ranges of the whole key (so a host with a third of all captures is cut too), which gives globally ordered
shards. A run ends in a sparse index (a line's key and place every so many lines), so a range is read from
its start. All files lie in the shared folder.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, default_partitions, open_store, write_whole

LEAST_REVISIT_BYTES = 100
FAN_IN = 64
RUN_LINES = 200_000
SPARSE = 256
SAMPLES = 64
TAIL = struct.Struct("<QQ8s")
MAGIC = b"BLCDX001"
READ_BYTES = 1 << 18


def url_key(url: str | None) -> str:
    """Host reversed and comma-joined, then path and sorted query; scheme, port, leading www. and fragment go. No host: '-'."""
    try:
        u = urlsplit((url or "").strip())
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        host = ""
    if not host:
        return "-"
    query = "?" + "&".join(sorted(u.query.split("&"))) if u.query else ""
    return quote(",".join(reversed(host.split("."))) + ")" + (u.path or "/") + query, safe="!$&'()*+,;=:@/?%-._~").lower()


def record(kind: str, page_id: int | None, url: str | None, when: str, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC 1.1 record as a gzip member. A revisit holds the HTTP header alone."""
    name = lambda n: f"<urn:page:{'' if n is None else n}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = {"WARC-Type": kind, "WARC-Record-ID": name(page_id), "WARC-Date": when, "WARC-Target-URI": quote(url or "", safe="!#$&'()*+,;=:@/?%-._~[]"), "WARC-Payload-Digest": f"sha256:{digest}"}
    if kind == "revisit":
        head |= {"WARC-Refers-To": name(refers_to), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 3, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC header, HTTP header, body) of a record's gzip member."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = lambda b: dict(x.split(": ", 1) for x in b.decode().split("\r\n")[1:])
    warc = fields(head)
    block = rest[: int(warc["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return warc, fields(http), body


class LoserTree:
    """Merges sorted iterators: each inner node holds the loser of its match, so a step replays one path to the root."""

    def __init__(self, streams: list[Iterator[bytes]]):
        self.streams = streams
        self.heads: list[bytes | None] = [next(s, None) for s in streams]
        self.n = len(streams)
        self.tree = [-1] * max(1, self.n)
        for k in range(self.n):
            self._enter(k)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _enter(self, k: int) -> None:
        """While the tree is built: a stream waits at the first free node above it."""
        winner, at = k, (k + self.n) // 2
        while at > 0:
            if self.tree[at] < 0:
                self.tree[at] = winner
                return
            if self._before(self.tree[at], winner):
                self.tree[at], winner = winner, self.tree[at]
            at //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[bytes]:
        if not self.n:
            return
        while (line := self.heads[(winner := self.tree[0])]) is not None:
            yield line
            self.heads[winner] = next(self.streams[winner], None)
            at = (winner + self.n) // 2
            while at > 0:
                if self._before(self.tree[at], winner):
                    self.tree[at], winner = winner, self.tree[at]
                at //= 2
            self.tree[0] = winner


def write_run(uri: str, lines: Iterator[bytes]) -> tuple[int, list[bytes]]:
    """Sorted lines as a run with its sparse index: (number of lines, the indexed lines' keys)."""
    sparse: list[tuple[bytes, int]] = []
    n = 0

    def write(stream) -> None:
        nonlocal n
        at, held, size = 0, [], 0
        for line in lines:
            if n % SPARSE == 0:
                sparse.append((line_key(line), at))
            held.append(line + b"\n")
            at += len(line) + 1
            size += len(line) + 1
            n += 1
            if size > READ_BYTES:
                stream.write(b"".join(held))
                held, size = [], 0
        index = zlib.compress(b"".join(struct.pack("<IQ", len(k), p) + k for k, p in sparse))
        stream.write(b"".join(held) + index + TAIL.pack(at, len(index), MAGIC))

    write_whole(uri, write)
    return n, [k for k, _ in sparse]


def line_key(line: bytes) -> bytes:
    """URL key, timestamp and page_id of an index line."""
    return line[: line.index(b" {")]


def read_run(uri: str, low: bytes | None = None, high: bytes | None = None) -> Iterator[bytes]:
    """Lines of a run whose key k has low <= k < high, read in pieces of fixed size."""
    store, path = open_store(uri)
    with store.open_input_file(path) as file:
        end, size, magic = TAIL.unpack(file.read_at(TAIL.size, file.size() - TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a run of this format")
        at, index, keys, places = 0, zlib.decompress(file.read_at(size, end)), [], []
        while at < len(index):
            n, place = struct.unpack_from("<IQ", index, at)
            keys.append(index[at + 12 : at + 12 + n])
            places.append(place)
            at += 12 + n
        at = places[max(0, bisect.bisect_left(keys, low) - 1)] if low is not None and places else 0
        rest = b""
        while at < end:
            data = file.read_at(min(READ_BYTES, end - at), at)
            at += len(data)
            *lines, rest = (rest + data).split(b"\n")
            for line in lines:
                key = line_key(line)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield line


def write_archives(pages: DataFrame, captured: Column | None = None, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Write a record for every row of pages(page_id, url, html, ...) and sorted capture runs; return the runs' manifest.

    Of records with equal payloads of at least ``least`` bytes those with the smallest page_id are responses, others
    revisits that refer to it. A null html is an empty payload; a null url has the key '-'; a null page_id counts
    as larger than any; rows that repeat the smallest page_id are responses too; an empty table gives no
    run. captured: a timestamp of each row (null: 1970-01-01); other columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = scratch.folder
    when = F.date_format(F.coalesce(captured if captured is not None else F.lit(None).cast("timestamp"), F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"), when.alias("when"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    shared = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(scratch.keep(shared, "shared"), "digest", "left").withColumn("lead", F.when(F.col("lead") != F.coalesce("page_id", F.lit(2**63 - 1)), F.col("lead")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/archives/{uuid.uuid4().hex}"
        lines: list[bytes] = []
        told: list[tuple[str, int, list[bytes]]] = []

        def run() -> None:
            lines.sort()
            path = f"{name}-{len(told)}.cdx"
            n, keys = write_run(path, iter(lines))
            told.append((path, n, keys[:: max(1, len(keys) // SAMPLES)]))
            lines.clear()

        def write(stream) -> None:
            at = 0
            for b in batches:
                for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "when", "digest", "lead")), strict=True):
                    page, url, payload, when, digest, lead = row
                    kind = "response" if lead is None else "revisit"
                    member = record(kind, page, url, when, digest, payload, lead)
                    stream.write(member)
                    stamp = "".join(c for c in when if c.isdigit())
                    order = 2**64 - 1 if page is None else page + 2**63
                    lines.append(f"{url_key(url)} {stamp} {order:020d} ".encode() + json.dumps({"file": f"{name}.warc.gz", "offset": at, "length": len(member), "page": page, "type": kind}).encode())
                    at += len(member)
                    if len(lines) >= RUN_LINES:
                        run()

        write_whole(f"{name}.warc.gz", write)
        if lines:
            run()
        yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.int64()), pa.array([t[2] for t in told], pa.list_(pa.binary()))], ["path", "lines", "samples"])

    runs = rows.select("page_id", "url", "payload", "when", "digest", "lead").mapInArrow(scan, "path string, lines long, samples array<binary>")
    return scratch.keep(runs, "runs")


def _merged(scratch: Scratch, tasks: DataFrame) -> DataFrame:
    """tasks(shard, paths, low, high): each merged by a loser tree into one run; a table like write_archives() returns, with shard."""
    folder = scratch.folder

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, paths, low, high in zip(*(b.column(c).to_pylist() for c in ("shard", "paths", "low", "high")), strict=True):
                path = f"{folder}/{shard:06d}-{uuid.uuid4().hex[:8]}.cdx"
                n, keys = write_run(path, iter(LoserTree([read_run(p, low, high) for p in paths])))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([n], pa.int64()), pa.array([keys[:: max(1, len(keys) // SAMPLES)]], pa.list_(pa.binary()))], ["shard", "path", "lines", "samples"])

    dealt = tasks.repartition(max(1, tasks.count()), "shard")
    return scratch.keep(dealt.mapInArrow(scan, "shard int, path string, lines long, samples array<binary>"), "runs")


def merge_index(runs: DataFrame, shards: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """(shard, path, lines, samples): the captures of all runs in global order of URL key, timestamp and page_id.

    Every shard is in order and comes after all of the shards before it. No runs: no shards.
    """
    spark = runs.sparkSession
    scratch, schema = Scratch(spark, "cdx"), "shard int, paths array<string>, low binary, high binary"
    while (n := runs.count()) > fan_in:
        numbered = runs.withColumn("shard", F.pmod(F.xxhash64("path"), F.lit(-(-2 * n // fan_in))).cast("int"))
        groups = numbered.groupBy("shard").agg(F.sort_array(F.collect_list("path")).alias("paths"))
        runs = _merged(scratch, groups.select("shard", "paths", F.lit(None).cast("binary").alias("low"), F.lit(None).cast("binary").alias("high")))
    held = [r.asDict() for r in runs.select("path", "lines", "samples").collect()]  # at most fan_in rows
    keys = sorted(bytes(k) for r in held for k in r["samples"])
    want = shards or default_partitions(spark)
    cuts = sorted({keys[len(keys) * k // want] for k in range(1, want)}) if keys else []
    ranges = [(k, sorted(r["path"] for r in held), a, b) for k, (a, b) in enumerate(zip([None, *cuts], [*cuts, None], strict=True))] if held else []
    return _merged(scratch, spark.createDataFrame(ranges, schema))


def captures(index: DataFrame) -> DataFrame:
    """(shard, place, url_key, captured, page_id, file, offset, length): the merged index as rows; place: within the shard."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "place", "url_key", "captured", "page_id", "file", "offset", "length"]
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for b in batches:
            for shard, path in zip(b.column("shard").to_pylist(), b.column("path").to_pylist(), strict=True):
                rows: list[tuple] = []
                for place, line in enumerate(read_run(path)):
                    key, stamp, _, rest = line.decode().split(" ", 3)
                    d = json.loads(rest)
                    rows.append((shard, place, key, stamp, d["page"], d["file"], d["offset"], d["length"]))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    n = max(1, index.count())
    return index.select("shard", "path").repartition(n, "shard").mapInArrow(scan, "shard int, place long, url_key string, captured string, page_id long, file string, offset long, length long")


def read_records(found: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that rows of captures() point to, read from the archives at their places.

    (page_id, url_key, captured, payload_bytes, payload_digest, record_type, refers_to[, payload]). A response's size and
    digest are computed from its payload and must agree with its header; a revisit's come from its headers.
    """
    schema = "page_id long, url_key string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_files: dict[str, object] = {}

        def member(path: str, at: int, size: int) -> bytes:
            if path not in open_files:
                if len(open_files) >= FAN_IN:
                    open_files.pop(next(iter(open_files))).close()
                store, inner = open_store(path)
                open_files[path] = store.open_input_file(inner)
            return open_files[path].read_at(size, at)

        number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
        for b in batches:
            rows = []
            for key, stamp, path, at, size in zip(*(b.column(c).to_pylist() for c in ("url_key", "captured", "file", "offset", "length")), strict=True):
                warc, http, body = parse(member(path, at, size))
                digest, kind = warc["WARC-Payload-Digest"].removeprefix("sha256:"), warc["WARC-Type"]
                if kind == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(http["Content-Length"])):
                    raise ValueError(f"the record at {at} of {path} is damaged")
                rows.append((number(warc["WARC-Record-ID"]), key, stamp, int(http["Content-Length"]), digest, kind, number(warc["WARC-Refers-To"]) if kind == "revisit" else None, body))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns[: len(names)], kinds, strict=True)], names)

    return found.select("url_key", "captured", "file", "offset", "length").mapInArrow(scan, schema)
