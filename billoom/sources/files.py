"""Files as rows: scanning a folder with routing by suffix, their hashes, pages by a reader from the caller, text rows of a page.

What decodes PDF pages and images is not part of this package (no such library can be assumed): readers are functions from the caller.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from billoom.functions.scalars import base_name, suffix, text_of, trim

# Suffixes that are read.
IMAGES = ["jpg", "jpeg", "png", "webp", "tif", "tiff", "bmp"]
#: Mean characters a page from which the text layer is used.
TEXT_LAYER = 120


def route(path: Column) -> Column:
    """pdf, image or unsupported."""
    s = suffix(path)
    return F.when(s == "pdf", "pdf").when(s.isin(IMAGES), "image").otherwise("unsupported")


def supported(path: Column) -> Column:
    """Whether a file is read: by suffix in any case, and not hidden."""
    return (route(path) != "unsupported") & ~base_name(path).startswith(".")


def resolved(path: str) -> str:
    """Canonical if it exists, else absolute; empty stays empty."""
    return os.path.realpath(path) if path and os.path.exists(path) else os.path.abspath(path) if path else ""


def resolved_paths(path: Column) -> Column:
    """resolved() of a column, in the workers; null stays null. For local paths and those of a mounted file system."""
    return F.pandas_udf(lambda s: s.map(resolved, na_action="ignore"), "string")(path)


#: Bytes of a file that a worker holds while it hashes.
PIECE = 1 << 20
_STATE = "path string, size long, mtime_ms long, error string, sha256 string"


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:(//)?(?=/)", "")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def _state(path: str, hashed: bool) -> tuple:
    """(path, size, mtime_ms, error, sha256) of one file, read piece by piece; whatever is wrong is told, not raised."""
    from pyarrow import fs

    try:
        store, inner = _store(path)
        info = store.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            return path, None, None, "file does not exist", ""
        if info.type != fs.FileType.File:
            return path, None, None, "not a regular file", ""
        mtime = info.mtime_ns // 1_000_000 if info.mtime_ns is not None else None
        digest = hashlib.sha256()
        try:
            with store.open_input_stream(inner) as stream:
                while hashed and (piece := stream.read(PIECE)):
                    digest.update(piece)
        except OSError as e:
            return path, info.size, mtime, f"file is not readable: {e.strerror or e}", ""
        return path, info.size, mtime, "", digest.hexdigest() if hashed else ""
    except Exception as e:  # noqa: BLE001 such as a path that is no address
        return path, None, None, str(e), ""


def inspected(paths: DataFrame, hashed: bool = True) -> DataFrame:
    """(path, size, mtime_ms, kind, error, sha256) of paths(path): each is looked at and hashed in a worker, of any size, and no path ends the job.

    Errors: missing, not a regular file (a folder named x.pdf), unreadable, of a type that isn't read. sha256 is '' where there is an error of the
    first three kinds or hashed is off. Null paths are missing; repeated ones are looked at each.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [_state(p, hashed) if p else (p, None, None, "file does not exist", "") for p in b["path"]]
            yield pd.DataFrame(rows, columns=["path", "size", "mtime_ms", "error", "sha256"]).astype({"size": "Int64", "mtime_ms": "Int64"})

    # One file may take long, so they are dealt out singly.
    looked = paths.select("path").repartition(paths.sparkSession.sparkContext.defaultParallelism).mapInPandas(look, _STATE)
    name = _plain(F.col("path"))
    unread = F.concat(F.lit("unsupported file type '"), F.when(suffix(name) == "", "(none)").otherwise(suffix(name)), F.lit("'"))
    error = F.when(F.col("error") != "", F.col("error")).when(route(name) == "unsupported", unread).otherwise("")
    return looked.select(name.alias("path"), "size", "mtime_ms", route(name).alias("kind"), error.alias("error"), "sha256")


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of all that lies in a folder and those below it, folders left out; of a single file its path. Listed in a worker; what vanishes meanwhile doesn't matter."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            for top in b["path"]:
                store, inner = _store(top)
                waiting = [inner]
                if store.get_file_info(inner).type != fs.FileType.Directory:
                    yield pd.DataFrame({"path": [top]})
                    continue
                prefix = top[: len(top.rstrip("/")) - len(inner.rstrip("/"))] if top.rstrip("/").endswith(inner.rstrip("/")) else ""
                while waiting and isinstance(store, fs.LocalFileSystem):  # which would leave out links to nothing
                    inside = list(os.scandir(waiting.pop()))
                    waiting += [i.path for i in inside if i.is_dir(follow_symlinks=False)]
                    yield pd.DataFrame({"path": [prefix + i.path for i in inside if not i.is_dir(follow_symlinks=False)]}, dtype=object)
                while waiting:
                    inside = store.get_file_info(fs.FileSelector(waiting.pop(), allow_not_found=True))
                    waiting += [i.path for i in inside if i.type == fs.FileType.Directory]
                    yield pd.DataFrame({"path": [prefix + i.path for i in inside if i.type != fs.FileType.Directory]}, dtype=object)

    return spark.createDataFrame([(folder,)], "path string").mapInPandas(walk, "path string")


def scan(spark: SparkSession, path: str, hashed: bool = True) -> DataFrame:
    """inspected() of a folder's files, or of a single file, in order of name."""
    return inspected(entries(spark, path), hashed).orderBy("path")


def content_hash(content: Column) -> Column:
    """SHA-256 in hex; '' for what could not be read."""
    return F.coalesce(F.sha2(content, 256), F.lit(""))


@dataclass
class Page:
    """What a reader gives for a page: its text, its image with width and height, whether the text is the file's own, notes."""

    text: str | None = None
    jpeg: bytes | None = None
    width: int = 0
    height: int = 0
    from_text: bool = False
    notes: tuple[str, ...] = ()


PAGES = "path string, page int, page_count int, text string, error string, failed boolean, jpeg binary, width int, height int, from_text boolean, notes array<string>"


def read_pages(files: DataFrame, reader: Callable[[bytes], list[str | Page | Exception]], limit: int = 0) -> DataFrame:
    """PAGES of files(path, content, or path alone: then workers read the files): the first ``limit`` pages (0: all).

    A page that the reader gives as an exception keeps its number, with the error and no text. A file that the reader refuses, or that can't be
    read, is one failed row with its error; a file without pages too.
    """
    columns = [c.split()[0] for c in PAGES.split(", ")]

    def one(path: str, content: bytes | None) -> Iterator[tuple]:
        try:
            if content is None:
                store, inner = _store(path)
                with store.open_input_stream(inner) as stream:
                    content = stream.read()
            got = reader(content)
            if not got:
                raise ValueError("no pages")
        except Exception as e:  # noqa: BLE001 a bad file must not end the job; the row tells
            yield path, 1, 1, None, str(e), True, None, None, None, False, []
            return
        for k, x in enumerate(got[: limit or None], 1):
            p = x if isinstance(x, Page) else Page(text=None if isinstance(x, Exception) else x, from_text=isinstance(x, str))
            yield path, k, len(got), p.text, str(x) if isinstance(x, Exception) else "", False, p.jpeg, p.width or None, p.height or None, p.from_text, list(p.notes)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"] if "content" in b else [None] * len(b), strict=True):
                yield pd.DataFrame(one(path, content), columns=columns).astype({"width": "Int32", "height": "Int32"})

    return files.select("path", *(["content"] if "content" in files.columns else [])).mapInPandas(read, PAGES)


def pages(files: DataFrame, reader: Callable[[bytes], list[str | Page | Exception]], limit: int = 0) -> DataFrame:
    """(path, page, page_count, text, error) of read_pages()."""
    return read_pages(files, reader, limit).select("path", "page", "page_count", "text", "error")


def limited(pages_: DataFrame, limit: int) -> DataFrame:
    """The first pages of each file, with its page_count and how many the limit skipped; 0: all."""
    n = F.count("*").over(Window.partitionBy("path"))
    rows = pages_.withColumn("page_count", n).withColumn("skipped", F.greatest(F.lit(0), n - limit) if limit > 0 else F.lit(0).cast("bigint"))
    return rows.filter(F.col("page") <= limit) if limit > 0 else rows


def text_layer(pages_: DataFrame, threshold: int = TEXT_LAYER) -> DataFrame:
    """(path, pages, mean_chars, route): text where a file's pages (path, page, text) hold enough characters on average, else raster."""
    a = pages_.groupBy("path").agg(F.count("*").alias("pages"), (F.sum(F.length(text_of(F.col("text")))) / F.count("*")).alias("mean_chars"))
    return a.withColumn("route", F.when(F.col("mean_chars") >= threshold, "text").otherwise("raster"))


def text_or_error(documents: DataFrame) -> DataFrame:
    """documents(path, text) for those who want text alone: an error where there is none."""
    return documents.withColumn("error", F.when(trim(text_of(F.col("text"))) == "", "no text found").otherwise(""))


def extraction_report(documents: DataFrame) -> DataFrame:
    """(value): JSON of documents(path, kind, error, has_text_layer, bill_count, notes, text), one line each."""
    status = F.when(text_of(F.col("error")) == "", "ok").otherwise("error")
    fields = [base_name(F.col("path")).alias("file"), F.col("path"), F.col("kind"), status.alias("status"), F.nullif(text_of(F.col("error")), F.lit("")).alias("error"), F.col("has_text_layer"), F.col("bill_count"), F.length(text_of(F.col("text"))).alias("text_chars"), F.col("notes"), F.col("text")]
    return documents.select(F.to_json(F.struct(*fields)).alias("value"))


def layout_rows(boxes: DataFrame, near: float = 1.0) -> DataFrame:
    """(path, page, text): boxes of text (path, page, x0, y0, x1, y1, text) as lines: by height, then from the left; a wide gap is four spaces.

    Boxes stand at one height if their centres are within ``near`` points of each other. As that alone is no order (a near b, b near c, a
    not near c), heights are told apart where the sorted centres of a page step by more than ``near``: all that a chain of smaller steps
    joins is one height, read from the left (ties by right edge, then text).

    Whether a box opens a new line depends on the line so far, so each page's boxes come in order of their centres, sorted once, and are folded
    one after the other, a height being put in order when it is whole; pages are dealt to tasks, which hold a batch of boxes, a height and
    a page's lines. Boxes without text, or with an edge that is null or NaN, don't count.
    """
    mid = (F.col("y0") + F.col("y1")) / 2
    edges = F.col("x0") + F.col("x1") + F.col("y0") + F.col("y1")
    rows = boxes.filter(F.col("text").rlike(r"[^\s\p{Z}]") & edges.isNotNull() & ~F.isnan(edges))
    rows = rows.select("path", "page", "x0", "x1", trim(F.col("text")).alias("text"), mid.alias("mid"), F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")).alias("tall")).repartition("path", "page")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lines, height, mid, tall, right, before, out = None, [], [], 0.0, 1.0, 0.0, 0.0, []

        def settle() -> None:
            nonlocal mid, tall, right
            if len(height) > 1:
                height.sort()
            for x0, x1, text, m, t in height:
                larger = t if t > tall else tall
                if not lines or abs(m - mid) > 0.6 * larger:
                    lines.append(text)
                    mid, tall = m, t
                else:
                    lines[-1] += ("    " if x0 - right > 6 else " ") + text
                    tall = larger
                right = x1
            height.clear()

        def told() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))], ["path", "page", "text"])
            out.clear()
            return batch

        for b in batches:
            for path, page, x0, x1, text, m, t in zip(*[b.column(c).to_pylist() for c in ("path", "page", "x0", "x1", "text", "mid", "tall")], strict=True):
                if (path, page) != now:
                    if now:
                        settle()
                        out.append((*now, "\n".join(lines).strip()))
                    now, lines = (path, page), []
                elif m - before > near:
                    settle()
                height.append((x0, x1, text, m, t))
                before = m
            yield told()
        if now:
            settle()
            out.append((*now, "\n".join(lines).strip()))
            yield told()

    return rows.sortWithinPartitions("path", "page", "mid").mapInArrow(fold, "path string, page int, text string")


def orientation(data: bytes | None) -> int:
    """The EXIF orientation (1 to 8) of a JPEG's first 256 KiB; 0 where it names none."""
    data, at = (data or b"")[: 256 << 10], 2
    if data[:2] != b"\xff\xd8":
        return 0
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        part = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xE1 and part[:6] == b"Exif\0\0":
            tiff = part[6:]
            order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
            if order is None or len(tiff) < 8:
                return 0
            first = struct.unpack(order + "I", tiff[4:8])[0]
            count = struct.unpack(order + "H", tiff[first : first + 2])[0] if first + 2 <= len(tiff) else 0
            for entry in (tiff[first + 2 + 12 * k : first + 14 + 12 * k] for k in range(count)):
                if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == 0x0112:
                    value = struct.unpack(order + "H", entry[8:10])[0]
                    return value if 1 <= value <= 8 else 0
            return 0
        at += 2 + size
    return 0


def orientations(content: Column) -> Column:
    """orientation() of a binary column."""
    return F.pandas_udf(lambda s: s.map(orientation).astype("int32"), "int")(content)


#: What brings the pixels of an image with each orientation upright.
UPRIGHT = {2: np.fliplr, 3: lambda a: np.rot90(a, 2), 4: np.flipud, 5: lambda a: a.swapaxes(0, 1), 6: lambda a: np.rot90(a, -1), 7: lambda a: np.rot90(a, 2).swapaxes(0, 1), 8: np.rot90}


def upright(pixels: np.ndarray, orientation_: int) -> np.ndarray:
    return UPRIGHT.get(orientation_, lambda a: a)(pixels)


def upright_size(width: Column, height: Column, orientation_: Column) -> Column:
    """struct(width, height) of an image once upright."""
    turned = orientation_.between(5, 8)
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """Write each page's image of images(path, page, jpeg) as <base>-p<n>.jpg; a table (path, page, file) of what is written when it is run. Pages without an image are left out."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(folder)
        store.create_dir(inner, recursive=True)
        for b in batches:
            names = [f"{os.path.splitext(os.path.basename(p))[0]}-p{n}.jpg" for p, n in zip(b["path"], b["page"], strict=True)]
            for name, data in zip(names, b["jpeg"], strict=True):
                with store.open_output_stream(f"{inner}/{name}") as out:
                    out.write(data)
            yield pd.DataFrame({"path": b["path"], "page": b["page"], "file": names})

    return images.filter("jpeg IS NOT NULL AND octet_length(jpeg) > 0").select("path", "page", "jpeg").mapInPandas(write, "path string, page int, file string")


def archive(spark: SparkSession, verdicts: DataFrame, folder: str) -> list[tuple[str, str]]:
    """Move the originals of verdicts(path, archive) that may go to folder, never over another file (name-1.ext, ...). One run's files: small."""
    moved = []
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for r in verdicts.filter("archive").orderBy("path").collect():
        source = hadoop(r["path"])
        fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(hadoop(folder))
        stem, dot, ext = source.getName().rpartition(".")
        k, target = 0, hadoop(folder, source.getName())
        while fs.exists(target):
            k += 1
            target = hadoop(folder, f"{stem}-{k}.{ext}" if dot else f"{ext}-{k}")
        if fs.rename(source, target):
            moved.append((r["path"], target.toString()))
    return moved
