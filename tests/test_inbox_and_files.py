"""The inbox as a replay and as a stream, and files, pages and boxes."""

from __future__ import annotations

import os
import struct

import pytest
from pyspark.sql import functions as F

from billoom.operators import totals
from billoom.sources import files
from billoom.streaming import inbox

SCAN = "tick long, path string, size long, mtime_ms long"
# By path what each scan sees: (size, mtime), or None where the file is not there.
SEEN = {
    "static": [(5, 1)] * 8,
    "grows": [(1, 1), (2, 2), (3, 3), (3, 3), (3, 3), (3, 3), (3, 3), (3, 3)],
    "vanishes": [(1, 1), (1, 1), None, (1, 1), (1, 1), (1, 1), None, (1, 1)],
    "edited": [(4, 1), (4, 1), (4, 1), (4, 2), (4, 2), (4, 2), (9, 3), (9, 3)],
    "touched": [(4, 1), (4, 2), (4, 3), (4, 3), (4, 4), (4, 5), (4, 6), (4, 6)],
    "back": [(4, 1), (4, 1), (4, 1), (7, 2), (4, 1), (4, 1), (4, 1), (4, 1)],
}
WANT = {("static", 3), ("grows", 5), ("vanishes", 6), ("edited", 3), ("edited", 6), ("touched", 3), ("touched", 7), ("back", 3), ("back", 7)}


def scans(spark):
    rows = [(t, p, *s) for p, seen in SEEN.items() for t, s in enumerate(seen, 1) if s]
    return spark.createDataFrame(rows, SCAN)


def by_rule(seen):
    """The scans of one path in order: candidate's size and quiet scans, handled state."""
    size, still, done, out = None, 0, None, []
    for t, s in enumerate(seen, 1):
        if s is None:
            size, still, done = None, 0, None
        elif size is not None or s != done:
            still, size = (still + 1 if s[0] == size else 0), s[0]
            if still == inbox.SETTLED:
                out.append(t)
                size, still, done = None, 0, s
    return out


def test_replay(spark):
    assert {(p, t) for p, seen in SEEN.items() for t in by_rule(seen)} == WANT
    reports = inbox.settle_replay(scans(spark))
    assert {(r["path"], r["tick"]) for r in reports.collect()} == WANT
    assert [r["path"] for r in inbox.pending(scans(spark)).collect()] == ["edited", "vanishes"]
    assert inbox.settle_replay(scans(spark).limit(0)).count() == 0
    done = spark.createDataFrame([(1, "static", 5, 1)], SCAN)
    assert [r["path"] for r in inbox.drained(scans(spark), done).collect()] == ["back", "edited", "grows", "touched", "vanishes"]


def test_stream_equals_replay(spark, tmp_path):
    folder, got = tmp_path / "scans", []
    for t in range(1, 9):
        scans(spark).filter(F.col("tick") == t).coalesce(1).write.mode("append").parquet(f"file://{folder}")
    for k, f in enumerate(sorted((p for p in folder.glob("*.parquet")), key=os.path.getmtime)):
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = inbox.settle_stream(spark.readStream.schema(SCAN).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}"))
    query = inbox.run_inbox(stream, lambda df, n: got.extend((r["path"], r["tick"]) for r in df.collect()), f"file://{tmp_path}/checkpoint", drain=True)
    query.awaitTermination(300)
    assert sorted(got) == sorted(WANT) and not inbox.status(query)["active"]


def test_scan_and_archive(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    for name, data in (("a.PDF", b"1"), ("b.txt", b"2"), ("c.JPeG", b"3"), ("noext", b"4")):
        (box / name).write_bytes(data)
    got = files.scan(spark, f"file://{box}").collect()
    assert [(r["path"].rpartition("/")[2], r["kind"], r["error"]) for r in got] == [("a.PDF", "pdf", ""), ("b.txt", "unsupported", "unsupported file type 'txt'"), ("c.JPeG", "image", ""), ("noext", "unsupported", "unsupported file type '(none)'")]
    assert got[0]["sha256"] == "6b86b273ff34fce19d6b804eff5a3f5747ada4eaa22f1d49c01e52ddb7875b4b" and got[0]["size"] == 1
    assert [r[0] for r in spark.createDataFrame([("/x/.a.pdf",), ("a.tif",), ("a.pdf.txt",)], "p string").select(files.supported(F.col("p"))).collect()] == [False, True, False]
    bills = spark.createDataFrame([(f"file://{box}/a.PDF", "ok"), (f"file://{box}/c.JPeG", "ok"), (f"file://{box}/c.JPeG", "error")], "path string, status string")
    (tmp_path / "done").mkdir()
    (tmp_path / "done" / "a.PDF").write_bytes(b"old")
    files.archive(spark, totals.archivable(bills), f"file://{tmp_path}/done")
    assert sorted(p.name for p in (tmp_path / "done").glob("*.PDF")) == ["a-1.PDF", "a.PDF"] and (tmp_path / "done" / "a.PDF").read_bytes() == b"old" and (box / "c.JPeG").exists()
    assert files.resolved("") == "" and files.resolved(f"{box}/../in/a.x") == f"{box}/a.x"


def test_pages(spark):
    contents = spark.createDataFrame([("a", bytearray(b"one|two|three")), ("b", bytearray(b"!"))], "path string, content binary")

    def reader(data):
        if data == b"!":
            raise ValueError("damaged")
        return bytes(data).decode().split("|")

    assert sorted(map(tuple, files.pages(contents, reader, 2).collect())) == [("a", 1, 3, "one", ""), ("a", 2, 3, "two", ""), ("b", 1, 1, None, "damaged")]
    rows = spark.createDataFrame([("a", 1, "x" * 200), ("a", 2, None), ("b", 1, "x" * 119)], "path string, page int, text string")
    assert {tuple(r) for r in files.text_layer(rows).collect()} == {("a", 2, 100.0, "raster"), ("b", 1, 119.0, "raster")}
    assert {(r["path"], r["page"], r["page_count"], r["skipped"]) for r in files.limited(rows, 1).collect()} == {("a", 1, 2, 1), ("b", 1, 1, 0)}
    assert files.text_layer(rows.limit(0)).count() == 0


def test_layout(spark):
    boxes = [("f", 1, 0.0, 0.0, 20.0, 20.0, "Head"), ("f", 1, 60.0, 12.0, 80.0, 20.0, "far"), ("f", 1, 22.0, 6.0, 40.0, 16.0, "near"), ("f", 1, 0.0, 40.0, 9.0, 50.0, "next"), ("f", 1, 0.0, 60.0, 9.0, 70.0, "  "), ("f", 2, 0.0, 0.0, 1.0, 1.0, "p2")]
    got = files.layout_rows(spark.createDataFrame(boxes, "path string, page int, x0 double, y0 double, x1 double, y1 double, text string"))
    assert {tuple(r) for r in got.collect()} == {("f", 1, "Head near    far\nnext"), ("f", 2, "p2")}


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("value", [1, 6, 8, 9])
def test_orientation(spark, order, value):
    tiff = {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(order + "IH", 8, 2) + struct.pack(order + "HHIHH", 0x0100, 3, 1, 5, 0) + struct.pack(order + "HHIHH", 0x0112, 3, 1, value, 0)
    app1 = b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"JF" + b"\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xda"
    assert files.orientation(jpeg) == (value if value <= 8 else 0)
    assert [files.orientation(x) for x in (b"", None, b"\x89PNG", jpeg[:30], b"\xff\xd8\xff\xda")] == [0] * 5
    rows = spark.createDataFrame([(bytearray(jpeg),), (None,)], "c binary")
    assert [r[0] for r in rows.select(files.orientations(F.col("c"))).collect()] == [value if value <= 8 else 0, 0]
