"""Boxes to lines against a plain version, and the scan that never raises."""

from __future__ import annotations

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from billoom.sources import files

BOXES = "path string, page int, x0 double, y0 double, x1 double, y1 double, text string"


def plain(boxes):
    """Heights by steps of over a point between sorted centres, then from the left; the rest as the line so far decides."""
    rows = sorted(((y0 + y1) / 2, x0, x1, t.strip(), max(1.0, y1 - y0)) for x0, y0, x1, y1, t in boxes if t and t.strip())
    heights, before = [], None
    for r in rows:
        if before is None or r[0] - before > 1:
            heights.append([])
        heights[-1].append(r)
        before = r[0]
    out, mid, tall, right = "", 0.0, 1.0, 0.0
    for m, x0, x1, t, h in (r for hs in heights for r in sorted(hs, key=lambda r: (r[1], r[2], r[3]))):
        if not out or abs(m - mid) > 0.6 * max(tall, h):
            out, mid, tall = out + ("\n" if out else "") + t, m, h
        else:
            out, tall = out + ("    " if x0 - right > 6 else " ") + t, max(tall, h)
        right = x1
    return out


@pytest.mark.parametrize("a, b", [(10.4, 10.6), (5.4, 5.6), (5.49, 6.49), (0.5, 1.5)])
def test_one_height_stands_from_the_left(spark, a, b):
    rows = [("f", 1, 300.0, a - 5, 340.0, a + 5, "right"), ("f", 1, 10.0, b - 5, 50.0, b + 5, "left")]
    assert files.layout_rows(spark.createDataFrame(rows, BOXES)).first()["text"] == "left    right"


def test_random_pages(spark):
    draw, rows = random.Random(3), []
    for page in range(60):
        for k in range(draw.randrange(1, 40)):
            y, x, h = draw.choice([10, 24, 38]) + draw.choice([0, 0.2, 0.49, 0.5, 0.51, 0.9, 1.0, 1.1, 4]), draw.randrange(0, 500), draw.choice([0.5, 8, 10, 14])
            rows.append(("f", page, float(x), y - h / 2, x + 20.0, y + h / 2, draw.choice(["a", " b ", f"w{k}", ""])))
    got = {r["page"]: r["text"] for r in files.layout_rows(spark.createDataFrame(rows, BOXES).repartition(7)).collect()}
    want = {p: plain([r[2:] for r in rows if r[1] == p]) for p in range(60)}
    assert got == {p: t for p, t in want.items() if t}


def test_odd_boxes(spark):
    rows = [("f", 1, None, 0.0, 1.0, 1.0, "null"), ("f", 1, 0.0, float("nan"), 1.0, 1.0, "nan"), ("f", 1, 0.0, 0.0, 1.0, 1.0, None), ("f", 1, 0.0, 0.0, 1.0, 1.0, "x"), ("f", 1, 0.0, 0.0, 1.0, 1.0, "x"), (None, None, 0.0, 0.0, 1.0, 1.0, "y"), (None, None, 0.0, 0.0, 1.0, 1.0, "z")]
    assert {tuple(r) for r in files.layout_rows(spark.createDataFrame(rows, BOXES).withColumn("mid", F.lit(1)).withColumn("step", F.lit("s"))).collect()} == {("f", 1, "x x"), (None, None, "y z")}
    assert files.layout_rows(spark.createDataFrame([], BOXES)).count() == 0


def test_scan_never_raises(spark, tmp_path):
    box = tmp_path / "in"
    (box / "sub").mkdir(parents=True)
    (box / "folder.pdf").mkdir()
    big = os.urandom(1 << 20) * 3 + b"end"
    (box / "big.pdf").write_bytes(big)
    (box / "sub" / "note.txt").write_bytes(b"2")
    (box / "lost.pdf").symlink_to(box / "nothing")
    (box / "broken.pdf").symlink_to("/proc/self/mem")  # a regular file that can't be read
    os.mkfifo(box / "pipe.pdf")
    rows = {r["path"].rpartition("/")[2]: r for r in files.scan(spark, f"file://{box}").collect()}
    assert sorted(rows) == ["big.pdf", "broken.pdf", "lost.pdf", "note.txt", "pipe.pdf"]
    assert rows["big.pdf"]["sha256"] == hashlib.sha256(big).hexdigest() and rows["big.pdf"]["size"] == len(big) and rows["big.pdf"]["error"] == ""
    assert rows["lost.pdf"]["error"] == "file does not exist" and rows["pipe.pdf"]["error"] == "not a regular file" and rows["broken.pdf"]["error"].startswith("file is not readable") and rows["note.txt"]["error"] == "unsupported file type 'txt'"
    asked = spark.createDataFrame([(str(box / "folder.pdf"),), ("/no/where.pdf",), (None,), (str(box / "big.pdf"),), (str(box / "big.pdf"),), ("nofs://x/y.pdf",)], "path string")
    got = files.inspected(asked, hashed=False).collect()
    assert sorted(str(r["error"])[:20] for r in got if r["path"] != "nofs://x/y.pdf") == ["", "", "file does not exist", "file does not exist", "not a regular file"] and all(r["sha256"] == "" for r in got)
    assert [r["error"] != "" for r in got if r["path"] == "nofs://x/y.pdf"] == [True] and files.scan(spark, str(box / "big.pdf")).count() == 1
    assert [r[0] for r in spark.createDataFrame([(f"{box}/../in/a.x",), (None,), ("",)], "p string").select(files.resolved_paths(F.col("p"))).collect()] == [f"{box}/a.x", None, ""]


def test_failed_pages_keep_their_number(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    asked = spark.createDataFrame([(str(tmp_path / "a.pdf"),), (str(tmp_path / "none.pdf"),)], "path string")
    reader = lambda data: ["one", ValueError("no image"), files.Page("three", b"jpg", 10, 20, True, ("note",))]
    got = {(r["path"].rpartition("/")[2], r["page"]): (r["page_count"], r["text"], r["error"], r["failed"], r["width"], r["notes"]) for r in files.read_pages(asked, reader).collect()}
    assert got[("a.pdf", 1)] == (3, "one", "", False, None, []) and got[("a.pdf", 2)] == (3, None, "no image", False, None, []) and got[("a.pdf", 3)] == (3, "three", "", False, 10, ["note"])
    assert len(got) == 4 and got[("none.pdf", 1)][3] and got[("none.pdf", 1)][2]
