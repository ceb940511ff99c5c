"""Licence scan and archives on empty tables, ties, repeats, clashing columns, very long texts and odd payloads."""

from __future__ import annotations

import hashlib

from billoom.llm import licenses, warc

SCHEMA = "path string, text string, license int, score string, via int, from_dir int, term string, uid string"


def files(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 2, 3, "t", "u") for r in rows], SCHEMA)


def found(spark, rows, **kw):
    f = files(spark, rows)
    return sorted(((r["path"] or "", r["license"], r["via"], r["from_dir"]) for r in licenses.inherit(f, licenses.scan(f, **kw)).collect()))


def test_license_edges(spark):
    assert licenses.scan(files(spark, [])).count() == 0 and found(spark, []) == []
    rows = [("a/x.py", "This file is under two licenses of one text."), ("a/x.py", "Nothing."), ("b/LICENSE", "x" * 300_000 + "\nReleased under the MIT License.\n" + "word " * 60_000), ("b/c/d/y", ""), ("z", None)]
    tied = {"B-2": "This file is under two licenses of one text.", "A-1": "This file is under two licenses of one text."}
    assert found(spark, rows[:2], templates=tied) == [("a/x.py", "A-1", "own", None)] * 2
    assert found(spark, rows[2:]) == [("b/LICENSE", "MIT", "own", None), ("b/c/d/y", "MIT", "inherited", "b"), ("z", None, "none", None)]


def test_archive_edges(spark):
    long, crlf = "é" * 400_000, "head\r\n\r\nWARC/1.1\r\n\r\n" * 10
    rows = [(3, "http://a.b/", crlf), (1, "http://a.b/", crlf), (1, "http://a.b/", crlf), (None, "http://a.b/", crlf), (7, None, long), (8, "::", long), (9, "http://x/ y?b&a", "\x00"), (None, None, None)]
    pages = spark.createDataFrame([(*r, "c", 5, 6) for r in rows], "page_id long, url string, html string, digest string, payload int, `when` int").repartition(3)
    got = sorted(warc.read_records(warc.captures(warc.merge_index(warc.write_archives(pages))), with_payload=True).collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0, r["payload_bytes"]))
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in got] == [(1, "response", None), (1, "response", None), (3, "revisit", 1), (7, "response", None), (8, "revisit", 7), (9, "response", None), (None, "response", None), (None, "revisit", 1)]
    for r in got:
        data = {1: crlf, 3: crlf, 7: long, 8: long, 9: "\x00"}.get(r["page_id"], crlf if r["payload_bytes"] else "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest()) and (r["record_type"] == "revisit" or bytes(r["payload"]) == data)
