"""What the store writes and reads: buckets, filters and zone maps, two writers at once, retired files."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest

from billoom.operators import store
from test_store import bills, documents


def files(folder: Path) -> set[str]:
    return {str(p.relative_to(folder)) for p in folder.rglob("*.parquet") if "/filters/" not in str(p)}


def held(s):
    return {(r["sha256"], r["page"], r["vendor"]) for r in s.bills().collect()}, {(r["sha256"], r["fingerprint"]) for r in s.documents().collect()}


@pytest.fixture
def large(spark, tmp_path):
    """2000 documents in 64 buckets, two bills each."""
    s = store.Store(spark, f"file://{tmp_path}/db")
    rows = spark.range(2000).selectExpr("sha2(string(id), 256) AS sha256", "'a' AS fingerprint", "'/in/x' AS source_path", "concat(id, '.pdf') AS file_name", "2 AS page_count", "true AS has_text_layer", "'m' AS model", "format_string('2025-01-%04d', id) AS created_at")
    names = [f.split()[0] for f in store.BILLS.split(", ")]
    two = rows.selectExpr("sha256", "explode(array(1, 2)) AS page", "'ok' AS status", "file_name AS vendor", "created_at", *[f"CAST(NULL AS {t}) AS {n}" for n, t in (f.split() for f in store.BILLS.split(", ")) if n not in ("sha256", "page", "status", "vendor", "created_at")]).select(*names)
    s.save(rows, two)
    return s


def test_one_document_writes_one_bucket(spark, tmp_path, large):
    before, m = files(tmp_path / "db"), large.manifest()
    assert len(before) == 128 == len(m["files"]) and sum(f["rows"] for f in m["files"] if f["table"] == "bills") == 4000
    sha = large.documents().first()["sha256"]
    large.save(documents(spark, (sha, "b", "2026-01")), bills(spark, (sha, 1, "new")))
    after = large.manifest()
    fresh = [f for f in after["files"] if f not in m["files"]]
    # The new rows' file and the old file without them, of each table; 126 files stay as they are.
    assert len(fresh) == 4 and len({f["bucket"] for f in fresh}) == 1 and len([f for f in after["files"] if f in m["files"]]) == 126
    assert large.bills().count() == 3999 and large.documents().count() == 2000 and [r["vendor"] for r in large.bills_of(sha).collect()] == ["new"]
    assert large.find(sha, "b").count() == 1 and large.find(sha, "a").count() == 0
    # The version before stays for its readers until the write after.
    assert before <= files(tmp_path / "db")
    large.forget(spark.createDataFrame([("none",)], "sha256 string"))
    assert len(before - files(tmp_path / "db")) == 2 and large.bills().count() == 3999


def test_probe_reads_no_file_for_misses(spark, tmp_path, large):
    """With the files of documents taken away a probe of misses answers all the same."""
    hidden, moved = tmp_path / "hidden", []
    hidden.mkdir()
    for k, p in enumerate(sorted((tmp_path / "db").glob("files/*/new/documents/*/*.parquet"))):
        p.rename(hidden / str(k))
        moved.append(p)
    assert len(moved) == 64 and large.probe(spark.createDataFrame([("none1", "a"), ("none2", "a")], "sha256 string, fingerprint string")).filter("hit").count() == 0


def test_filter():
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000)
    inside, outside = hashes[:10_000], hashes[10_000:]
    assert store.in_bloom(store.bloom(inside), inside).all() and store.in_bloom(store.bloom(inside), outside).mean() < 0.02
    assert store.bloom(inside[:0]) == b"" and not store.in_bloom(b"", outside).any()


def test_probe(spark, large):
    stored = [r["sha256"] for r in large.documents().limit(50).collect()]
    large.save(documents(spark, ("bare", "a", "2026")), bills(spark))
    rows = [(1, h, "a") for h in stored] + [(2, h, "b") for h in stored] + [(3, "bare", "a"), (4, "", "a"), (5, None, "a"), (6, stored[0], None), (1, stored[0], "a")] + [(7, f"x{k}", "a") for k in range(200)]
    asked = spark.createDataFrame(rows, "n int, sha256 string, fingerprint string")
    got = large.probe(asked)
    assert sorted((r["n"], r["hit"]) for r in got.collect()) == sorted((n, n == 1) for n, *_ in rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan  # stored rows are not shuffled
    assert [tuple(r) for r in store.cache_probe(asked, large.documents(), large.bills()).groupBy("n", "hit").count().orderBy("n").collect()] == [tuple(r) for r in got.groupBy("n", "hit").count().orderBy("n").collect()]
    empty = store.Store(spark, large.folder + "-none")
    assert empty.probe(asked).filter("hit").count() == 0


def test_history_leaves_old_files_unread(spark, large):
    for k in range(3):
        large.save(documents(spark, (f"n{k}", "a", f"2026-0{k}")), bills(spark, (f"n{k}", 1, f"v{k}")).replace("2025", f"2026-0{k}", ["created_at"]))
    assert [r["vendor"] for r in large.history(3).collect()] == ["v2", "v1", "v0"] and large.files_read < 10
    for k in (0, 1, 4, 70, 4003, 5000):
        got = [(r["created_at"], r["page"], r["vendor"]) for r in large.history(k).collect()]
        want = [(r["created_at"], r["page"], r["vendor"]) for r in store.history(large.numbered_bills(), large.documents(), k).collect()]
        assert got == want and len(got) == min(k, 4003)


def test_history_with_bills_without_documents(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/db", buckets=4)
    s.save(documents(spark, *[(f"h{k}", "a", "2025") for k in range(5)]), bills(spark, *[(f"h{k}", 1, f"v{k}") for k in range(5)], *[(f"lost{k}", 1, "z") for k in range(20)]))
    assert sorted(r["vendor"] for r in s.history(4).collect()) == sorted(r["vendor"] for r in store.history(s.numbered_bills(), s.documents(), 4).collect()) and s.history(9).count() == 5


def test_two_writers(spark, tmp_path, monkeypatch):
    """The slower of two finds its number taken, merges again and loses nothing; one that may not try again leaves no file."""
    s = store.Store(spark, f"file://{tmp_path}/db", buckets=2)
    s.save(documents(spark, ("h1", "a", "1")), bills(spark, ("h1", 1, "X"), ("h1", 2, "Y")))
    other, merged, once = store.Store(spark, s.folder), store.Store._merged, []

    def slow(self, *a):
        out = merged(self, *a)
        if self is s and not once:
            once.append(1)
            other.save(documents(spark, ("h1", "b", "2"), ("h2", "b", "2")), bills(spark, ("h1", 1, "O"), ("h2", 1, "O")))
        return out

    monkeypatch.setattr(store.Store, "_merged", slow)
    s.save(documents(spark, ("h3", "c", "3"), ("h1", "c", "3")), bills(spark, ("h3", 1, "S"), ("h1", 3, "S")))
    assert held(s) == ({("h1", 3, "S"), ("h2", 1, "O"), ("h3", 1, "S")}, {("h1", "c"), ("h2", "b"), ("h3", "c")}) and s.manifest()["number"] == 3
    once.clear()
    monkeypatch.setattr(store, "ATTEMPTS", 1)
    with pytest.raises(store.Conflict):
        s.save(documents(spark, ("h4", "c", "4")), bills(spark, ("h4", 1, "S")))
    assert ("h4", "c") not in held(s)[1] and ("h2", "b") in held(s)[1]
    named = {f["path"] for n in (s.manifest()["number"], s.manifest()["number"] - 1) for f in s.manifest(n)["files"]}
    assert files(tmp_path / "db") == named
    s.clean()  # folders that replaced files have left empty
    assert files(tmp_path / "db") == named
    (tmp_path / "db" / "files" / "w-lost").mkdir()
    assert s.clean() == 1


def test_many_writes_are_merged(spark, tmp_path):
    s, want = store.Store(spark, f"file://{tmp_path}/db", buckets=1), {}
    draw = random.Random(1)
    for k in range(12):
        h = f"h{draw.randrange(4)}" if k % 3 == 0 else f"n{k}"
        s.save(documents(spark, (h, f"f{k}", f"{k:02}")), bills(spark, (h, 1, f"v{k}")))
        want[h] = f"v{k}"
    assert {h: v for h, _, v in held(s)[0]} == want
    assert max(sum(f["table"] == t for f in s.manifest()["files"]) for t in ("documents", "bills")) <= store.MOST_FILES + 1


def test_a_named_inbox_is_never_emptied(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/db")
    for name in ("archive/a", "inbox/c", "own/inbox/d"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    told = s.wipe(f"file://{tmp_path}/archive", f"file://{tmp_path}/inbox", confirmed=True, named=f"{tmp_path}/inbox/")
    assert told["archived"] == 1 and told["waiting"] == 0 and (tmp_path / "inbox" / "c").exists()
    assert s.wipe(f"{tmp_path}/archive", f"{tmp_path}/own", confirmed=True, named=f"file://{tmp_path}/own/inbox")["waiting"] == 0 and (tmp_path / "own/inbox/d").exists()
    assert s.wipe(f"{tmp_path}/archive", f"{tmp_path}/own/inbox", confirmed=True, named=f"{tmp_path}/inbox")["waiting"] == 1
