"""The inbox as a stream: scans that are read again as they were, state that ends, restarts, what it tells of itself."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F
from test_inbox_and_files import SCAN, SEEN, WANT, by_rule, scans

from billoom.sources import snapshots
from billoom.streaming import inbox


def until(done, seconds=150):
    end = time.time() + seconds
    while time.time() < end:
        if done():
            return True
        time.sleep(0.3)
    return False


def test_log_gives_the_same_rows_again(tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "FILES_A_PART", 2)
    box, log = tmp_path / "box", str(tmp_path / "log")
    box.mkdir()
    for k in range(5):
        (box / f"{k}.pdf").write_bytes(b"x" * k)
    r = snapshots._Reader(str(box), log)
    assert r.initialOffset() == {"tick": 0} and r.latestOffset() == {"tick": 1}
    parts = r.partitions({"tick": 0}, {"tick": 1})
    rows = [x for p in parts for x in r.read(p)]
    assert len(parts) == 3 and rows[0] == (1, None, None, None) and [x[2] for x in rows[1:]] == [0, 1, 2, 3, 4]
    (box / "0.pdf").unlink()
    (box / "4.pdf").write_bytes(b"longer than it was")
    # A reader after a restart: the same offsets, the same rows; new scans go on from the last number.
    again = snapshots._Reader(str(box), log)
    assert [x for p in again.partitions({"tick": 0}, {"tick": 1}) for x in again.read(p)] == rows
    assert again.latestOffset() == {"tick": 2} and len(again.partitions({"tick": 0}, {"tick": 2})) == 5 and len(again.partitions({"tick": 1}, {"tick": 2})) == 2
    again.commit({"tick": 2 + snapshots.SCANS_KEPT})
    assert again.log.ticks() == [2] and again.latestOffset() == {"tick": 3}
    for p in box.iterdir():
        p.unlink()
    assert again.latestOffset() == {"tick": 4} and [x for p in again.partitions({"tick": 3}, {"tick": 4}) for x in again.read(p)] == [(4, None, None, None)]


def test_killed_query_reads_the_same_scan(spark, tmp_path):
    box, seen = tmp_path / "box", []
    box.mkdir()
    (box / "a.pdf").write_bytes(b"123")
    spark.dataSource.register(snapshots.FolderScans)

    def run(fail):
        def each(df, n):
            seen.append((n, sorted((r["tick"], r["path"] and os.path.basename(r["path"]), r["size"]) for r in df.filter("path IS NOT NULL").collect())))
            if fail and n == 1:
                raise RuntimeError("killed")

        stream = spark.readStream.format("folder_scans").option("log", str(tmp_path / "log")).load(str(box))
        return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"file://{tmp_path}/c").trigger(processingTime="0 seconds").start()

    query = run(True)
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination(150)
    assert [n for n, _ in seen] == [0, 1]
    (box / "a.pdf").write_bytes(b"changed meanwhile")
    (box / "b.pdf").write_bytes(b"1")
    query = run(False)
    try:
        assert until(lambda: len(seen) >= 4)
    finally:
        query.stop()
    assert seen[2] == seen[1] and seen[1][1] == [(2, "a.pdf", 3)]
    assert [x[1] for x in seen[3][1]] == ["a.pdf", "b.pdf"] and seen[3][1][0][2] == len(b"changed meanwhile")


def test_restart_equals_replay(spark, tmp_path):
    """Scans in two portions with a restart between them; a heartbeat in every scan, some of which see nothing else."""
    more = {"lone": [None, None, None, (1, 1), (1, 1), None, (1, 1), (1, 1), (1, 1), None, None, (1, 1)], "early": [(2, 2)] * 3 + [None] * 9}
    rows = scans(spark).unionByName(spark.createDataFrame([(t, p, *s) for p, seen in more.items() for t, s in enumerate(seen, 1) if s], SCAN)).unionByName(spark.createDataFrame([(t, None, None, None) for t in range(1, 13)], SCAN))
    want = WANT | {(p, t) for p, seen in more.items() for t in by_rule(seen)}
    assert {(r["path"], r["tick"]) for r in inbox.settle_replay(rows).collect()} == want
    assert [r["path"] for r in inbox.pending(rows).collect()] == ["lone"]
    folder, got, checkpoint = tmp_path / "scans", [], f"file://{tmp_path}/checkpoint"

    def part(ticks):
        for t in ticks:
            rows.filter(F.col("tick") == t).coalesce(1).write.mode("append").parquet(f"file://{folder}")
            for p in folder.glob("*.parquet"):
                if p.stat().st_mtime > 1_700_001_000:
                    os.utime(p, (1_700_000_000 + t, 1_700_000_000 + t))
        stream = inbox.settle_stream(spark.readStream.schema(SCAN).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}"))
        query = inbox.run_inbox(stream, lambda df, n: got.extend((r["path"], r["tick"]) for r in df.collect()), checkpoint, drain=True)
        assert query.awaitTermination(300)
        return {r["path"] for r in inbox.tracked(spark, checkpoint).collect()}

    assert "early" not in part(range(1, 7)) and len(SEEN) > 0
    # At the end all that the scans no longer hold has gone from the state, and what waits is what the replay says.
    assert part(range(7, 13)) == {"lone"}
    assert sorted(got) == sorted(want) and [r["path"] for r in inbox.waiting(spark, checkpoint).collect()] == ["lone"]


def test_status_of_a_running_inbox(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    for name in ("a.pdf", "b.pdf", "bad.pdf"):
        (box / name).write_bytes(b"123")
    spark.dataSource.register(snapshots.FolderScans)
    checkpoint, counters = f"file://{tmp_path}/c", inbox.Counters()
    read = lambda df, n: df.select("path", F.when(F.col("path").contains("bad"), "error").otherwise("ok").alias("status"))
    query = inbox.run_inbox(inbox.settle_stream(spark.readStream.format("folder_scans").load(str(box))), read, checkpoint, counters=counters)
    try:
        assert until(lambda: counters.processed + counters.failed == 3 and counters.reported == 3)
        grows = [0]

        def waits():
            grows[0] += 1
            (box / "grows.pdf").write_bytes(b"x" * grows[0])
            return str(box / "grows.pdf") in inbox.status(query, checkpoint, counters).get("pending", ())

        assert until(waits)
        told = inbox.status(query, checkpoint, counters)
        assert (told["active"], told["processed"], told["failed"], told["last_file"]) == (True, 2, 1, str(box / "bad.pdf"))
        (box / "b.pdf").unlink()
        assert until(lambda: str(box / "b.pdf") not in {r["path"] for r in inbox.tracked(spark, checkpoint).collect()})
        assert str(box / "a.pdf") in {r["path"] for r in inbox.tracked(spark, checkpoint).collect()}
        assert until(lambda: counters.last_file == str(box / "grows.pdf"))
    finally:
        query.stop()
        spark.streams.removeListener(counters)
    assert counters.processed == 3 and not inbox.status(query)["active"]


def test_a_batch_done_again_counts_once():
    c = inbox.Counters()
    for batch, ok, failed in ((0, 2, 1), (1, 1, 0), (1, 1, 1), (2, 0, 0)):
        c.add(batch, ok, failed)
    assert (c.processed, c.failed) == (3, 2)
