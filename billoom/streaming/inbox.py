"""The inbox: which files have settled, reported once for each state of a file. As a replay over stored scans, and as a stream.

A scan is a list of rows (tick, path, size, mtime_ms); a row without a path says that a scan took place, which an empty folder's would not show
otherwise. A path is new at its first scan, and is reported when its size has stayed the same for ``settled`` scans after the first; then
it is handled and reported again only with another size or time. A path that is not in a scan is forgotten.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from billoom.operators import totals

#: Scans without a change after which a file is taken.
SETTLED = 2
OUT = "path string, tick long, size long, mtime_ms long"


def _tracked(scans: DataFrame, settled: int) -> tuple[DataFrame, DataFrame]:
    """The scans with what tells their stretch (_seen) and place (_n), and those among them that report: windows over each path's own scans.

    Reports come from stretches of scans without a gap. A handled file that is rewritten starts anew; so within a stretch a
    state is a run of equal (size, mtime_ms), split further where only the time changed before the file was handled.
    """
    path = Window.partitionBy("path").orderBy("tick")
    ticks = totals.numbered(scans.select("tick").distinct(), "tick", "_n")
    rows = scans.filter("path IS NOT NULL").join(ticks, "tick")
    gap = F.col("_n") - F.lag("_n").over(path)
    new = F.when(F.coalesce(gap, F.lit(0)) != 1, 1).otherwise(0)
    rows = rows.withColumn("_seen", F.sum(new).over(path.rowsBetween(Window.unboundedPreceding, 0)))
    # Runs of one size within a stretch; in a run, the scan that completes `settled` unchanged ones reports.
    w = Window.partitionBy("path", "_seen").orderBy("tick")
    rows = rows.withColumn("_size", F.sum(F.when(F.col("size").eqNullSafe(F.lag("size").over(w)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy("path", "_seen", "_size").orderBy("tick")
    rows = rows.withColumn("_at", F.row_number().over(w))
    # After a report the file waits; a change of time alone, at scan c, makes it a candidate again, with its first scan at c.
    touched = (F.col("_at") > 1) & ~F.col("mtime_ms").eqNullSafe(F.lag("mtime_ms").over(w))
    rows = rows.withColumn("_touched", touched)
    run = ["path", "_seen", "_size"]
    first = F.struct(F.lit(settled + 1).alias("last"), F.array(F.lit(settled + 1)).alias("out"))
    later = lambda a, p: F.when(p > a["last"], F.struct((p + settled).alias("last"), F.concat(a["out"], F.array(p + settled)).alias("out"))).otherwise(a)
    touches = rows.groupBy(*run).agg(F.array_sort(F.collect_list(F.when(F.col("_touched"), F.col("_at")))).alias("touches"))
    reports = touches.select(*run, F.explode(F.aggregate("touches", first, later, lambda a: a["out"])).alias("_at"))
    return rows, rows.join(reports, [*run, "_at"], "left_semi")


def settle_replay(scans: DataFrame, settled: int = SETTLED) -> DataFrame:
    """(path, tick, size, mtime_ms) of each report, from all scans at once."""
    return _tracked(scans, settled)[1].select("path", F.col("tick").cast("long").alias("tick"), F.col("size").cast("long").alias("size"), F.col("mtime_ms").cast("long").alias("mtime_ms"))


def pending(scans: DataFrame, settled: int = SETTLED) -> DataFrame:
    """(path) in order: files of the last scan that are waiting: not yet reported since they came, or changed since they were."""
    rows, reports = _tracked(scans, settled)
    done = reports.groupBy("path", "_seen").agg(F.max(F.struct("_n", "size", "mtime_ms")).alias("r"))
    changed = (F.col("_n") > F.col("r._n")) & ~(F.col("size").eqNullSafe(F.col("r.size")) & F.col("mtime_ms").eqNullSafe(F.col("r.mtime_ms")))
    waits = rows.join(done, ["path", "_seen"], "left").groupBy("path", "_seen").agg(F.max("tick").alias("tick"), F.bool_or(F.col("r").isNull() | changed).alias("waits"))
    return waits.join(F.broadcast(scans.agg(F.max("tick").alias("tick"))), "tick", "left_semi").filter("waits").select("path").orderBy("path")


def drained(scans: DataFrame, handled: DataFrame) -> DataFrame:
    """What one pass takes without waiting: each file of the last scan not handled in this state, in order of path."""
    last = scans.agg(F.max("tick").alias("tick"))
    now = scans.filter("path IS NOT NULL").join(F.broadcast(last), "tick", "left_semi")
    return now.join(handled.select("path", "size", "mtime_ms").distinct(), ["path", "size", "mtime_ms"], "left_anti").select("path", "tick", "size", "mtime_ms").orderBy("path")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "tick long, size long, still int, done_size long, done_mtime long"


class Settling(StatefulProcessor):
    """Of each path its last scan, last size, quiet scans and handled state. A timer set half a scan ahead removes what the next scan doesn't renew."""

    def __init__(self, settled: int):
        self.settled = settled

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, seen = [], pd.concat(list(rows)).sort_values("tick")
        if key[0]:
            was = self.file.get() if self.file.exists() else None
            tick, size, still, done_size, done_mtime = was or (None, None, 0, None, None)
            before = tick
            for r in seen.itertuples():
                if tick is not None and r.tick != tick + 1:
                    size, still, done_size, done_mtime = None, 0, None, None
                tick = int(r.tick)
                if size is None and (done_size, done_mtime) == (r.size, r.mtime_ms):
                    continue
                still = still + 1 if r.size == size else 0
                size = int(r.size)
                if still >= self.settled:
                    out.append((key[0], tick, int(r.size), int(r.mtime_ms)))
                    size, still, done_size, done_mtime = None, 0, int(r.size), int(r.mtime_ms)
            self.file.update((tick, size, still, done_size, done_mtime))
            if before is not None:
                self.handle.deleteTimer(1000 * before + 500)
            self.handle.registerTimer(1000 * tick + 500)
        yield pd.DataFrame(out, columns=["path", "tick", "size", "mtime_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.file.clear()
        yield pd.DataFrame([], columns=["path", "tick", "size", "mtime_ms"])

    def close(self) -> None:
        pass


def settle_stream(scans: DataFrame, settled: int = SETTLED) -> DataFrame:
    """settle_replay over a stream of scans, with keyed state that goes when its path goes.

    Event time is the number of the scan, in seconds: the watermark follows the scans, also those of an empty folder (rows without a path), and
    a path that they leave behind loses its state two scans later. Ticks of a stream must be numbered without gaps; a path that misses one starts
    anew. State is kept in RocksDB, which this sets for queries started from now on in the session.
    """
    scans.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = scans.select("tick", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("mtime_ms", F.lit(0)).alias("mtime_ms"), F.timestamp_seconds("tick").alias("at"))
    return timed.withWatermark("at", "0 seconds").groupBy("path").transformWithStateInPandas(Settling(settled), OUT, "Append", "EventTime")


def waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(path) in order: files that a stream holds as not settled, from its state as of its last batch."""
    state = spark.read.format("statestore").option("stateVarName", "file").load(checkpoint)
    return state.filter("value.size IS NOT NULL").select(F.col("key.path").alias("path")).orderBy("path")


def tracked(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(path, tick, size, still, done_size, done_mtime): all state of a stream as of its last batch."""
    return spark.read.format("statestore").option("stateVarName", "file").load(checkpoint).select("key.path", "value.*")


@dataclass
class Counters(StreamingQueryListener):
    """What an inbox has done: bills read and failed by batch results, reports and the last file by the stream's observed metrics."""

    processed: int = 0
    failed: int = 0
    reported: int = 0
    last_file: str = ""
    busy: bool = False
    _last: tuple[int, int, int] = field(default=(-1, 0, 0))

    def __post_init__(self):
        super().__init__()

    def add(self, batch_id: int, ok: int, failed: int) -> None:
        """A batch that is done again after a failure counts once."""
        if batch_id == self._last[0]:
            self.processed, self.failed = self.processed - self._last[1], self.failed - self._last[2]
        self.processed, self.failed, self._last = self.processed + ok, self.failed + failed, (batch_id, ok, failed)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get("inbox")
        if seen is not None and seen["reported"]:
            self.reported += seen["reported"]
            self.last_file = seen["last"]["path"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def run_inbox(reports: DataFrame, analyse: Callable[[DataFrame, int], DataFrame | None], checkpoint: str, drain: bool = False, interval: str = "", counters: Counters | None = None) -> StreamingQuery:
    """Start the stream of reports: each batch, one after the other, goes to analyse(batch, batch_id). drain: take what is there, then end.

    If analyse returns bills (with status), they are counted. interval: time between scans (as '300 milliseconds').
    """
    if counters is not None:
        reports.sparkSession.streams.addListener(counters)
        reports = reports.observe("inbox", F.count(F.lit(1)).alias("reported"), F.max(F.struct("tick", "path")).alias("last"))

    def each(batch: DataFrame, batch_id: int) -> None:
        if counters is not None:
            counters.busy = True
        try:
            bills = analyse(batch, batch_id)
            if bills is not None and counters is not None:
                told = bills.agg(F.count_if(totals.is_ok()).alias("ok"), F.count_if(~totals.is_ok()).alias("failed")).first()
                counters.add(batch_id, told["ok"], told["failed"])
        finally:
            if counters is not None:
                counters.busy = False

    writer = reports.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append")
    if interval:
        writer = writer.trigger(processingTime=interval)
    return (writer.trigger(availableNow=True) if drain else writer).start()


def status(query: StreamingQuery, checkpoint: str = "", counters: Counters | None = None) -> dict:
    """What a running inbox tells of itself; with its checkpoint the files that wait, with its counters what it has done."""
    last = query.lastProgress
    out = {"active": query.isActive, "batch": last["batchId"] if last else None, "rows": last["numInputRows"] if last else 0}
    if counters is not None:
        out |= {"busy": counters.busy, "processed": counters.processed, "failed": counters.failed, "reported": counters.reported, "last_file": counters.last_file}
    if checkpoint and last:
        out["pending"] = [r["path"] for r in waiting(SparkSession.active(), checkpoint).collect()]  # the files of one folder that are not settled
    return out
