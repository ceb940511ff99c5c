"""What several operators share: the cluster's shared folder, tables in it, files in it."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the one given to setCheckpointDir.

    Only where the session names none and all runs on one machine (a local master, as in tests) a temporary folder is set.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="billoom-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{local}")
    return f"file://{local}"


#: By application, the folders that may still be read.
_OPEN: dict[str, list[Scratch]] = {}


def release(spark: SparkSession) -> None:
    """Delete all that operators left in the shared folder for this application; no result of theirs may be read after that."""
    for scratch in _OPEN.pop(spark.sparkContext.applicationId, []):
        scratch.drop(scratch.folder)


class Scratch:
    """A new folder in the shared one; tables written there cut the lineage of what is built on them.

    Results read these tables, so they stay until drop() or release().
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        _OPEN.setdefault(spark.sparkContext.applicationId, []).append(self)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and return it as read back."""
        path = self.path(name)
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._billoom_path = path
        return kept

    def drop(self, *tables: DataFrame | str) -> None:
        """Delete tables that keep() returned (or folders) and that nothing reads any more."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table if isinstance(table, str) else table._billoom_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def own_names(taken: list[str], *names: str) -> list[str]:
    """names, lengthened until none is among ``taken`` in any case: columns of an operator's own beside a caller's."""
    there, more = {c.lower() for c in taken}, ""
    while any((n + more).lower() in there for n in names):
        more += "_"
    return [n + more for n in names]


def boxed(rows: DataFrame):
    """All columns of rows as one struct, so that none can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in rows.columns])


def open_store(uri: str):
    """(file system, path) of a URI in the shared folder, for binary files that workers write and read."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return store, path


def write_whole(uri: str, write) -> None:
    """write(stream) to a hidden name, then move: a lost or repeated attempt leaves no half file under uri."""
    from pyarrow import fs

    store, path = open_store(uri)
    folder, _, name = path.rpartition("/")
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(hidden) as stream:
        write(stream)
    try:
        store.move(hidden, path)
    except OSError:
        # Stores that don't overwrite: another attempt of the task has left the same file.
        if store.get_file_info(path).type != fs.FileType.File:
            raise
        store.delete_file(hidden)


def save_arrays(uri: str, **arrays) -> None:
    """Named numpy arrays as one file."""
    import numpy as np

    data = io.BytesIO()
    np.savez(data, **arrays)
    write_whole(uri, lambda stream: stream.write(data.getbuffer()))


def load_arrays(uri: str):
    import numpy as np

    store, at = open_store(uri)
    with store.open_input_stream(at) as stream:
        return np.load(io.BytesIO(stream.read()))


def give_back() -> None:
    """Memory that this worker holds and does not use, to the system: workers are kept for later tasks, and count while they wait."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()  # malloc's, so numpy's too


#: Query blocks that follow one another on a shard in one task.
BLOCKS_A_TASK = 2


def search_pairs(shards: DataFrame, blocks: int) -> DataFrame:
    """(path, block) for each shards.path and block 0, 1, ... of a stated query set: what a search has to look at, dealt to tasks."""
    run = F.floor(F.col("block") / BLOCKS_A_TASK)
    pairs = shards.select("path", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    # Twice as many tasks as there are runs of blocks on a shard, so that few tasks get two of them.
    tasks = max(pairs.sparkSession.sparkContext.defaultParallelism, 2 * shards.count() * -(-blocks // BLOCKS_A_TASK))
    return pairs.repartition(tasks, "path", run).sortWithinPartitions("path", "block")


#: Rows of texts that a worker turns into Python objects at a time.
TEXT_ROWS = 500


def few_rows(batches):
    """The batches in slices of TEXT_ROWS, so that long texts don't stand in a worker twice."""
    for b in batches:
        for at in range(0, b.num_rows, TEXT_ROWS):
            yield b.slice(at, TEXT_ROWS)


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
