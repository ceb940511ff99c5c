"""Tables written once: what is costly or may differ when made again (a model's answers) is written before it is read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share, or the folder given to setCheckpointDir; a temporary one on a local master alone."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="billoom-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{local}")
    return f"file://{local}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the cluster's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


@dataclass
class Stages:
    """Named tables in a folder. A job that runs again in the same folder reads what is complete and makes the rest."""

    spark: SparkSession
    folder: str = ""

    def __post_init__(self):
        self.folder = self.folder or f"{shared_folder(self.spark)}/stages-{uuid.uuid4().hex}"

    def keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """make()'s rows as written; not made again where the table is complete. One cut off is written anew."""
        path = f"{self.folder}/{name}"
        fs, done = hadoop_path(self.spark, f"{path}/_SUCCESS")
        if not fs.exists(done):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def drop(self) -> None:
        fs, at = hadoop_path(self.spark, self.folder)
        fs.delete(at, True)
