"""A folder as an unbounded stream of scans, as rows (tick, path, size, mtime_ms), and a row without a path for each scan that says that it took place.

Each scan is written to a log before its number is given as an offset, and rows are read from the log alone: after a restart the same
offsets give the same rows, whatever has happened to the files.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "tick long, path string, size long, mtime_ms long"
#: Files of a scan that a task reads, and scans that stay in the log after they have been read.
FILES_A_PART, SCANS_KEPT = 50_000, 100
# Suffixes that are read.
SUFFIXES = (".pdf", ".jpg", ".jpeg", ".png", ".webp", ".tif", ".tiff", ".bmp")


def listing(folder: str) -> list[tuple[str, int, int]]:
    """(path, size, mtime in ms) of the folder's plain files of a known suffix in order of name; hidden ones and links don't count."""
    out = []
    with os.scandir(folder) as entries:
        for e in sorted(entries, key=lambda e: e.name):
            if e.is_file(follow_symlinks=False) and not e.name.startswith(".") and e.name.lower().endswith(SUFFIXES):
                s = e.stat()
                out.append((os.path.abspath(e.path), s.st_size, s.st_mtime_ns // 1_000_000))
    return out


@dataclass
class Part(InputPartition):
    """One file of the log."""

    path: str
    tick: int


class ScanLog:
    """Scans in a folder: tick-<number>/part-<k>.json, moved there when whole."""

    def __init__(self, folder: str):
        self.folder = folder

    def ticks(self) -> list[int]:
        return sorted(int(n[5:]) for n in os.listdir(self.folder) if n.startswith("tick-")) if os.path.isdir(self.folder) else []

    def _at(self, tick: int) -> str:
        return f"{self.folder}/tick-{tick:012d}"

    def add(self, tick: int, files: list[tuple[str, int, int]]) -> None:
        hidden = f"{self.folder}/.{uuid.uuid4().hex}"
        os.makedirs(hidden)
        for k in range(max(1, -(-len(files) // FILES_A_PART))):
            with open(f"{hidden}/part-{k:06d}.json", "w") as out:
                json.dump(files[k * FILES_A_PART : (k + 1) * FILES_A_PART], out)
        os.rename(hidden, self._at(tick))

    def parts(self, after: int, until: int) -> list[Part]:
        return [Part(f"{self._at(t)}/{n}", t) for t in self.ticks() if after < t <= until for n in sorted(os.listdir(self._at(t)))]

    def forget(self, until: int) -> None:
        """Drop scans up to a number, but never the latest, from which the numbers go on."""
        for t in self.ticks()[:-1]:
            if t <= until:
                for n in os.listdir(self._at(t)):
                    os.remove(f"{self._at(t)}/{n}")
                os.rmdir(self._at(t))


class _Reader(DataSourceStreamReader):
    """The offset is the number of the latest scan. A new scan is made each time that Spark asks for the latest offset."""

    def __init__(self, folder: str, log: str):
        self.folder, self.log = folder, ScanLog(log)

    def initialOffset(self) -> dict:
        return {"tick": 0}

    def latestOffset(self) -> dict:
        tick = max(self.log.ticks(), default=0) + 1
        self.log.add(tick, listing(self.folder))
        return {"tick": tick}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.log.parts(start["tick"], end["tick"])

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.path.endswith("part-000000.json"):
            yield (partition.tick, None, None, None)
        with open(partition.path) as lines:
            for path, size, mtime in json.load(lines):
                yield (partition.tick, path, size, mtime)

    def commit(self, end: dict) -> None:
        self.log.forget(end["tick"] - SCANS_KEPT)


class FolderScans(DataSource):
    """spark.dataSource.register(FolderScans); spark.readStream.format("folder_scans").load(folder). The trigger's interval is the time between scans.

    Option log: the folder of the log, .scans in the folder itself if it isn't given. Both are on a file system that driver and executors mount.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_scans"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        folder = self.options["path"]
        return _Reader(folder, self.options.get("log") or f"{folder}/.scans")
