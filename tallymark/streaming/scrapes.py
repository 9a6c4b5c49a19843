"""Landed scrapes as a stream that knows what is due.

A landed scrape is a folder root/target=<name>/due=<seconds>[-<seconds it took>] of text files
with the exposition's lines. The source's offset is a due time: a micro-batch covers all
targets at all due times since the one before, whether something has landed or not. A
target without a landed scrape is a row with up = 0, so a missed scrape is part of the
stream and not a gap to be guessed later. Offsets are kept by the stream's state folder: a
resumed run goes on at the next due time.

Tasks read their own targets' folders; the driver lists the newest due time alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tallymark.functions import ship_by_value
from tallymark.sources.listing import opened

ship_by_value(__name__)

SCHEMA = "target string, due_s long, up int, took_s double, lines array<string>"
#: Due times that one task takes for a target.
STRETCH = 4096
_DUE = re.compile(r"due=([0-9]+)(?:-([0-9.]+))?$")


class Stretch(InputPartition):
    """Due times of a target: first, last (both in it)."""

    def __init__(self, target: str, first: int, last: int):
        self.target, self.first, self.last = target, first, last


class ScrapeReader(DataSourceStreamReader):
    def __init__(self, path: str, targets: list[str], every: int, start: int):
        self.path, self.targets, self.every, self.start = path, targets, every, start

    def _landed(self, target: str) -> dict[int, tuple[str, float | None]]:
        """Folder and duration by due time."""
        system, top, _ = opened(self.path)
        folder = fs.FileSelector(f"{top}/target={target}", allow_not_found=True)
        found = {}
        for info in system.get_file_info(folder):
            if (m := _DUE.search(info.base_name)) and info.type == fs.FileType.Directory:
                found[int(m[1])] = (info.path, float(m[2]) if m[2] else None)
        return found

    def initialOffset(self) -> dict:
        return {"due": self.start - self.every}

    def latestOffset(self) -> dict:
        newest = max((max(self._landed(target), default=self.start - self.every) for target in self.targets), default=0)
        # A due time on the grid; what lands beside it counts to the one before.
        return {"due": self.start + (newest - self.start) // self.every * self.every}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        wide = self.every * STRETCH
        return [
            Stretch(target, first, min(first + wide - self.every, end["due"]))
            for target in self.targets
            for first in range(start["due"] + self.every, end["due"] + 1, wide)
        ]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system, _, _ = opened(self.path)
        landed = self._landed(partition.target)
        for due in range(partition.first, partition.last + 1, self.every):
            folder, took = landed.get(due, (None, None))
            lines: list[str] = []
            if folder is not None:
                for info in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda x: x.base_name):
                    if info.type == fs.FileType.File and info.base_name[0] not in "._":
                        with system.open_input_stream(info.path) as file:
                            lines += file.read().decode("utf-8", "replace").splitlines()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([partition.target]),
                    pa.array([due], pa.int64()),
                    pa.array([int(folder is not None)], pa.int32()),
                    pa.array([took], pa.float64()),
                    pa.array([lines], pa.list_(pa.string())),
                ],
                ["target", "due_s", "up", "took_s", "lines"],
            )

    def commit(self, end: dict) -> None:
        pass


class LandedScrapes(DataSource):
    """Options: path, targets (comma-separated), every (seconds), start (first due time)."""

    @classmethod
    def name(cls) -> str:
        return "landed_scrapes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        options = self.options
        targets = [target for target in options.get("targets", "").split(",") if target]
        return ScrapeReader(options["path"], targets, int(options.get("every", "15")), int(options.get("start", "0")))


def due_scrapes(spark: SparkSession, path: str, targets: list[str], every: int, start_s: int) -> DataFrame:
    """The stream: a row for each target and due time from `start_s` on."""
    spark.dataSource.register(LandedScrapes)
    return (
        spark.readStream.format(LandedScrapes.name())
        .option("path", path)
        .option("targets", ",".join(targets))
        .option("every", every)
        .option("start", start_s)
        .load()
    )
