"""Listing of files as a Spark data source: names and sizes, no file is opened.

The driver lists folders down to `depth` levels and makes a partition of each; tasks list
the rest of the tree below theirs. Files without a byte are listed like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tallymark.functions import ship_by_value

ship_by_value(__name__)

SCHEMA = "path string, name string, length long, modified timestamp"
BATCH = 10_000
DEPTH = 2


class Folder(InputPartition):
    """A folder to list: itself, or with all that is below."""

    def __init__(self, path: str, whole: bool):
        self.path, self.whole = path, whole


def opened(uri: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path in it, and what stands before that path in a full name."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri, ""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/"), "file:"
    system, path = fs.FileSystem.from_uri(uri)
    return system, path, uri[: len(uri) - len(path)]


def _below(system: fs.FileSystem, path: str, recursive: bool) -> list[fs.FileInfo]:
    return system.get_file_info(fs.FileSelector(path, recursive=recursive))


class FolderReader(DataSourceReader):
    def __init__(self, path: str, depth: int):
        self.path, self.depth = path, depth

    def partitions(self) -> list[Folder]:
        system, top, _ = opened(self.path)
        parts, level = [], [top]
        for step in range(self.depth + 1):
            parts += [Folder(path, step == self.depth) for path in level]
            if step < self.depth:
                level = [
                    info.path for path in level for info in _below(system, path, False) if info.type == fs.FileType.Directory
                ]
        return parts

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        system, _, lead = opened(self.path)
        files = [
            info for info in _below(system, partition.path, partition.whole)
            if info.type == fs.FileType.File and not info.base_name.startswith(".")
        ]
        for low in range(0, len(files), BATCH):
            some = files[low : low + BATCH]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lead + info.path for info in some], pa.string()),
                    pa.array([info.base_name for info in some], pa.string()),
                    pa.array([info.size for info in some], pa.int64()),
                    pa.array([info.mtime for info in some], pa.timestamp("us", "UTC")),
                ],
                ["path", "name", "length", "modified"],
            )


class FolderListing(DataSource):
    """Options: path, depth."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(self.options["path"], int(self.options.get("depth", DEPTH)))
