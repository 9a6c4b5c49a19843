"""CSV with quoted line breaks, read by many tasks per file.

A physical line begins inside a quoted cell or not, depending on all lines before it. Every
task follows the lines of its file block under both assumptions, which gives the block's
effect on either; a prefix over the blocks of a file (one row each) then tells which
assumption holds in which block, and how many records begin before it. Records of one line
stay where they are. Only lines of longer records, which may cross blocks, are brought
together, by the number of their record.

Quotes count as in CSV: at the start of a cell they open it, doubled ones inside stand for
one, after the closing quote the rest up to the comma belongs to the cell, and elsewhere
they are characters.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.functions import ship_by_value
from tallymark.operators.skew import lookup_join
from tallymark.session import write_once

ship_by_value(__name__)

#: A record longer than this has lost its closing quote.
MAX_RECORD_CHARS = 16 << 20
BOM = "﻿"


def open_after(line: str, quoted: bool) -> bool:
    """Whether a quoted cell is open at the end of a line that begins inside one or not."""
    at = 0
    while True:
        if quoted:
            close = line.find('"', at)
            if close < 0:
                return True
            if line.startswith('"', close + 1):
                at = close + 2
                continue
            at = close + 1
        elif line.startswith('"', at):
            quoted, at = True, at + 1
            continue
        comma = line.find(",", at)
        if comma < 0:
            return False
        quoted, at = False, comma + 1


class BlockScan:
    """Follows the lines of a block under both assumptions."""

    def __init__(self) -> None:
        self.open = [False, True]
        self.records = [0, 0]

    def take(self, lines: pa.Array) -> list[np.ndarray]:
        """For either assumption: open before each line, open after it, and the records
        that have begun in the block up to and with it."""
        n = len(lines)
        at = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
        marked = lines.take(pa.array(at)).to_pylist()
        effect = [(open_after(line, False), open_after(line, True)) for line in marked]
        out = []
        for k in (0, 1):
            states = [self.open[k]]
            for either in effect:
                states.append(either[states[-1]])
            # Lines without a quote leave the state as it is.
            after = np.repeat(states, np.diff([0, *at, n]))
            before = np.concatenate([[self.open[k]], after[:-1]]).astype(bool)[:n]
            records = self.records[k] + np.cumsum(~before)
            if n:
                self.open[k], self.records[k] = bool(after[-1]), int(records[-1])
            out += [before, after.astype(bool), records]
        return out


def scan_lines(lines: DataFrame) -> DataFrame:
    """lines (file, block, row, value) with both assumptions' states: before0, after0,
    record0, before1, after1, record1, and `size`."""
    names = ["file", "block", "row", "value", "size", "before0", "after0", "record0", "before1", "after1", "record1"]

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, scan = None, BlockScan()
        for frame in frames:
            files, blocks = frame.column(0).to_pylist(), frame.column(1).to_pylist()
            value = frame.column(3)
            edges = [i for i in range(1, len(files)) if (files[i], blocks[i]) != (files[i - 1], blocks[i - 1])]
            for low, high in zip([0, *edges], [*edges, len(files)], strict=True):
                if low == high:
                    continue
                part = value.slice(low, high - low)
                if (files[low], blocks[low]) != here:
                    here, scan = (files[low], blocks[low]), BlockScan()
                    if not blocks[low] and (first := part[0].as_py()).startswith(BOM):
                        part = pa.concat_arrays([pa.array([first[1:]], part.type), part.slice(1)])
                yield pa.RecordBatch.from_arrays(
                    [
                        *[frame.column(i).slice(low, high - low) for i in range(3)],
                        part,
                        pc.utf8_length(part).cast(pa.int64()),
                        *[pa.array(x) for x in scan.take(part)],
                    ],
                    names,
                )

    states = ", ".join(f"before{k} boolean, after{k} boolean, record{k} long" for k in (0, 1))
    return lines.mapInArrow(read, f"file string, block long, row long, value string, size long, {states}")


def block_starts(scanned: DataFrame) -> DataFrame:
    """file, block, whether it begins inside a quoted cell, and the records before it.

    A block's effect on the state is to keep it, to set it, or to turn it. The state at a
    block's start is what the last setting block before has set, turned as often as
    blocks since then have turned it."""
    last = F.max_by(F.struct("after0", "after1", "record0", "record1"), "row")
    blocks = scanned.groupBy("file", "block").agg(last.alias("end")).select("file", "block", "end.*")
    ordered = Window.partitionBy("file").orderBy("block")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("after0") == F.col("after1")
    turns = F.when(F.col("after0") & ~F.col("after1"), 1).otherwise(0)
    turned = blocks.withColumn("turned", F.sum(turns).over(ordered))
    state = F.struct(F.col("after0").alias("open"), "turned")
    known = turned.withColumn("set", F.last(F.when(sets, state), ignorenulls=True).over(earlier)).withColumn(
        "before", F.coalesce(F.last("turned").over(earlier), F.lit(0))
    )
    odd = (F.col("before") - F.coalesce("set.turned", F.lit(0))) % 2 == 1
    began = known.withColumn("open", F.coalesce("set.open", F.lit(False)) != odd)
    made = F.when(F.col("open"), F.col("record1")).otherwise(F.col("record0"))
    return began.select("file", "block", "open", F.coalesce(F.sum(made).over(earlier), F.lit(0)).alias("records"))


def split_records(spark: SparkSession, path: str, max_chars: int = MAX_RECORD_CHARS) -> DataFrame:
    """file, record (from 1) and text of every record of the CSV files below `path`, line
    breaks inside quotes included.

    The scanned lines are written once: blocks and places are those of one scan."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )
    scanned = write_once(scan_lines(lines), "lines")
    begun = lookup_join(scanned, block_starts(scanned), ["file", "block"], ["row"], "inner")

    def under(name: str) -> Column:
        return F.when(F.col("open"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    placed = begun.select(
        "file",
        "block",
        "row",
        "value",
        "size",
        (F.col("records") + under("record")).alias("record"),
        (~under("before") & ~under("after")).alias("whole"),
    )
    one = placed.filter("whole").select("file", "record", F.col("value").alias("text"))
    parts = placed.filter("not whole")
    long = parts.groupBy("file", "record").agg(F.sum("size").alias("size")).filter(F.col("size") > max_chars)
    if (found := long.first()) is not None:
        raise ValueError(f"record {found['record']} of {found['file']} has no closing quote within {max_chars} characters")
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("block", "row", "value"))), lambda x: x["value"])
    many = parts.groupBy("file", "record").agg(F.array_join(pieces, "\n").alias("text"))
    return one.unionByName(many)


def record_cells(text: str) -> list[str]:
    """Cells of one record. A lone carriage return outside quotes is a blank."""
    text = text.removesuffix("\r")
    try:
        return next(csv.reader([text]), [])
    except csv.Error:
        return next(csv.reader([text.replace("\r", " ")]), [])


def read_split_csv(
    spark: SparkSession, path: str, columns: list[str], number: str = "csv_row", max_chars: int = MAX_RECORD_CHARS
) -> DataFrame:
    """Records after the header as file_name, `number` (from 2 on) and text columns: missing
    and empty cells are NULL, cells beyond the columns are left out, empty records are rows
    without data."""
    records = split_records(spark, path, max_chars).filter("record > 1")

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for frame in frames:
            rows = [record_cells(text) for text in frame.column(2).to_pylist()]
            cells = [pa.array([(r[i] or None) if i < len(r) else None for r in rows], pa.string()) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), *cells], ["file_name", number, *columns])

    schema = f"file_name string, `{number}` long, " + ", ".join(f"`{name}` string" for name in columns)
    return records.mapInArrow(read, schema)
