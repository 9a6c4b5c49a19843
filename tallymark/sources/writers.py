"""Sinks: chat records per side, exact-byte lines, reports, summaries, expositions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions import ship_by_value
from tallymark.functions.payload import KEPT_NULLS
from tallymark.operators import labels as L
from tallymark.session import new_shared_path
from tallymark.sources.listing import opened

ship_by_value(__name__)

_ESCAPED = "\"#%'*/:=?\\{[]^"


def chat_lines(records: DataFrame) -> DataFrame:
    return records.select(
        "csv_row", "side", F.to_json(F.struct("messages", "images"), KEPT_NULLS).alias("line")
    )


def write_lines(lines: DataFrame, path: str, text: str = "line", by: list[str] | None = None) -> None:
    """One text line per row, non-ASCII as it is; one folder per value of `by`."""
    keys = by or []
    writer = lines.select(*keys, F.col(text).alias("value")).write.mode("error")
    (writer.partitionBy(*keys) if keys else writer).text(path)


def _folder_name(value: str | None) -> str:
    """A value as Spark spells it in a folder name."""
    if not value:
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(f"%{ord(c):02X}" if c in _ESCAPED or ord(c) < 32 or ord(c) == 127 else c for c in value)


def write_documents(documents: DataFrame, path: str, by: str, text: str = "value") -> None:
    """One folder with one document per value of `by`; its rows are the lines, in order.

    Spark's writer takes several calls for each short file and puts all folders in place
    from the driver, so tasks write the files here, dealt by folder over all of a shuffle.
    A repeated task replaces its files by the same.
    """
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = documents.select(
        F.col(by).cast("string").alias("_by"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row")
    )

    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top, _ = opened(path)
        current, out, made = None, None, 0
        for frame in frames:
            for value, line in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                name = _folder_name(value)
                if name != current:
                    if out is not None:
                        out.close()
                    system.create_dir(f"{top}/{by}={name}", recursive=True)
                    current, out, made = name, system.open_output_stream(f"{top}/{by}={name}/part-00000.txt"), made + 1
                out.write(f"{'' if line is None else line}\n".encode())
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], ["made"])

    ordered = dealt.repartition(tasks, "_by").sortWithinPartitions("_by", "_row").select("_by", "_text")
    ordered.mapInArrow(write, "made long").agg(F.sum("made")).first()
    system, top, _ = opened(path)
    system.create_dir(top, recursive=True)
    # As Spark marks a whole output; an empty one has something to find as well.
    system.open_output_stream(f"{top}/_SUCCESS").close()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("error").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row JSON text as one file."""
    report.coalesce(1).write.mode("error").text(path)


def write_evaluation(details: DataFrame, summary: DataFrame, path: str) -> dict[str, str]:
    """Evaluation output: one JSON line per detail row, and the summary per split."""
    folders = {name: f"{path}/{name}" for name in ("details", "summary")}
    for name, frame in (("details", details), ("summary", summary)):
        write_lines(frame.select(F.to_json(F.struct("*"), KEPT_NULLS).alias("line")), folders[name])
    return folders


def build_dataset(rows: DataFrame, inventory: DataFrame, path: str) -> dict[str, str]:
    """Whole dataset build: rows are resolved once into a written table, from which the
    records per side, the rejected rows, the unused names and the report derive."""
    spark = rows.sparkSession
    staged = new_shared_path(spark, "tagged")
    L.tagged_labels(rows, inventory).write.parquet(staged)
    tagged = spark.read.parquet(staged)
    parts = {name: f"{path}/{name}" for name in ("records", "rejected", "unused", "report")}
    write_lines(chat_lines(L.chat_records(L.build_payload(tagged))), parts["records"], by=["side"])
    L.rejected_rows(tagged).write.json(parts["rejected"])
    L.unused_items(tagged, inventory).write.json(parts["unused"])
    write_report(L.qc_document(L.qc_report(tagged, inventory)), parts["report"])
    return parts
