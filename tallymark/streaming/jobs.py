"""Stream jobs: rolling latency summaries, counter rates, scrape parsing.

Every job runs until its input is used up (availableNow) and writes to a folder; nothing
is collected. A job that is given its output and state folders goes on where an earlier
run stopped; without them it runs once over folders of its own. Aggregates are written
in update mode with the number of the micro-batch, and readers keep the last version per
key. Rows that came after their window had closed are counted.

Counter rates are carried across batches (streaming/counters.py): closed slices of a
series pass a stateful operator that keeps one row per series.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallymark.operators.latency import latency_measures
from tallymark.operators.timeseries import parse_scrape
from tallymark.session import new_shared_path


class Run(NamedTuple):
    """Output folder of a run, and how many rows were too late for their window."""

    path: str
    late_rows: int


def _late_rows(query: StreamingQuery) -> int:
    return sum(
        operator.numRowsDroppedByWatermark for progress in query.recentProgress for operator in progress.stateOperators
    )


def run_updates(stream: DataFrame, label: str, out: str | None = None, state: str | None = None) -> Run:
    """Runs an aggregating stream to the end of its input; `out` holds all versions."""
    spark = stream.sparkSession
    out = out or new_shared_path(spark, label)
    # A version without rows: the output has a schema even if no batch ever runs.
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")

    def keep(batch: DataFrame, number: int) -> None:
        # A batch that runs again after a failure replaces its own folder.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", state or new_shared_path(spark, f"{label}-state"))
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    query.awaitTermination()
    return Run(out, _late_rows(query))


def last_versions(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Last written version per key of a folder of versions."""
    versions = spark.read.option("basePath", folder).parquet(folder)
    others = [name for name in versions.columns if name not in (*keys, "batch")]
    return (
        versions.groupBy(*keys)
        .agg(F.max_by(F.struct(*others), "batch").alias("_last"))
        .select(*keys, "_last.*")
    )


def latency_stream(requests: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Latency measures per window and model; requests: ts, model, status_code, latency_s."""
    return (
        requests.withWatermark("ts", late)
        .groupBy(F.window("ts", every), "model")
        .agg(*latency_measures())
        .select(F.col("window.start").alias("window_start"), "model", *LATENCY_COLUMNS)
    )


LATENCY_COLUMNS = ["num_requests", "successful", "avg_latency_s", "min_latency_s", "max_latency_s"]


def scrape_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed samples of landed scrape files, as a stream."""
    lines = spark.readStream.text(folder).withColumnRenamed("value", "line")
    return parse_scrape(lines)


def run_append(stream: DataFrame, label: str, out: str | None = None, state: str | None = None) -> str:
    """Runs a stateless stream to the end of its input; returns the folder it wrote."""
    spark = stream.sparkSession
    out = out or new_shared_path(spark, label)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", state or new_shared_path(spark, f"{label}-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return out
