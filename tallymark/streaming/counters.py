"""Counter rates over micro-batches: slices per series, then one state row per series.

Two stateful operators in a row, both in append mode:

* samples are summarised per series and slice (t - piece, t] by a windowed aggregate. A
  busy series is spread over its slices, repeated samples of an instant count once, and a
  slice comes out when the watermark has passed it, so slices reach the next operator in
  the order of their time, batch by batch;
* `CounterState` (transformWithState) is keyed by series. Its state is one row: the last
  sample, what resets have taken away since the series began, and the slices seen. It turns
  a slice into totals that never fall, whatever batch the slice before came in. An
  event-time timer ends a series that has been silent for `expire_s`; a later sample
  starts it anew. (State TTL goes by processing time, on which a replay must not depend.)

Rates are then plain minima and maxima over slices. Samples that come after their slice
was closed are dropped by the watermark and counted by the run.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallymark.functions import ship_by_value
from tallymark.operators.timeseries import extrapolated_rate, grid_points
from tallymark.session import new_shared_path

ship_by_value(__name__)

PIECE_SECONDS = 60
EXPIRE_SECONDS = 7 * 86400
STATE = "last_us long, last_value double, resets double, slices long"
SLICE_COLUMNS = (
    "end_s long, samples long, first_us long, last_us long, first_value double, first_total double, last_total double"
)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_beats(samples: DataFrame, beats: DataFrame) -> DataFrame:
    """Samples and beats (ts): a beat says that nothing older is to come, so that slices
    close without a further sample."""
    return samples.unionByName(beats.select("ts"), allowMissingColumns=True)


def closed_slices(samples: DataFrame, series: list[str], piece: int = PIECE_SECONDS, late: str = "1 day") -> DataFrame:
    """Summary of every series and slice (t - piece, t] that the watermark has passed.

    The state holds the samples of open slices. Of several samples of an instant the
    largest counts. Samples without a value are beats."""
    # Windows include their start; one microsecond less makes them include their end. The
    # test names the time as well, so that beats are not filtered before the watermark.
    real = F.when(F.col("_at").isNotNull(), F.col("value")).isNotNull()
    shifted = samples.withColumn("_at", F.col("ts") - F.expr("interval 1 microsecond")).withWatermark("_at", late)
    listed = (
        shifted.filter(real)
        .groupBy(F.window("_at", f"{piece} seconds"), *series)
        .agg(F.sort_array(F.collect_list(F.struct(F.unix_micros("ts").alias("us"), "value"))).alias("_all"))
    )
    every = F.col("_all")
    # Sorted by time and value: the last of an instant stays.
    kept = F.filter(every, lambda x, i: (i + 1 == F.size(every)) | (F.get(every, i + 1)["us"] > x["us"]))
    first, last = F.element_at("_kept", 1), F.element_at("_kept", -1)
    resets = F.aggregate(
        "_kept",
        F.struct(F.lit(0.0).alias("sum"), first["value"].alias("before")),
        lambda state, x: F.struct(
            (state["sum"] + F.when(x["value"] < state["before"], state["before"]).otherwise(0.0)).alias("sum"),
            x["value"].alias("before"),
        ),
        lambda state: state["sum"],
    )
    return listed.withColumn("_kept", kept).select(
        *series,
        F.window_time("window").alias("closed_at"),
        (F.unix_seconds("window.end")).alias("end_s"),
        F.size("_kept").cast("long").alias("samples"),
        first["us"].alias("first_us"),
        last["us"].alias("last_us"),
        first["value"].alias("first_value"),
        last["value"].alias("last_value"),
        resets.alias("resets"),
    )


class CounterState(StatefulProcessor):
    """Totals of a series from its closed slices."""

    def __init__(self, series: list[str], expire_s: int):
        self.series, self.expire_ms = series, expire_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("counter", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # A row per slice that has closed since the last batch.
        slices = pd.concat(list(rows)).sort_values("end_s", kind="stable")
        last_us, last_value, carried, seen = self.state.get() if self.state.exists() else (None, None, 0.0, 0)
        if last_us is not None:
            slices = slices[slices["first_us"] > last_us]
        if slices.empty:
            return
        first, last = slices["first_value"].to_numpy(), slices["last_value"].to_numpy()
        before = np.append(first[0] if last_us is None else last_value, last[:-1])
        between = np.where(first < before, before, 0.0)
        inside = slices["resets"].to_numpy()
        # What resets have taken before the first and up to the last sample of a slice.
        lost = carried + np.cumsum(between + inside)
        self.state.update((int(slices["last_us"].iloc[-1]), float(last[-1]), float(lost[-1]), int(seen) + len(slices)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(slices["last_us"].iloc[-1]) // 1000 + self.expire_ms)
        out = slices[["end_s", "samples", "first_us", "last_us", "first_value"]].copy()
        out["first_total"] = first + lost - inside
        out["last_total"] = last + lost
        for name, value in zip(self.series, key, strict=True):
            out.insert(0, name, value)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def counter_totals(slices: DataFrame, series: list[str], expire_s: int = EXPIRE_SECONDS) -> DataFrame:
    """Closed slices with totals that never fall: series (text), end_s, samples, first_us,
    last_us, first_value, first_total, last_total."""
    schema = ", ".join(f"`{name}` string" for name in series) + ", " + SLICE_COLUMNS
    return slices.groupBy(*series).transformWithStateInPandas(
        statefulProcessor=CounterState(series, expire_s), outputStructType=schema, outputMode="append", timeMode="EventTime"
    )


class Progress(NamedTuple):
    """Output folder of a run, rows that were too late for their slice, and rows of state
    that the last batch left per series operator and per slice operator."""

    path: str
    late_rows: int
    series_rows: int
    slice_rows: int


@contextmanager
def _rocks(spark: SparkSession):
    """The state store that stateful processors need, for queries started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _progress(query: StreamingQuery, out: str) -> Progress:
    late, series, slices = 0, 0, 0
    for progress in query.recentProgress:
        for operator in progress.stateOperators:
            late += operator.numRowsDroppedByWatermark
            if operator.operatorName.startswith("transformWithState"):
                series = operator.numRowsTotal
            else:
                slices = operator.numRowsTotal
    return Progress(out, late, series, slices)


def run_totals(
    samples: DataFrame,
    series: list[str],
    piece: int = PIECE_SECONDS,
    late: str = "1 day",
    expire_s: int = EXPIRE_SECONDS,
    out: str | None = None,
    state: str | None = None,
) -> Progress:
    """Runs the two operators to the end of the input; with the same folders a later run
    goes on where this one stopped."""
    spark = samples.sparkSession
    out = out or new_shared_path(spark, "totals")
    totals = counter_totals(closed_slices(samples, series, piece, late), series, expire_s)
    with _rocks(spark):
        query = (
            totals.writeStream.outputMode("append")
            .format("parquet")
            .option("path", out)
            .option("checkpointLocation", state or new_shared_path(spark, "totals-state"))
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return _progress(query, out)


def total_rates(totals: DataFrame, series: list[str], step: int, reach: int) -> DataFrame:
    """Rates over (t - reach, t] at every multiple t of `step`, from totals of slices whose
    length divides both. Totals never fall, so a window is minima and maxima: nothing is
    listed or sorted, and tasks merge before they send. A series may expire after `reach`
    at the earliest."""
    gridded = totals.withColumn("step_s", F.explode(grid_points("end_s", step, reach)))
    windows = gridded.groupBy(*series, "step_s").agg(
        F.sum("samples").alias("samples"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.min_by("first_value", "first_us").alias("first_value"),
        (F.max_by("last_total", "last_us") - F.min_by("first_total", "first_us")).alias("_increase"),
    )
    # The form that the batch operator rates: last - first + resets.
    summaries = windows.withColumn("last_value", F.col("first_value") + F.col("_increase")).withColumn("resets", F.lit(0.0))
    return extrapolated_rate(summaries, reach).select(*series, "step_s", "rate")
