"""Latency summaries of benchmark runs and the report across runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators.skew import sequence_number

REPORT_COLUMNS = [
    "model",
    "timestamp",
    "avg_latency_s",
    "min_latency_s",
    "max_latency_s",
    "num_requests",
    "successful",
]


def latency_measures(status: str = "status_code", latency: str = "latency_s") -> list[Column]:
    """Measures of one run; only status 200 counts as a success."""
    served = F.when(F.col(status) == 200, F.col(latency))

    def rounded(value: Column) -> Column:
        return F.coalesce(F.round(value, 4), F.lit(0.0))

    return [
        F.count(F.lit(1)).alias("num_requests"),
        F.count_if(F.col(status) == 200).alias("successful"),
        rounded(F.avg(served)).alias("avg_latency_s"),
        rounded(F.min(served)).alias("min_latency_s"),
        rounded(F.max(served)).alias("max_latency_s"),
    ]


def run_summary(requests: DataFrame, keys: list[str]) -> DataFrame:
    return requests.groupBy(*keys).agg(*latency_measures())


def number_requests(requests: DataFrame, keys: list[str], sent: str, tie: str) -> DataFrame:
    """Adds request_id 1..N per run in send order; long runs are cut by the hour."""
    return sequence_number(requests, keys, [sent, tie], "request_id")


def run_report(reports: DataFrame) -> DataFrame:
    """The seven report columns, in the order of the report files."""
    return reports.orderBy("file_name").select(*REPORT_COLUMNS)


def latency_series(reports: DataFrame) -> DataFrame:
    """Average latency per model over its reports, in file order."""
    return reports.select("model", "file_name", "timestamp", "avg_latency_s").orderBy("model", "file_name")


def distinct_models(reports: DataFrame) -> DataFrame:
    return reports.select("model").distinct()
