"""Sources: label tables, file inventories, JSON lines, reports, sidecars, scrapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.operators.labels import LABEL_COLUMNS
from tallymark.operators.skew import lookup_join
from tallymark.session import write_once
from tallymark.sources.listing import FolderListing
from tallymark.sources.split_csv import read_split_csv

TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
TABLES = tuple(TABLE_SCHEMAS)

REPORT_SCHEMA = (
    "model string, endpoint string, num_requests bigint, successful bigint, avg_latency_s double, "
    "min_latency_s double, max_latency_s double, timestamp string, "
    "details array<struct<request_id: bigint, status_code: int, latency_s: double>>"
)
SIDECAR_SCHEMA = (
    "id string, repo string, format string, size_gb double, path string, serving_target string, "
    "serving_targets array<string>, quantizations array<string>, status string, downloaded string"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table under its known schema, so that no file is opened to plan."""
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table as a stream: one file, or a folder of part files."""
    return spark.readStream.schema(TABLE_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet*")


def with_ordinal(rows: DataFrame, name: str, first: int) -> DataFrame:
    """Dense row ordinal per file, starting at `first`.

    rows carry _file, _block (start of the file block a task read) and _row (row order
    inside the task). They are written first: blocks and places are those of one scan,
    whatever split sizes hold later. Each block's rows are consecutive there, so an
    ordinal is the rows of the file's earlier blocks plus the place inside the block.
    Block offsets are a table of their own and join by key; a block without one is an
    error, never a lost row.
    """
    at = ["_file", "_block"]
    placed = write_once(rows, "rows")
    blocks = placed.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_start"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*at, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_start") + first).alias("_add"))
    known = F.coalesce(F.col("_add"), F.raise_error(F.lit("a file block has no offset")).cast("bigint"))
    others = [column for column in rows.columns if column not in ("_file", "_block", "_row")]
    joined = lookup_join(placed, offsets, at, ["_row"], "left")
    return joined.select(
        F.col("_file").alias("file_name"), (F.col("_row") + known).alias(name), *others
    )


def _with_position(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label CSV with a header: quoted line breaks, ragged rows and a byte-order mark
    are fine. csv_row counts records from 2. Empty records are rows without data. Files
    are split, however long they are."""
    return read_split_csv(spark, path, list(LABEL_COLUMNS), "csv_row")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder, at any depth: path, name, length. No file is opened; files
    without a byte are there, those whose names begin with a dot are not."""
    spark.dataSource.register(FolderListing)
    return spark.read.format(FolderListing.name()).option("path", path).load().select("path", "name", "length")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their 1-based number per file and the parsed value."""
    lines = _with_position(spark.read.text(path))
    numbered = with_ordinal(lines, "line_number", 1)
    return numbered.withColumnRenamed("value", "text")


def read_chat_records(spark: SparkSession, path: str) -> DataFrame:
    schema = "messages array<struct<role: string, content: string>>, images array<string>"
    lines = read_json_lines(spark, path)
    return lines.select("file_name", "line_number", F.from_json("text", schema).alias("record")).select(
        "file_name", "line_number", "record.*"
    )


def read_run_reports(
    spark: SparkSession, path: str, files: str = "benchmark_*.json", name: Column | None = None
) -> DataFrame:
    """Whole-file benchmark reports, one row each, with the file name or another name
    taken from _metadata."""
    reports = spark.read.schema(REPORT_SCHEMA).option("multiLine", True).option("pathGlobFilter", files).json(path)
    name = F.col("_metadata.file_name") if name is None else name
    return reports.select("*", name.alias("file_name"))


def read_sidecars(spark: SparkSession, path: str, name: str = "model.json") -> DataFrame:
    """The small JSON document `name` of each entry directory right below the folder.

    Other files, at any depth, are not opened. A document that cannot be read, or has no
    id, is a row with an error.
    """
    files = spark.read.text(f"{path}/*", wholetext=True, pathGlobFilter=name)
    named = files.select(
        F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1).alias("entry"), F.col("value").alias("text")
    )
    parsed = named.withColumn("_doc", F.from_json("text", SIDECAR_SCHEMA))
    error = F.when(~F.col("text").rlike(r"^\s*\{"), F.lit("document is not a JSON object")).when(
        F.col("_doc.id").isNull(), F.lit("document has no readable id")
    )
    return parsed.select("entry", "_doc.*", error.alias("error"))


def read_scrapes(spark: SparkSession, path: str) -> DataFrame:
    """Landed scrape files as lines with their file name."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("line"))
