"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tallymark", master: str | None = None) -> SparkSession:
    """Session with the settings the operators rely on."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
    )
    if master:
        builder = builder.master(master)
    return prepare_session(builder.getOrCreate())


def prepare_session(spark: SparkSession) -> SparkSession:
    """Runtime settings for a session that somebody else created."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # A repeated key keeps its last value instead of making the text unreadable.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names for checkpoints.

    A session without that setting gets a temporary folder if its executors run in this
    machine's one process, and an error otherwise.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tallymark.sharedFolder", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder for executors of {master}")
        folder = tempfile.mkdtemp(prefix="tallymark-")
        spark.conf.set("tallymark.sharedFolder", folder)
    return folder.rstrip("/")


def write_once(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder, computed once and the same for every
    later reader."""
    path = new_shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
