"""Building blocks that hold when one key owns a large share of the rows.

Joins: a key with many left rows is spread over several copies of its lookup row.
Ordered work (running sums): a key is cut into slices of its time; each slice is one
window group and slices exchange one carry row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_TASK = 2_000_000


def _rows_per_task(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("tallymark.rowsPerTask", str(ROWS_PER_TASK)))


def hot_from_counts(counts: DataFrame, keys: list[str], rows_per_task: int | None = None) -> DataFrame:
    """Keys with more rows (column _rows) than one task should take, with the number
    of parts they need. At most rows / rows_per_task keys come out, so the result may
    be broadcast."""
    limit = rows_per_task or _rows_per_task(counts)
    return counts.filter(F.col("_rows") > limit).select(
        *keys, F.ceil(F.col("_rows") / limit).cast("int").alias("_parts")
    )


def hot_keys(df: DataFrame, keys: list[str], rows_per_task: int | None = None) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return hot_from_counts(counts, keys, rows_per_task)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread_by: list[str],
    how: str = "left",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Equi-join of many left rows with a table that is unique per key.

    Hot left keys are split by a hash of `spread_by`; only their lookup rows are
    copied. Left rows without a key match nothing and are spread over all tasks.
    """
    hot = hot_keys(left, keys) if hot is None else hot
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    row_hash = F.xxhash64(*spread_by)
    spread = (
        left.join(F.broadcast(hot), keys, "left")
        .withColumn(
            "_part",
            F.when(no_key, F.pmod(row_hash, F.lit(tasks)))
            .otherwise(F.pmod(row_hash, F.coalesce(F.col("_parts"), F.lit(1))))
            .cast("int"),
        )
        .drop("_parts")
    )
    copies = (
        right.join(F.broadcast(hot), keys, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
        .drop("_parts")
    )
    return spread.join(copies, [*keys, "_part"], how).drop("_part")


_MICRO = 1_000_000


def with_time_slices(df: DataFrame, keys: list[str], time: str, width_s: int) -> DataFrame:
    """Adds _slice, the start (microseconds) of the row's time slice within its key.

    Slices are `width_s` long; one that holds more rows than a task should take is cut
    into equally long parts. Slice starts never fall along the time. The table of cut
    slices has at most (rows / rows per task) rows, so it may be broadcast.
    """
    width = width_s * _MICRO
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    coarse = df.withColumn("_us", micros).withColumn("_coarse", (F.floor(F.col("_us") / width) * width).cast("bigint"))
    cut = hot_keys(coarse, [*keys, "_coarse"])
    part = (F.lit(width) / F.coalesce(F.col("_parts"), F.lit(1))).cast("bigint")
    joined = coarse.join(F.broadcast(cut), [*keys, "_coarse"], "left")
    start = F.col("_coarse") + F.floor((F.col("_us") - F.col("_coarse")) / part) * part
    return joined.select(*df.columns, start.cast("bigint").alias("_slice"))


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column],
    width_s: int = 3600,
) -> DataFrame:
    """Inclusive running sums per key; order[0] is a time, the rest breaks ties.

    A window covers one time slice of a key; the totals of earlier slices arrive by a
    join on the same columns, so nothing is partitioned by the key alone but one row
    per slice.
    """
    sliced = with_time_slices(df, keys, order[0], width_s)
    totals = sliced.groupBy(*keys, "_slice").agg(
        *[F.sum(value).alias(f"_total_{name}") for name, value in sums.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        "_slice",
        *[F.coalesce(F.sum(f"_total_{name}").over(before), F.lit(0)).alias(f"_carry_{name}") for name in sums],
    )
    inside = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = sliced.select("*", *[F.sum(value).over(inside).alias(f"_local_{name}") for name, value in sums.items()])
    return local.join(carry, [*keys, "_slice"]).select(
        *df.columns,
        *[(F.col(f"_local_{name}") + F.col(f"_carry_{name}")).alias(name) for name in sums],
    )


def sequence_number(df: DataFrame, keys: list[str], order: list[str], name: str, width_s: int = 3600) -> DataFrame:
    """1, 2, 3, ... per key in the given order (time first)."""
    return running_sum(df, keys, order, {name: F.lit(1).cast("bigint")}, width_s)


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """First n rows per key: tasks keep their own first n before anything moves."""
    if n < 1:
        return df.limit(0)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
