"""Segmented documents of a file: allowed groups, page metadata, overlaps, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.operators.skew import hot_from_counts, lookup_join
from tallymark.session import write_once

# documents: file_id, doc_no, n_pages, document_code, document_name,
#            page_ranges ARRAY<ARRAY<INT>>, page_order ARRAY<INT>,
#            duplicate_pages ARRAY<STRUCT<page, duplicate_of>>


def allowed_groups(documents: DataFrame, groups: DataFrame) -> DataFrame:
    """Documents of a known group, with its canonical name; a blank document name
    becomes that name. Other documents are left out."""
    known = groups.select(F.col("group_code").alias("document_code"), F.col("group_name").alias("_canonical"))
    others = [name for name in documents.columns if name not in ("group_name", "document_name")]
    joined = lookup_join(documents, known, ["document_code"], ["file_id", "doc_no"], "inner")
    return joined.select(
        *others,
        F.col("_canonical").alias("group_name"),
        F.coalesce(F.nullif("document_name", F.lit("")), F.col("_canonical")).alias("document_name"),
    )


def range_error(ranges: Column) -> Column:
    """First problem among [start, end] pairs, in their order.

    Sound pairs overlap if two neighbours by start do, so only a list that also holds an
    unsound pair is compared pair by pair, to tell which problem comes first.
    """
    unsound = F.exists(ranges, lambda pair: (pair[0] < 1) | (pair[1] < pair[0]))
    ordered = F.sort_array(ranges)
    following = F.slice(ordered, F.lit(2), F.greatest(F.size(ordered), F.lit(1)))
    overlap = F.exists(F.zip_with(ordered, following, lambda a, b: a[1] >= b[0]), lambda meets: meets)

    def problem(pair: Column, index: Column) -> Column:
        start, end = pair[0], pair[1]
        clash = F.exists(F.slice(ranges, F.lit(1), index), lambda other: (other[0] <= end) & (start <= other[1]))
        return F.when(
            (start < 1) | (end < start), F.lit("page_ranges must contain positive [start_page, end_page] pairs")
        ).when(clash, F.lit("page_ranges must be disjoint"))

    first = F.try_element_at(F.array_compact(F.transform(ranges, problem)), F.lit(1))
    return F.when(unsound, first).when(overlap, F.lit("page_ranges must be disjoint"))


def page_error(n_pages: Column) -> Column:
    """First broken rule of a document's page metadata, NULL when all hold. Ranges are
    compared by their ends, so a wild range costs nothing."""
    order, ranges, copies = F.col("page_order"), F.col("page_ranges"), F.col("duplicate_pages")

    def outside(page: Column) -> Column:
        return (page < 1) | (page > n_pages)

    def in_ranges(page: Column) -> Column:
        return F.exists(ranges, lambda pair: (pair[0] <= page) & (page <= pair[1]))

    covered = F.aggregate(
        ranges, F.lit(0).cast("bigint"), lambda total, pair: total + pair[1].cast("bigint") - pair[0] + 1
    )
    same_pages = (F.size(order) == covered) & F.forall(order, in_ranges)
    rules = [
        (F.size(order) == 0, F.lit("page_order must not be empty")),
        (F.size(ranges) == 0, F.lit("page_ranges must not be empty")),
        (range_error(ranges).isNotNull(), range_error(ranges)),
        (F.size(F.array_distinct(order)) < F.size(order), F.lit("page_order must not contain duplicate pages")),
        (F.exists(order, outside), F.lit("page_order references a page outside the file")),
        (F.exists(ranges, lambda pair: outside(pair[1])), F.lit("page_ranges reference a page outside the file")),
        (~same_pages, F.lit("page_order must match the union of page_ranges")),
        (F.exists(copies, lambda c: F.array_contains(order, c["page"])), F.lit("duplicate_pages must not appear in page_order")),
        (F.exists(copies, lambda c: outside(c["page"])), F.lit("duplicate_pages reference a page outside the file")),
        (F.exists(copies, lambda c: ~F.array_contains(order, c["duplicate_of"])), F.lit("duplicate_of must reference a page in page_order")),
    ]
    result = None
    for broken, text in rules:
        result = F.when(broken, text) if result is None else result.when(broken, text)
    return result


def check_pages(documents: DataFrame) -> DataFrame:
    return documents.withColumn("page_error", page_error(F.col("n_pages")))


def _range_problem() -> Column:
    """What keeps a document's ranges from claiming pages."""
    ranges = F.col("page_ranges")
    beyond = F.exists(ranges, lambda pair: pair[1] > F.col("n_pages"))
    return F.coalesce(range_error(ranges), F.when(beyond, F.lit("page_ranges reference a page outside the file")))


def expand_pages(documents: DataFrame) -> DataFrame:
    """One row per page a document covers, however many. A document with unsound ranges,
    or with some beyond its file, gives one row without a page that says why."""
    ranges = F.col("page_ranges")
    judged = documents.select("file_id", "doc_no", "page_ranges", _range_problem().alias("error"))
    pages = F.flatten(F.transform(ranges, lambda pair: F.sequence(pair[0], pair[1])))
    return judged.select(
        "file_id", "doc_no", F.explode_outer(F.when(F.col("error").isNull(), pages)).alias("page"), "error"
    )


def _running_max(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with the largest `value` of the rows of their key up to and with them; order[0]
    is an integer.

    A key with more rows than a task should take is cut into stretches of order[0];
    stretches exchange one row each."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.max(order[0]).alias("_last"))
    cut = hot_from_counts(counted.drop("_last"), keys).join(counted.select(*keys, "_last"), keys)
    # At most rows / rows per task keys are cut.
    sliced = rows.join(F.broadcast(cut), keys, "left").withColumn(
        "_slice",
        F.coalesce(F.expr(f"{order[0]} * _parts div (_last + 1)"), F.lit(0)).cast("bigint"),
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = sliced.drop("_parts", "_last").withColumn(name, F.max(value).over(inside))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        sliced.filter("_parts is not null")
        .groupBy(*keys, "_slice")
        .agg(F.max(value).alias("_most"))
        .select(*keys, "_slice", F.max("_most").over(earlier).alias("_carry"))
    )
    # Stretches of cut keys only, so as few as there are tasks.
    joined = local.join(F.broadcast(carry), [*keys, "_slice"], "left")
    return joined.withColumn(name, F.greatest(name, "_carry")).drop("_slice", "_carry")


def first_overlap(documents: DataFrame) -> DataFrame:
    """Per file the first document that overlaps an earlier one: file_id, doc_no.

    Two documents differ in a highest bit of their numbers; there the earlier one stands on
    the left, the later one on the right of a block of documents. For each level a sweep
    runs over the blocks: left ranges enter at their starts, right ranges look back from
    their ends, and overlap if the furthest left end seen so far reaches their start. So
    every pair meets in one sweep, no page is expanded and no pair is listed."""
    size = documents.groupBy("file_id").agg(
        F.max("doc_no").cast("bigint").alias("_docs"), F.sum(F.size("page_ranges")).alias("_rows")
    )
    pair = F.transform("page_ranges", lambda r: F.struct(r[0].cast("bigint").alias("start"), r[1].cast("bigint").alias("end")))
    ranged = documents.select("file_id", F.col("doc_no").cast("bigint").alias("doc_no"), F.inline(pair))
    hot = hot_from_counts(size, ["file_id"])
    crowded = not hot.isEmpty()
    if crowded:
        ranged = lookup_join(ranged, size.select("file_id", "_docs"), ["file_id"], ["doc_no", "start"], "inner", hot)
    else:
        # Every file fits a task: one shuffle by file serves all that follows.
        ranged = ranged.withColumn("_docs", F.max("doc_no").over(Window.partitionBy("file_id")))
    levels = F.expr("sequence(0, cast(greatest(ceil(log2(_docs + 1)), 1) as int) - 1)")
    marked = ranged.select("file_id", "doc_no", "start", "end", F.explode(levels).alias("level")).select(
        "file_id",
        "level",
        F.expr("shiftright(doc_no, level + 1)").alias("block"),
        "doc_no",
        "start",
        "end",
        F.expr("shiftright(doc_no, level) % 2").alias("right"),
    )
    events = marked.withColumn("at", F.when(F.col("right") == 0, F.col("start")).otherwise(F.col("end"))).withColumn(
        "reach", F.when(F.col("right") == 0, F.col("end"))
    )
    keys, order = ["file_id", "level", "block"], ["at", "right"]
    if crowded:
        swept = _running_max(events, keys, order, "reach", "furthest")
    else:
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        swept = events.withColumn("furthest", F.max("reach").over(before))
    hit = swept.filter((F.col("right") == 1) & (F.col("furthest") >= F.col("start")))
    return hit.groupBy("file_id").agg(F.min("doc_no").alias("doc_no"))


def page_overlap(documents: DataFrame) -> DataFrame:
    """Per file, the first document that claims a page of an earlier one, and the pages.

    Documents with unsound ranges, or with some beyond their file, claim nothing. Only the
    pages that are shared are listed; ranges of any length cost as much as short ones.
    doc_no is unique within a file and not negative."""
    # Judged once; the sweep and the listing read it again.
    judged = documents.filter(_range_problem().isNull()).select("file_id", "doc_no", "page_ranges")
    sound = write_once(judged.filter(F.size("page_ranges") > 0), "ranges")
    first = write_once(first_overlap(sound), "overlaps")
    if first.isEmpty():
        return first.withColumn("pages", F.array().cast("array<int>"))
    mine = sound.join(first, ["file_id", "doc_no"], "left_semi").select(
        "file_id", F.col("doc_no").alias("_first"), F.col("page_ranges").alias("_mine")
    )
    # Documents before the first overlap share no page among themselves. Files without an
    # overlap leave before anything is spread.
    open_files = sound.join(first.select("file_id"), "file_id", "left_semi")
    earlier = lookup_join(open_files, mine, ["file_id"], ["doc_no"], "inner").filter(F.col("doc_no") < F.col("_first"))

    def common(a: Column) -> Column:
        return F.filter(
            F.transform("_mine", lambda b: F.struct(F.greatest(a[0], b[0]).alias("low"), F.least(a[1], b[1]).alias("high"))),
            lambda x: x["low"] <= x["high"],
        )

    shared = F.flatten(F.transform("page_ranges", common))
    pages = earlier.select("file_id", "_first", F.flatten(F.transform(shared, lambda x: F.sequence(x["low"], x["high"]))).alias("pages"))
    return (
        pages.filter(F.size("pages") > 0)
        .groupBy("file_id", F.col("_first").alias("doc_no"))
        .agg(F.sort_array(F.flatten(F.collect_list("pages"))).alias("pages"))
    )


def overlap_error(pages: Column) -> Column:
    listed = F.array_join(F.transform(pages, lambda p: p.cast("string")), ", ")
    return F.concat(F.lit("page_ranges overlap across documents: ["), listed, F.lit("]"))


def ordered_pages(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of each document in reading order, one row per position; a page the file
    does not have is marked. pages: file_id, page_number and further columns."""
    wanted = documents.select("file_id", "doc_no", F.posexplode("page_order").alias("_at", "page_number")).select(
        "file_id", "doc_no", (F.col("_at") + 1).alias("position"), "page_number"
    )
    joined = lookup_join(
        wanted, pages.withColumn("_found", F.lit(True)), ["file_id", "page_number"], ["doc_no", "position"]
    )
    return joined.withColumn(
        "error",
        F.when(
            F.col("_found").isNull(),
            F.concat(F.lit("page_order references missing page "), F.col("page_number").cast("string")),
        ),
    ).drop("_found")
