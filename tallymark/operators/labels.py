"""Labelled rows and an image inventory to chat training records with a QC report."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark import constants as K
from tallymark.functions.payload import KEPT_NULLS
from tallymark.functions.text import clean_cell, fold_key
from tallymark.operators.skew import hot_from_counts, lookup_join

LABEL_COLUMNS = [f"c{index}" for index in range(K.LABEL_COLUMN_COUNT)]
_FRONT = [f"c{index}" for index in K.FRONT_COLUMNS.values()]
_BACK = [f"c{index}" for index in (*K.BACK_COLUMNS.values(), *K.MRZ_COLUMNS.values())]


def side_template(side: str) -> dict[str, Any]:
    """Expected payload of a side: None marks a nullable text, text a constant."""
    if side == "front":
        fields: dict[str, Any] = dict.fromkeys(K.FRONT_COLUMNS)
    else:
        fields = {**dict.fromkeys(K.BACK_COLUMNS), "mrz": dict.fromkeys(K.MRZ_COLUMNS)}
    return {"document_type": K.DOCUMENT_TYPE, "side": side, "fields": fields}


SIDE_TEMPLATES = {side: side_template(side) for side in K.SIDES}


def clean_cells(rows: DataFrame) -> DataFrame:
    """Every label cell trimmed, blank cells NULL; columns a short table lacks are NULL."""
    have = set(rows.columns)
    others = [name for name in rows.columns if name not in LABEL_COLUMNS]
    cells = [
        (clean_cell(F.col(name)) if name in have else F.lit(None).cast("string")).alias(name)
        for name in LABEL_COLUMNS
    ]
    return rows.select(*others, *cells)


def _any_filled(names: list[str]) -> Column:
    return F.coalesce(*[F.col(name) for name in names]).isNotNull()


def classify_rows(cleaned: DataFrame) -> DataFrame:
    """Adds side (front, back, NULL), mixed_side and image_name."""
    front, back = _any_filled(_FRONT), _any_filled(_BACK)
    return cleaned.select(
        "*",
        F.when(front & ~back, F.lit("front")).when(back & ~front, F.lit("back")).alias("side"),
        (front & back).alias("mixed_side"),
        F.coalesce(*[F.col(f"c{index}") for index in K.NAME_COLUMNS]).alias("image_name"),
    )


def ambiguous_keys(inventory: DataFrame) -> DataFrame:
    """Normalised keys that several different names share."""
    names = inventory.select("name").distinct()
    return (
        names.withColumn("key", fold_key("name"))
        .groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("names"),
            F.min("name").alias("first_name"),
            F.max("name").alias("last_name"),
        )
        .filter(F.col("names") > 1)
    )


def resolve_names(rows: DataFrame, inventory: DataFrame, row_id: str = "csv_row") -> DataFrame:
    """Adds path_name and resolution to rows that carry image_name.

    Names are resolved once each: exact match first, then the normalised key. A key that
    several files share names none of them: such rows are rejected as ambiguous. Both
    joins are equi-joins of unique names; the rows meet the result in one join that
    splits names used by very many rows.
    """
    files = inventory.select("name").distinct()
    used = rows.filter(F.col("image_name").isNotNull()).groupBy("image_name").agg(
        F.count(F.lit(1)).alias("_rows")
    )
    by_key = (
        files.withColumn("_key", fold_key("name"))
        .groupBy("_key")
        .agg(F.max("name").alias("_folded_name"), (F.count(F.lit(1)) > 1).alias("_ambiguous"))
    )
    hot = hot_from_counts(used, ["image_name"])
    exact = used.join(files.select(F.col("name").alias("_exact_name")), F.col("image_name") == F.col("_exact_name"), "left")
    resolved = (
        exact.withColumn("_key", fold_key("image_name"))
        .join(by_key, "_key", "left")
        .select(
            "image_name",
            F.coalesce("_exact_name", F.when(~F.col("_ambiguous"), F.col("_folded_name"))).alias("path_name"),
            F.when(F.col("_exact_name").isNotNull(), F.lit("exact_match"))
            .when(F.col("_ambiguous"), F.lit("ambiguous_name"))
            .when(F.col("_folded_name").isNotNull(), F.lit("normalized_match"))
            .otherwise(F.lit("missing_file"))
            .alias("resolution"),
        )
    )
    joined = lookup_join(rows, resolved, ["image_name"], [row_id], hot=hot)
    return joined.withColumn("resolution", F.coalesce("resolution", F.lit("blank_name")))


def tag_rows(resolved: DataFrame) -> DataFrame:
    """One reason per rejected row (NULL = accepted). A mixed row is rejected before
    its name is looked at, a row without data only after its name was found."""
    lost = F.col("path_name").isNull()
    return resolved.withColumn(
        "reason",
        F.when(F.col("mixed_side"), F.lit("mixed_side"))
        .when(lost, F.col("resolution"))
        .when(F.col("side").isNull(), F.lit("no_side_data")),
    )


def tagged_labels(rows: DataFrame, inventory: DataFrame) -> DataFrame:
    return tag_rows(resolve_names(classify_rows(clean_cells(rows)), inventory))


def _fields(columns: dict[str, int]) -> list[Column]:
    return [F.col(f"c{index}").alias(key) for key, index in columns.items()]


def side_payload(side: str) -> Column:
    fields = (
        F.struct(*_fields(K.FRONT_COLUMNS))
        if side == "front"
        else F.struct(*_fields(K.BACK_COLUMNS), F.struct(*_fields(K.MRZ_COLUMNS)).alias("mrz"))
    )
    return F.struct(
        F.lit(K.DOCUMENT_TYPE).alias("document_type"), F.lit(side).alias("side"), fields.alias("fields")
    )


def payload_json() -> Column:
    """Minified JSON of the row's side, nulls kept, fixed key order."""
    return F.when(F.col("side") == "front", F.to_json(side_payload("front"), KEPT_NULLS)).when(
        F.col("side") == "back", F.to_json(side_payload("back"), KEPT_NULLS)
    )


def build_payload(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col("reason").isNull()).withColumn("payload", payload_json())


def side_user_prompt(side: str) -> Column:
    """User prompt of a side; the schema text comes from the same rule as the payload."""
    schema = json.dumps(SIDE_TEMPLATES[side], ensure_ascii=False, separators=(",", ":"))
    return F.lit(K.SIDE_PROMPT.replace("{label}", side.upper()).replace("{schema}", schema))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_records(payloads: DataFrame, image_prefix: str = "images") -> DataFrame:
    """messages (system, user, assistant) and images, one record per accepted row."""
    prompt = F.when(F.col("side") == "front", side_user_prompt("front")).otherwise(side_user_prompt("back"))
    return payloads.select(
        "csv_row",
        "side",
        F.array(
            _message("system", F.lit(K.SYSTEM_PROMPT)),
            _message("user", prompt),
            _message("assistant", F.col("payload")),
        ).alias("messages"),
        F.array(F.concat(F.lit(f"{image_prefix}/"), F.col("path_name"))).alias("images"),
    )


def rejected_rows(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col("reason").isNotNull()).select(
        "csv_row",
        "reason",
        "image_name",
        F.when(F.col("reason").isin("blank_name", "missing_file"), F.col("side")).alias("side"),
        F.when(F.col("reason") == "mixed_side", F.lit("mixed front/back record is not supported")).alias("error"),
    )


def reason_counts(tagged: DataFrame) -> DataFrame:
    return (
        tagged.filter(F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("rejected"))
        .orderBy("reason")
    )


def unused_items(tagged: DataFrame, inventory: DataFrame) -> DataFrame:
    """Inventory names no accepted row uses, sorted."""
    used = tagged.filter(F.col("reason").isNull()).select(F.col("path_name").alias("name")).distinct()
    return inventory.select("name").distinct().join(used, "name", "left_anti").orderBy("name")


def qc_report(tagged: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row of counts. Label rows and listed names meet once, by the name that a row
    uses: counts add up per name, and a listed name without an accepted row is unused."""
    accepted = F.col("reason").isNull()
    rows = tagged.select(F.when(accepted, F.col("path_name")).alias("name"), "reason", "side", F.lit(True).alias("row"))
    listed = inventory.select("name", F.lit(False).alias("row"))
    marks = rows.unionByName(listed, allowMissingColumns=True)
    row = F.col("row")
    counts = {
        "csv_data_rows": row,
        **{f"{side}_source_rows": row & accepted & (F.col("side") == side) for side in K.SIDES},
        "discarded_rows": row & ~accepted,
        **{f"rejected_{reason}": row & (F.col("reason") == reason) for reason in K.REASONS},
    }
    # Tasks merge the rows of a name, rejected ones under NULL, before they send.
    names = marks.groupBy("name").agg(
        *[F.count_if(test).alias(name) for name, test in counts.items()],
        F.bool_or(~row).alias("_listed"),
        F.bool_or(row).alias("_used"),
    )
    unused = F.count_if(F.col("name").isNotNull() & F.col("_listed") & ~F.col("_used"))
    total = names.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counts], unused.alias("unused_images"))
    return total.select(
        "csv_data_rows",
        *[f"{side}_source_rows" for side in K.SIDES],
        *[F.col(f"{side}_source_rows").alias(f"{side}_train_records") for side in K.SIDES],
        "discarded_rows",
        "unused_images",
        *[f"rejected_{reason}" for reason in K.REASONS],
    )


def qc_document(report: DataFrame) -> DataFrame:
    """The report row as one JSON text. Rejected rows and unused names stay tables of
    their own, since they grow with the input."""
    counts = [name for name in report.columns if not name.startswith("rejected_")]
    reasons = F.map_filter(
        F.create_map(*[part for reason in K.REASONS for part in (F.lit(reason), F.col(f"rejected_{reason}"))]),
        lambda _, rows: rows > 0,
    )
    return report.select(
        F.to_json(
            F.struct(F.struct(*counts).alias("counts"), reasons.alias("discarded_reason_counts")),
            {"pretty": "true"},
        ).alias("report")
    )
