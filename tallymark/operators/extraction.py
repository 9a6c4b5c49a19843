"""Extracted payloads checked and normalised against a declared field list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark import constants as K
from tallymark.functions import payload as P
from tallymark.functions.text import quoted
from tallymark.operators.groups import FieldSpec


def _listed(keys: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(keys, quoted), ", "), F.lit("]"))


def _unexpected(types: Column, specs: list[FieldSpec], lead: str) -> Column:
    declared = P.texts([spec["field_key"] for spec in specs])
    extra = P.missing_keys(F.map_keys(types), declared)
    return F.when(F.size(extra) > 0, F.concat(F.lit(f"{lead} contains unexpected keys: "), _listed(extra)))


def _member(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f'$["{key}"]', "variant")


def _field_error(value: Column, types: Column, spec: FieldSpec) -> Column:
    """First problem of one field of an object with the given member types, NULL when
    it is fine."""
    key, kind, nullable = spec["field_key"], spec["data_type"], spec.get("nullable", True)
    actual = F.try_element_at(types, F.lit(key))
    suffix = " or null" if nullable else ""
    expected = "string" if kind in ("string", "date") else kind
    fits = {
        "string": actual == "STRING",
        "number": P.is_number(actual),
        "boolean": actual == "BOOLEAN",
        "array": actual == "ARRAY",
    }[expected]
    result = F.when(
        actual.isNull() | (actual == "VOID"), F.lit(None if nullable else f"{key} must not be null").cast("string")
    ).when(~fits, F.lit(f"{key} must be a {expected}{suffix}"))
    if kind == "array":
        items = F.try_variant_get(_member(value, key), "$", "array<variant>")
        errors = F.array_compact(F.transform(items, lambda item: _item_error(item, spec)))
        result = result.otherwise(F.try_element_at(errors, F.lit(1)))
    return result


def _item_error(item: Column, spec: FieldSpec) -> Column:
    key, children = spec["field_key"], spec.get("child_schema") or []

    def judged(types: Column) -> Column:
        return F.when(types.isNull(), F.lit(f"{key} array items must be objects")).otherwise(
            F.coalesce(
                _unexpected(types, children, f"{key} array item"),
                *[_field_error(item, types, child) for child in children],
            )
        )

    return P.bound(P.member_types(item), judged)


def _field_output(value: Column, spec: FieldSpec) -> Column:
    if spec["data_type"] != "array":
        return value
    items = F.try_variant_get(value, "$", "array<variant>")
    return F.transform(items, lambda item: _object_output(item, spec.get("child_schema") or []))


def _object_output(value: Column, specs: list[FieldSpec]) -> Column:
    return F.struct(
        *[_field_output(_member(value, spec["field_key"]), spec).alias(spec["field_key"]) for spec in specs]
    )


def _by_group(groups: dict[str, list[FieldSpec]], build) -> Column:
    result = None
    for code, specs in groups.items():
        matches = F.col("document_code") == code
        branch = build(code, specs)
        result = F.when(matches, branch) if result is None else result.when(matches, branch)
    return result


def normalize_extracted(
    payloads: DataFrame, groups: dict[str, list[FieldSpec]], text: str = "payload_text"
) -> DataFrame:
    """Adds extraction_error and extracted_data (JSON, declared order, gaps as null).

    The field lists are compiled once into one CASE over document_code: no shuffle and
    no Python. Values are type-checked as VARIANT, before anything could coerce them.
    """
    value, types = F.col("_value"), F.col("_types")

    def error(code: str, specs: list[FieldSpec]) -> Column:
        if code == "unknown" and not specs:
            return unknown_error(value)
        return F.coalesce(
            _unexpected(types, specs, "extracted_data"),
            *[_field_error(value, types, spec) for spec in specs],
        )

    def output(code: str, specs: list[FieldSpec]) -> Column:
        if code == "unknown" and not specs:
            return F.col(text)
        return F.to_json(_object_output(value, specs), P.KEPT_NULLS)

    typed = P.add_object(payloads, text, "_value").withColumn("_types", P.member_types(value))
    checked = typed.withColumn(
        "extraction_error",
        F.when(F.col("_value").isNull(), F.lit("payload is not a JSON object"))
        .when(~F.col("document_code").isin(*groups), F.lit("document_code has no field list"))
        .otherwise(_by_group(groups, error)),
    )
    return checked.withColumn(
        "extracted_data", F.when(F.col("extraction_error").isNull(), _by_group(groups, output))
    ).drop("_value", "_types")


def _has_keys(value: Column, keys: tuple[str, ...]) -> Column:
    found = F.sort_array(F.map_keys(P.members(value)))
    return F.coalesce(found == P.texts(sorted(keys)), F.lit(False))


def _items(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "array<variant>")


def unknown_error(value: Column) -> Column:
    """First structural problem of a free-form payload (fields and tables)."""

    def any_bad(items: Column, test) -> Column:
        return F.coalesce(F.exists(items, test), F.lit(False))

    def table_error(table: Column) -> Column:
        columns, rows = _items(table, "columns"), _items(table, "rows")

        def row_error(row: Column) -> Column:
            cells = _items(row, "cells")
            return F.when(
                ~_has_keys(row, K.UNKNOWN_ROW_KEYS) | cells.isNull(), F.lit("unknown table rows must contain cells")
            ).when(
                any_bad(cells, lambda cell: ~_has_keys(cell, K.UNKNOWN_CELL_KEYS)),
                F.lit("unknown table row cells must contain key and value"),
            )

        return (
            F.when(
                ~_has_keys(table, K.UNKNOWN_TABLE_KEYS),
                F.lit("unknown tables must contain table_key, table_name, columns, and rows"),
            )
            .when(columns.isNull() | rows.isNull(), F.lit("unknown table columns and rows must be arrays"))
            .when(
                any_bad(columns, lambda column: ~_has_keys(column, K.UNKNOWN_COLUMN_KEYS)),
                F.lit("unknown table columns must contain key and label"),
            )
            .otherwise(F.try_element_at(F.array_compact(F.transform(rows, row_error)), F.lit(1)))
        )

    fields, tables = _items(value, "fields"), _items(value, "tables")
    return (
        F.when(~_has_keys(value, K.UNKNOWN_KEYS), F.lit("unknown extracted_data must contain fields and tables"))
        .when(fields.isNull() | tables.isNull(), F.lit("unknown fields and tables must be arrays"))
        .when(
            any_bad(fields, lambda field: ~_has_keys(field, K.UNKNOWN_FIELD_KEYS)),
            F.lit("unknown fields must contain field_key, field_name, and value"),
        )
        .otherwise(F.try_element_at(F.array_compact(F.transform(tables, table_error)), F.lit(1)))
    )


def check_unknown(payloads: DataFrame, text: str = "payload_text") -> DataFrame:
    """Adds structure_error for free-form payloads."""
    value = F.col("_value")
    error = F.when(value.isNull(), F.lit("payload is not a JSON object")).otherwise(unknown_error(value))
    return P.add_object(payloads, text, "_value").withColumn("structure_error", error).drop("_value")


def emit_documents(documents: DataFrame) -> DataFrame:
    """One JSON text per extracted document; null field values stay visible. A rejected
    document keeps its row, with its error and no text. The data is put in as text,
    since a VARIANT would not keep the declared key order."""
    head = F.to_json(
        F.struct("document_code", "group_name", "document_name", "page_order", "duplicate_pages"), P.KEPT_NULLS
    )
    return documents.withColumn("_head", head).select(
        "file_id",
        "doc_no",
        F.concat(
            F.left("_head", F.length("_head") - 1), F.lit(',"extracted_data":'), F.col("extracted_data"), F.lit("}")
        ).alias("document"),
        "extraction_error",
    )
