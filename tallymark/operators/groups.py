"""Document group definitions: as tables (checks, paths, prompts) and as a spec that
is compiled into column expressions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark import constants as K
from tallymark.functions.text import fold_key, strip

FieldSpec = dict[str, Any]
MAX_LIST_CHARS = 1 << 20

# Tables used here:
#   groups    group_code, group_name, group_description
#   variants  group_code, position, name, description
#   fields    group_code, parent (NULL at the top, else the path of an array field),
#             position, field_key, data_type, field_name, description, nullable, required


# --- strict response formats --------------------------------------------------------


def _closed_object(properties: dict[str, Any]) -> dict[str, Any]:
    return {
        "type": "object",
        "properties": properties,
        "required": list(properties),
        "additionalProperties": False,
    }


def _strict(name: str, schema: dict[str, Any]) -> dict[str, Any]:
    return {"type": "json_schema", "json_schema": {"name": name, "strict": True, "schema": schema}}


def _or_null(schema: dict[str, Any]) -> dict[str, Any]:
    return {"anyOf": [schema, {"type": "null"}]}


def template_schema(template: dict[str, Any]) -> dict[str, Any]:
    """Closed JSON schema of a template (None = nullable text, text = constant)."""
    properties: dict[str, Any] = {}
    for key, item in template.items():
        if isinstance(item, dict):
            properties[key] = template_schema(item)
        elif item is None:
            properties[key] = _or_null({"type": "string"})
        else:
            properties[key] = {"type": "string", "enum": [item]}
    return _closed_object(properties)


def side_format(template: dict[str, Any]) -> dict[str, Any]:
    return _strict(f"{template['document_type']}_{template['side']}_extraction", template_schema(template))


def field_schema(spec: FieldSpec) -> dict[str, Any]:
    kind = spec["data_type"]
    if kind == "array":
        children = {child["field_key"]: field_schema(child) for child in spec.get("child_schema") or []}
        schema: dict[str, Any] = {"type": "array", "items": _closed_object(children)}
    else:
        schema = {"type": kind if kind in ("number", "boolean") else "string"}
    hint = spec.get("description") or spec.get("field_name")
    if hint:
        schema["description"] = hint
    return _or_null(schema) if spec.get("nullable", True) else schema


def extraction_format(group: dict[str, Any]) -> dict[str, Any]:
    fields = group.get("fields") or []
    if group["group_code"] == "unknown" and not fields:
        schema = _unknown_schema()
    else:
        schema = _closed_object({spec["field_key"]: field_schema(spec) for spec in fields})
    return _strict(f"ocr_v1_extract_{group['group_code']}", schema)


def _unknown_schema() -> dict[str, Any]:
    def texts(keys: tuple[str, ...]) -> dict[str, Any]:
        return {key: {"type": "string"} for key in keys}

    def list_of(properties: dict[str, Any]) -> dict[str, Any]:
        return {"type": "array", "items": _closed_object(properties)}

    row = {"cells": list_of(texts(K.UNKNOWN_CELL_KEYS))}
    table = {
        **texts(K.UNKNOWN_TABLE_KEYS[:2]),
        "columns": list_of(texts(K.UNKNOWN_COLUMN_KEYS)),
        "rows": list_of(row),
    }
    return _closed_object({"fields": list_of(texts(K.UNKNOWN_FIELD_KEYS)), "tables": list_of(table)})


def classify_format(groups: list[dict[str, Any]]) -> dict[str, Any]:
    integer = {"type": "integer"}
    pair = {"type": "array", "items": integer, "minItems": 2, "maxItems": 2}
    document = _closed_object(
        {
            "document_code": {"type": "string", "enum": [group["group_code"] for group in groups]},
            "group_name": {"type": "string", "enum": [group["group_name"] for group in groups]},
            "document_name": {"type": "string"},
            "page_ranges": {"type": "array", "items": pair},
            "page_order": {"type": "array", "items": integer},
            "duplicate_pages": {
                "type": "array",
                "items": _closed_object({"page": integer, "duplicate_of": integer}),
            },
        }
    )
    return _strict("ocr_v1_classify_segment", _closed_object({"documents": {"type": "array", "items": document}}))


# --- definitions as tables ----------------------------------------------------------


def schema_paths(fields: DataFrame) -> DataFrame:
    """Expected path and JSON type of every declared field; array members as parent[]."""
    kind = F.col("data_type")
    return fields.select(
        "group_code",
        _path().alias("path"),
        F.when(kind.isin("number", "boolean", "array"), kind).otherwise(F.lit("string")).alias("json_type"),
        F.coalesce("nullable", F.lit(True)).alias("nullable"),
        F.coalesce(F.nullif("description", F.lit("")), "field_name").alias("description"),
    )


def duplicate_keys(df: DataFrame, scope: list[str], key: str) -> DataFrame:
    """Keys that occur more than once within their scope (counts merge map-side)."""
    return df.groupBy(*scope, key).agg(F.count(F.lit(1)).alias("uses")).filter(F.col("uses") > 1)


def duplicate_variants(variants: DataFrame) -> DataFrame:
    named = variants.groupBy("group_code", F.col("name").alias("name")).agg(F.count(F.lit(1)).alias("_uses"))
    return (
        named.withColumn("folded", fold_key(strip(F.col("name"))))
        .groupBy("group_code", "folded")
        .agg(F.sum("_uses").alias("uses"))
        .filter(F.col("uses") > 1)
    )


def schema_def_check(groups: DataFrame, fields: DataFrame, variants: DataFrame) -> DataFrame:
    """One row per violated rule: group_code, item, problem."""

    def problems(df: DataFrame, item: Column, *rules: tuple[Column, str]) -> DataFrame:
        found = F.array_compact(F.array(*[F.when(broken, F.lit(text)) for broken, text in rules]))
        return df.select("group_code", item.cast("string").alias("item"), F.explode(found).alias("problem"))

    def blank(name: str) -> Column:
        return F.coalesce(strip(F.col(name)), F.lit("")) == ""

    nested = fields.filter(F.col("parent").isNotNull()).select("group_code", F.col("parent").alias("path"))
    parents = nested.distinct().withColumn("_has_children", F.lit(True))
    with_children = fields.withColumn("path", _path()).join(parents, ["group_code", "path"], "left")
    has_children = F.col("_has_children").isNotNull()
    is_array = F.col("data_type") == "array"
    covered = fields.filter(F.col("parent").isNull()).select("group_code").distinct()
    top = fields.filter(F.col("parent").isNull())

    def repeated(df: DataFrame, item: Column, text: str) -> DataFrame:
        return df.select("group_code", item.cast("string").alias("item"), F.lit(text).alias("problem"))

    pieces = [
        problems(
            groups,
            F.lit(None),
            (~F.coalesce(strip(F.col("group_code")).rlike(K.GROUP_CODE_PATTERN), F.lit(False)),
             "group_code must match pattern " + K.GROUP_CODE_PATTERN),
            (blank("group_name") | blank("group_description"), "group_name and group_description must not be empty"),
        ),
        problems(
            with_children,
            F.col("path"),
            (blank("field_key"), "field_key must not be empty"),
            (~F.coalesce(F.col("data_type").isin(*K.FIELD_TYPES), F.lit(False)), "data_type is not supported"),
            (~F.coalesce("required", F.lit(True)), "required=False is not supported with strict structured output"),
            (is_array & ~has_children, "child_schema is required when data_type is 'array'"),
            (~is_array & has_children, "child_schema is only allowed when data_type is 'array'"),
        ),
        problems(variants, F.col("position"), (blank("name"), "variant name must not be empty")),
        repeated(
            groups.filter(F.col("group_code") != "unknown").select("group_code").distinct().join(covered, "group_code", "left_anti"),
            F.lit(None),
            "fields must contain at least one field for non-unknown groups",
        ),
        repeated(duplicate_keys(groups, [], "group_code"), F.lit(None), "group_code values must be unique"),
        repeated(duplicate_keys(top, ["group_code"], "field_key"), F.col("field_key"), "field_key values must be unique per group"),
        repeated(duplicate_variants(variants), F.col("folded"), "variant name values must be unique per group"),
    ]
    result = pieces[0]
    for piece in pieces[1:]:
        result = result.unionByName(piece)
    return result


# --- prompts --------------------------------------------------------------------------


def _joined(sort_key: str, text: str, separator: str) -> Column:
    """Texts of a group in order. Groups here are the fields or variants of one
    definition, which are unique by rule and written by hand."""
    pairs = F.sort_array(F.collect_list(F.struct(sort_key, text)))
    return F.array_join(F.transform(pairs, lambda pair: pair[text]), separator)


def _path() -> Column:
    return F.concat(F.coalesce(F.concat("parent", F.lit("[].")), F.lit("")), F.col("field_key"))


def field_lines(fields: DataFrame) -> DataFrame:
    """Description line of every top-level field with its members at any depth.

    A field's place is the list of its ancestors' positions. An array opens at its place
    and closes behind all places that begin with it, any other field stands at its place;
    so a line is the texts below one top-level field in the order of their places. Fields
    below something that is no declared array have no place; schema_def_check names them.
    """
    hint = F.coalesce(F.nullif("description", F.lit("")), F.nullif("field_name", F.lit("")))
    parts = F.split("parent", r"\[\]\.")
    above = F.when(F.col("parent").isNull(), F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "[]."))
    )
    base = fields.select(
        "group_code", "position", "field_key", "data_type", _path().alias("path"), hint.alias("hint"), above.alias("above")
    ).withColumn("_id", F.xxhash64("group_code", "path", "position", "data_type", "hint"))
    arrays = (
        base.filter(F.col("data_type") == "array")
        .groupBy("group_code", F.col("path").alias("up"))
        .agg(F.min("position").alias("up_position"), F.min("field_key").alias("up_key"))
    )
    climbed = base.select("*", F.posexplode_outer("above").alias("step", "up")).join(arrays, ["group_code", "up"], "left")
    # As many rows as a field has ancestors.
    step = F.struct("step", F.col("up_position").alias("position"), F.col("up_key").alias("key"))
    same = ["group_code", "_id", "path", "position", "field_key", "data_type", "hint", "above"]
    placed = climbed.groupBy(*same).agg(F.sort_array(F.collect_list(F.when(F.col("up_key").isNotNull(), step))).alias("_steps"))
    here = F.transform("_steps", lambda x: F.struct(x["position"].alias("position"), x["key"].alias("key")))
    own = F.struct(F.col("position"), F.col("field_key").alias("key"))
    rooted = placed.filter(F.size("_steps") == F.size("above")).withColumn("place", F.array_append(here, own))
    array = F.col("data_type") == "array"
    head = F.concat(F.lit("- "), F.col("field_key"), F.lit(" ("))
    told = F.concat(F.lit(")"), F.coalesce(F.concat(F.lit(" - Hint: "), F.col("hint")), F.lit("")))
    end = F.struct(F.lit(2**31 - 1).alias("position"), F.lit("").alias("key"))

    def event(place: Column, kind: str, text: Column) -> Column:
        return F.struct(place.alias("place"), F.lit(kind).alias("kind"), text.alias("text"))

    opened = event(F.col("place"), "open", F.concat(head, F.lit("array of objects: ")))
    closed = event(F.array_append(F.col("place"), end), "shut", told)
    plain = event(F.col("place"), "whole", F.concat(head, F.col("data_type"), told))
    events = rooted.select(
        "group_code", F.get("place", F.lit(0)).alias("top"), F.inline(F.when(array, F.array(opened, closed)).otherwise(F.array(plain)))
    )
    lists = events.groupBy("group_code", "top").agg(F.sort_array(F.collect_list(F.struct("place", "kind", "text"))).alias("_all"))

    def spoken(x: Column, i: Column) -> Column:
        follows = (i > 0) & (x["kind"] != "shut") & (F.get("_all", i - 1)["kind"] != "open")
        return F.concat(F.when(follows, F.lit(", ")).otherwise(F.lit("")), x["text"])

    return lists.select(
        "group_code", F.col("top.position").alias("position"), F.array_join(F.transform("_all", spoken), "").alias("line")
    )


def group_descriptions(groups: DataFrame, fields: DataFrame) -> DataFrame:
    """group_code, group_name, description text of its fields; one row per code, the
    first name of a code that is defined twice (which schema_def_check reports)."""
    groups = groups.groupBy("group_code").agg(F.min("group_name").alias("group_name"))
    lines = field_lines(fields).groupBy("group_code").agg(_joined("position", "line", "\n").alias("_lines"))
    return groups.join(lines, "group_code", "left").select(
        "group_code",
        "group_name",
        F.coalesce(
            "_lines",
            F.when(F.col("group_code") == "unknown", F.lit(K.EXTRACT_PROMPT_UNKNOWN)),
            F.lit(""),
        ).alias("schema_description"),
    )


def fill(template: str, **values: Column) -> Column:
    """Text with {name} marks replaced by columns, as one concatenation."""
    parts: list[Column] = []
    rest = template
    while rest:
        hits = [(rest.find("{" + name + "}"), name) for name in values if "{" + name + "}" in rest]
        if not hits:
            parts.append(F.lit(rest))
            break
        position, name = min(hits)
        parts += [F.lit(rest[:position]), values[name]]
        rest = rest[position + len(name) + 2 :]
    return F.concat(*parts)


def extraction_prompts(documents: DataFrame, descriptions: DataFrame) -> DataFrame:
    """One extraction prompt per document; documents: file_id, doc_no, document_code,
    document_name, page_order."""
    from tallymark.operators.skew import lookup_join

    known = descriptions.withColumnRenamed("group_code", "document_code").withColumnRenamed("group_name", "_canonical")
    joined = lookup_join(documents, known, ["document_code"], ["file_id", "doc_no"], "inner")
    pages = F.concat(F.lit("["), F.array_join(F.transform("page_order", lambda p: p.cast("string")), ", "), F.lit("]"))
    head = fill(
        K.EXTRACT_PROMPT_HEAD,
        document_code=F.col("document_code"),
        group_name=F.col("_canonical"),
        document_name=F.col("document_name"),
        page_order=pages,
    )
    return joined.select(
        *documents.columns,
        F.concat(head, F.col("schema_description"), F.lit(K.EXTRACT_PROMPT_TAIL)).alias("prompt"),
    )


def group_blocks(groups: DataFrame, variants: DataFrame) -> DataFrame:
    """The paragraph a classification prompt holds for each group."""
    title = F.when(
        F.coalesce(F.col("description"), F.lit("")) != "",
        F.concat(F.col("name"), F.lit(" ("), F.col("description"), F.lit(")")),
    ).otherwise(F.col("name"))
    titles = variants.withColumn("title", title).groupBy("group_code").agg(_joined("position", "title", ", ").alias("_titles"))
    return groups.join(titles, "group_code", "left").select(
        "group_code",
        F.concat(
            F.lit('- group_code/document_code: "'), F.col("group_code"),
            F.lit('"\n  group_name: '), F.col("group_name"),
            F.lit("\n  group_description: "), F.col("group_description"),
            F.lit("\n  variants/sample titles: "), F.coalesce(F.nullif("_titles", F.lit("")), F.lit("None")),
        ).alias("block"),
    )


def group_list(blocks: DataFrame) -> Column:
    """The blocks of all groups as one text, as a scalar subquery: one aggregated row that
    the plan puts into every prompt. Groups are part of a request, written by hand; a list
    beyond MAX_LIST_CHARS is an error."""
    ordered = F.sort_array(F.collect_list(F.struct("group_code", "block")))
    text = F.array_join(F.transform(ordered, lambda pair: pair["block"]), "\n")
    total = F.coalesce(F.sum(F.length("block")), F.lit(0))
    checked = F.when(total <= MAX_LIST_CHARS, text).otherwise(F.raise_error(F.lit("the list of groups is too long")))
    return blocks.agg(checked.alias("list")).scalar()


def classify_prompts(files: DataFrame, group_list: Column) -> DataFrame:
    """One classification prompt per file; group_list is the text of all group blocks."""
    head = fill(K.CLASSIFY_PROMPT_HEAD, page_count=F.col("n_pages").cast("string"))
    return files.withColumn("prompt", F.concat(head, group_list, F.lit(K.CLASSIFY_PROMPT_TAIL)))
