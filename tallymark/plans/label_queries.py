"""Queries of the dataset build, with their checks."""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark import constants as K
from tallymark.functions import text as X
from tallymark.functions.urls import data_url
from tallymark.operators import labels as L
from tallymark.operators import scoring as S
from tallymark.operators.groups import side_format
from tallymark.operators.skew import lookup_join
from tallymark.plans.fixtures import load, with_clause
from tallymark.session import new_shared_path
from tallymark.sources import readers as R
from tallymark.sources import writers as W

_USED = ("c0", "c1", "c2", "c3", "c9", "c11", "c13")


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "f_labels")


def _tagged(spark: SparkSession, folder: str) -> DataFrame:
    return L.tagged_labels(_rows(spark, folder), load(spark, folder, "f_inventory"))


def clean_cells(spark: SparkSession, folder: str) -> DataFrame:
    return L.clean_cells(_rows(spark, folder)).select("csv_row", *_USED)


def norm_key(spark: SparkSession, folder: str) -> DataFrame:
    names = load(spark, folder, "f_labels").select("csv_row", "c0")
    return names.select("csv_row", X.fold_key("c0").alias("name_key"))


def norm_text(spark: SparkSession, folder: str) -> DataFrame:
    return R.table(spark, folder, "documents").select("doc_id", X.fold_text("text").alias("normalized"))


def classify_rows(spark: SparkSession, folder: str) -> DataFrame:
    return L.classify_rows(L.clean_cells(_rows(spark, folder))).select("csv_row", "side", "mixed_side", "image_name")


def resolve_names(spark: SparkSession, folder: str) -> DataFrame:
    return _tagged(spark, folder).select("csv_row", "image_name", "path_name", "resolution", "reason")


def ambiguous_keys(spark: SparkSession, folder: str) -> DataFrame:
    return L.ambiguous_keys(load(spark, folder, "f_part_names"))


def build_payload(spark: SparkSession, folder: str) -> DataFrame:
    return L.build_payload(_tagged(spark, folder)).select("csv_row", "side", "payload")


def chat_records(spark: SparkSession, folder: str) -> DataFrame:
    records = L.chat_records(L.build_payload(_tagged(spark, folder)))
    return records.select(
        "csv_row",
        "side",
        F.element_at("messages", 1)["content"].alias("system_text"),
        F.element_at("messages", 2)["content"].alias("user_text"),
        F.element_at("messages", 3)["content"].alias("assistant_text"),
        F.array_join("images", ",").alias("images"),
    )


def chat_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    """Written as JSON lines per side and read back with line numbers."""
    out = new_shared_path(spark, "chat")
    W.write_lines(W.chat_lines(L.chat_records(L.build_payload(_tagged(spark, folder)))), out, by=["side"])
    records = R.read_chat_records(spark, out)
    # Lines of a file are numbered 1 to n: as many numbers as lines, none beyond.
    per_file = records.groupBy("file_name").agg(
        (
            (F.min("line_number") == 1)
            & (F.max("line_number") == F.count(F.lit(1)))
            & (F.sum("line_number") * 2 == F.count(F.lit(1)) * (F.count(F.lit(1)) + 1))
        ).alias("numbered")
    )
    return lookup_join(records, per_file, ["file_name"], ["line_number"], "left").select(
        F.get_json_object(F.element_at("messages", 3)["content"], "$.side").alias("side"),
        F.element_at("messages", 3)["content"].alias("assistant_text"),
        F.element_at("images", 1).alias("image"),
        F.size("messages").cast("bigint").alias("turns"),
        "numbered",
    )


def request_batch(spark: SparkSession, folder: str) -> DataFrame:
    records = L.chat_records(L.build_payload(_tagged(spark, folder)))
    return S.request_batch(records, "local-vision")


def reason_counts(spark: SparkSession, folder: str) -> DataFrame:
    return L.reason_counts(_tagged(spark, folder))


def unused_items(spark: SparkSession, folder: str) -> DataFrame:
    return L.unused_items(_tagged(spark, folder), load(spark, folder, "f_inventory"))


def qc_report(spark: SparkSession, folder: str) -> DataFrame:
    inventory = load(spark, folder, "f_inventory")
    return L.qc_report(_tagged(spark, folder), inventory)


def dataset_build(spark: SparkSession, folder: str) -> DataFrame:
    """The whole build written to a folder and read back: how many records per side, rejected
    rows per reason and unused names it holds, and the counts of its report."""
    out = new_shared_path(spark, "build")
    parts = W.build_dataset(_rows(spark, folder), load(spark, folder, "f_inventory"), out)
    one = F.count(F.lit(1)).alias("n")
    records = R.read_chat_records(spark, f"{parts['records']}/side=*").withColumn(
        "key", F.regexp_extract("file_name", "side=([a-z]+)/", 1)
    )
    rejected = spark.read.schema("reason string").json(parts["rejected"])
    unused = spark.read.schema("name string").json(parts["unused"])
    counts = "map<string,bigint>"
    report = spark.read.schema(f"counts {counts}, discarded_reason_counts {counts}").option("multiLine", True).json(parts["report"])
    pieces = {
        "records": records.groupBy("key").agg(one),
        "rejected": rejected.groupBy(F.col("reason").alias("key")).agg(one),
        "unused": unused.groupBy(F.lit("names").alias("key")).agg(one),
        "report": report.select(F.explode("counts").alias("key", "n")),
        "reasons": report.select(F.explode("discarded_reason_counts").alias("key", "n")),
    }
    marked = [frame.select(F.lit(part).alias("part"), "key", "n") for part, frame in pieces.items()]
    return functools.reduce(DataFrame.unionByName, marked)


def csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Label rows written as CSV, with line breaks and quotes inside cells, and scanned back
    with all their cells. `place` is the record's number, counted on from file to file."""
    out = new_shared_path(spark, "labels")
    rows = _rows(spark, folder)
    third, key = F.col("csv_row") % 3 == 0, L.LABEL_COLUMNS[-1]
    number = F.col("csv_row").cast("string")
    broken = F.concat_ws("", "c2", F.lit('\n"'), "c0", F.lit('", '), number)
    full = rows.withColumns(
        {"c2": F.when(third, broken).otherwise(F.col("c2")), "c15": F.when(third, F.concat(F.lit("\n\n"), number)), key: number}
    )
    none = F.lit(None).cast("string")
    cells = [F.col(name) if name in full.columns else none.alias(name) for name in L.LABEL_COLUMNS]
    ordered = full.repartitionByRange("csv_row").sortWithinPartitions("csv_row")
    ordered.select(*cells).write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(out)
    scanned = R.read_labels(spark, out)
    first = scanned.groupBy("file_name").agg(F.min(F.col(key).cast("long")).alias("first"))
    placed = lookup_join(scanned, first, ["file_name"], ["csv_row"], "left")
    return placed.select((F.col("csv_row") - 2 + F.col("first")).alias("place"), *_USED, "c15", key)


def jsonl_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as JSON lines, scanned back with 1-based line numbers."""
    out = new_shared_path(spark, "turns")
    turns = R.table(spark, folder, "conversations")
    W.write_lines(turns.select(F.to_json(F.struct("*")).alias("line")), out)
    lines = R.read_json_lines(spark, out).select(
        "file_name",
        "line_number",
        F.from_json("text", "conv_id bigint, turn bigint, role string, text string").alias("r"),
    )
    totals = lines.groupBy("r.role").agg(
        F.count(F.lit(1)).alias("turns"), F.sum(F.length("r.text")).alias("chars"), F.min("line_number").alias("_first")
    )
    return totals.select("role", "turns", "chars", (F.col("_first") >= 1).alias("numbered"))


def page_data_url(spark: SparkSession, folder: str) -> DataFrame:
    pages = R.table(spark, folder, "pages")
    name = F.concat(F.lit("page"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".html").otherwise(".bin"))
    return pages.select("page_id", data_url(F.encode("html", "utf-8"), name).alias("data_url"))


QUERIES = {
    "csv_scan": csv_scan,
    "dataset_build": dataset_build,
    "jsonl_scan": jsonl_scan,
    "clean_cells": clean_cells,
    "norm_key": norm_key,
    "norm_text": norm_text,
    "classify_rows": classify_rows,
    "resolve_names": resolve_names,
    "ambiguous_keys": ambiguous_keys,
    "build_payload": build_payload,
    "chat_records": chat_records,
    "chat_jsonl": chat_jsonl,
    "request_batch": request_batch,
    "reason_counts": reason_counts,
    "unused_items": unused_items,
    "qc_report": qc_report,
    "data_url": page_data_url,
}

# --- checks ---------------------------------------------------------------------------


def _clean(column: str) -> str:
    return f"nullif(trim({column}), '')"


_CLEANED = "cleaned AS (SELECT csv_row, " + ", ".join(f"{_clean(c)} AS {c}" for c in _USED) + " FROM f_labels)"
_CLASSIFIED = """classified AS (SELECT *,
  (c1 IS NOT NULL OR c2 IS NOT NULL OR c3 IS NOT NULL) AS front, (c9 IS NOT NULL OR c13 IS NOT NULL) AS back,
  coalesce(c0, c11) AS image_name FROM cleaned)"""
_TAGGED = """tagged AS (SELECT c.*,
  CASE WHEN front AND NOT back THEN 'front' WHEN back AND NOT front THEN 'back' END AS side,
  CASE WHEN image_name IS NULL THEN NULL ELSE coalesce(e.name, k.name) END AS path_name,
  CASE WHEN image_name IS NULL THEN 'blank_name' WHEN e.name IS NOT NULL THEN 'exact_match'
       WHEN k.name IS NOT NULL THEN 'normalized_match' ELSE 'missing_file' END AS resolution
  FROM classified c LEFT JOIN f_inventory e ON c.image_name = e.name
  LEFT JOIN (SELECT lower(name) AS key, max(name) AS name FROM f_inventory GROUP BY 1) k ON lower(c.image_name) = k.key)"""
_REASONED = """reasoned AS (SELECT *, CASE WHEN front AND back THEN 'mixed_side' WHEN path_name IS NULL THEN resolution
  WHEN side IS NULL THEN 'no_side_data' END AS reason FROM tagged)"""
_LABELS = f"{with_clause('f_labels', 'f_inventory')}, {_CLEANED}, {_CLASSIFIED}, {_TAGGED}, {_REASONED}"


def _json_or_null(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN 'null' ELSE concat('\"', {column}, '\"') END"


def _payload_sql(side: str) -> str:
    have = {f"c{i}" for i in (1, 2, 3, 9, 13)}

    def members(columns: dict[str, int]) -> str:
        parts = []
        for key, index in columns.items():
            value = _json_or_null(f"c{index}") if f"c{index}" in have else "'null'"
            parts.append(f"'\"{key}\":', {value}")
        return ", ',', ".join(parts)

    if side == "front":
        inner = members(K.FRONT_COLUMNS)
    else:
        inner = members(K.BACK_COLUMNS) + ", ',\"mrz\":{', " + members(K.MRZ_COLUMNS) + ", '}'"
    return f"concat('{{\"document_type\":\"cccd\",\"side\":\"{side}\",\"fields\":{{', {inner}, '}}}}')"


_PAYLOAD = f"CASE WHEN side = 'front' THEN {_payload_sql('front')} ELSE {_payload_sql('back')} END"


def _literal(text: str) -> str:
    """A SQL text literal; line breaks are spelled, so both dialects agree."""
    return "concat('" + text.replace("'", "''").replace("\n", "', chr(10), '") + "')"


def _user_prompt(side: str) -> str:
    schema = json.dumps(L.SIDE_TEMPLATES[side], separators=(",", ":"))
    return _literal(K.SIDE_PROMPT.replace("{label}", side.upper()).replace("{schema}", schema))


def _request_sql(side: str) -> str:
    schema = json.dumps(L.SIDE_TEMPLATES[side], separators=(",", ":"))
    prompt = K.SIDE_PROMPT.replace("{label}", side.upper()).replace("{schema}", schema).replace("<image>\n", "")
    head = (
        '{"model":"local-vision","messages":[{"role":"system","content":' + json.dumps(K.SYSTEM_PROMPT)
        + '},{"role":"user","content":[{"type":"text","text":' + json.dumps(prompt)
        + '},{"type":"image_url","image_url":{"url":"images/'
    )
    tail = (
        '"}}]}],"temperature":0,"max_tokens":1024,"response_format":'
        + json.dumps(side_format(L.SIDE_TEMPLATES[side]), separators=(",", ":")) + "}"
    )
    return f"concat({_literal(head)}, path_name, {_literal(tail)})"


_FOLDED = "replace(lower({0}), 'ß', 'ss')"

CHECKS = {
    "csv_scan": f"""{with_clause('f_labels')} SELECT csv_row AS place, c0, c1,
 CASE WHEN csv_row % 3 = 0 THEN concat(c2, chr(10), '"', c0, '", ', csv_row) ELSE c2 END AS c2, c3, c9, c11, c13,
 CASE WHEN csv_row % 3 = 0 THEN concat(chr(10), chr(10), csv_row) END AS c15, cast(csv_row AS varchar) AS c29 FROM f_labels""",
    "jsonl_scan": "SELECT role, count(*) AS turns, cast(sum(length(text)) AS bigint) AS chars, true AS numbered FROM conversations GROUP BY role",
    "clean_cells": f"{with_clause('f_labels')}, {_CLEANED} SELECT csv_row, {', '.join(_USED)} FROM cleaned",
    "norm_key": f"{with_clause('f_labels')} SELECT csv_row, {_FOLDED.format('c0')} AS name_key FROM f_labels",
    "norm_text": "SELECT doc_id, replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss') AS normalized FROM documents",
    "classify_rows": f"{_LABELS} SELECT csv_row, side, (front AND back) AS mixed_side, image_name FROM tagged",
    "resolve_names": f"{_LABELS} SELECT csv_row, image_name, path_name, resolution, reason FROM reasoned",
    "ambiguous_keys": f"{with_clause('f_part_names')} SELECT lower(name) AS key, count(DISTINCT name) AS names, min(name) AS first_name, max(name) AS last_name FROM f_part_names GROUP BY 1 HAVING count(DISTINCT name) > 1",
    "build_payload": f"{_LABELS} SELECT csv_row, side, {_PAYLOAD} AS payload FROM reasoned WHERE reason IS NULL",
    "chat_records": f"{_LABELS} SELECT csv_row, side, {_literal(K.SYSTEM_PROMPT)} AS system_text, CASE WHEN side = 'front' THEN {_user_prompt('front')} ELSE {_user_prompt('back')} END AS user_text, {_PAYLOAD} AS assistant_text, concat('images/', path_name) AS images FROM reasoned WHERE reason IS NULL",
    "chat_jsonl": f"{_LABELS} SELECT side, {_PAYLOAD} AS assistant_text, concat('images/', path_name) AS image, cast(3 AS bigint) AS turns, true AS numbered FROM reasoned WHERE reason IS NULL",
    "request_batch": f"{_LABELS} SELECT csv_row, side, CASE WHEN side = 'front' THEN {_request_sql('front')} ELSE {_request_sql('back')} END AS request, cast(NULL AS varchar) AS record_error FROM reasoned WHERE reason IS NULL",
    "reason_counts": f"{_LABELS} SELECT reason, count(*) AS rejected FROM reasoned WHERE reason IS NOT NULL GROUP BY reason",
    "unused_items": f"{_LABELS} SELECT name FROM f_inventory WHERE name NOT IN (SELECT path_name FROM reasoned WHERE reason IS NULL)",
    "qc_report": f"""{_LABELS}, unused AS (SELECT count(*) AS n FROM f_inventory WHERE name NOT IN (SELECT path_name FROM reasoned WHERE reason IS NULL))
SELECT count(*) AS csv_data_rows, count(*) FILTER (WHERE reason IS NULL AND side = 'front') AS front_source_rows,
 count(*) FILTER (WHERE reason IS NULL AND side = 'back') AS back_source_rows,
 count(*) FILTER (WHERE reason IS NULL AND side = 'front') AS front_train_records,
 count(*) FILTER (WHERE reason IS NULL AND side = 'back') AS back_train_records,
 count(reason) AS discarded_rows, (SELECT n FROM unused) AS unused_images,
 {', '.join(f"count(*) FILTER (WHERE reason = '{r}') AS rejected_{r}" for r in K.REASONS)} FROM reasoned""",
    "dataset_build": f"""{_LABELS}, unused AS (SELECT count(*) AS n FROM f_inventory WHERE name NOT IN (SELECT path_name FROM reasoned WHERE reason IS NULL)),
sides AS (SELECT side, count(*) AS n FROM reasoned WHERE reason IS NULL GROUP BY side),
lost AS (SELECT reason, count(*) AS n FROM reasoned WHERE reason IS NOT NULL GROUP BY reason)
SELECT 'records' AS part, side AS key, n FROM sides UNION ALL SELECT 'rejected', reason, n FROM lost UNION ALL SELECT 'reasons', reason, n FROM lost
UNION ALL SELECT 'unused', 'names', n FROM unused WHERE n > 0 UNION ALL SELECT 'report', 'unused_images', n FROM unused
UNION ALL SELECT 'report', 'csv_data_rows', count(*) FROM reasoned UNION ALL SELECT 'report', 'discarded_rows', count(reason) FROM reasoned
UNION ALL SELECT 'report', s || '_' || k, count(*) FILTER (WHERE reason IS NULL AND side = s) FROM reasoned,
  (SELECT * FROM (VALUES ('front'), ('back')) a(s)), (SELECT * FROM (VALUES ('source_rows'), ('train_records')) b(k)) GROUP BY s, k""",
    "data_url": "SELECT page_id, concat('data:', CASE WHEN page_id % 2 = 0 THEN 'text/html' ELSE 'application/octet-stream' END, ';base64,', to_base64(encode(html))) AS data_url FROM pages",
}
