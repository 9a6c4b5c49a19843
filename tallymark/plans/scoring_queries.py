"""Queries of reply parsing, schema checks and scoring, with their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import payload as P
from tallymark.operators import scoring as S
from tallymark.operators.labels import SIDE_TEMPLATES
from tallymark.plans.fixtures import load, with_clause
from tallymark.session import new_shared_path
from tallymark.sources import readers as R
from tallymark.sources import writers as W
from tallymark.sources.readers import table


def _truth(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "f_truth").select("line_number", "side", "image", "expected_text")


def _replies(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "f_replies")


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Truth rows with the recorded answer text, fence and all."""
    pairs = load(spark, folder, "f_truth").select("line_number", "side", "expected_text", F.col("response").alias("content"))
    return S.parse_replies(pairs)


def _details(spark: SparkSession, folder: str) -> DataFrame:
    return S.eval_details(_truth(spark, folder), _replies(spark, folder), load(spark, folder, "f_inventory"))


def role_pick(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    marked = turns.withColumn(
        "text",
        F.when((F.col("role") == "assistant") & (F.col("conv_id") % 3 > 0), F.to_json(F.struct("text")))
        .when(F.col("turn") % 2 == 0, F.concat(F.lit("<image>\n"), F.col("text")))
        .otherwise(F.col("text")),
    )
    return S.pick_roles_by_turn(marked).withColumn("system_texts", F.array_join("system_texts", "\n"))


def response_text(spark: SparkSession, folder: str) -> DataFrame:
    return S.reply_texts(_replies(spark, folder)).select("line_number", "side", "content", "refusal")


def response_parse(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).select("line_number", "side", "predicted_text", "parse_error")


def response_parse_tolerant(spark: SparkSession, folder: str) -> DataFrame:
    return S.parse_replies_tolerant(_replies(spark, folder)).select("line_number", "side", "payload_text", "parse_error")


def path_get(spark: SparkSession, folder: str) -> DataFrame:
    value = F.col("_value")
    return P.add_value(_parsed(spark, folder), F.col("predicted_text"), "_value").select(
        "line_number",
        P.text_at(value, "side").alias("side_value"),
        P.text_at(value, "fields.full_name").alias("full_name"),
        P.text_at(value, "fields.mrz.document_number").alias("document_number"),
        P.text_at(value, "side.full_name").alias("below_text"),
    )


def key_diff(spark: SparkSession, folder: str) -> DataFrame:
    diff = S.key_diff(_parsed(spark, folder))
    names = ("missing_keys", "extra_keys", "missing_fields", "extra_fields")
    return diff.select("line_number", *[F.array_join(name, ",").alias(name) for name in names])


def schema_errors(spark: SparkSession, folder: str) -> DataFrame:
    checked = S.check_schema(_parsed(spark, folder))
    return checked.select("line_number", "side", F.array_join("schema_errors", "; ").alias("schema_errors"))


def field_score(spark: SparkSession, folder: str) -> DataFrame:
    scored = S.score_fields(_parsed(spark, folder))
    missed = F.map_keys(F.map_filter("field_matches", lambda _, item: ~item["match"]))
    return scored.select(
        "line_number",
        "side",
        "matched_fields",
        "total_fields",
        F.round("field_accuracy", 6).alias("field_accuracy"),
        "exact_match",
        F.array_join(F.sort_array(missed), ",").alias("missed"),
    )


def eval_details(spark: SparkSession, folder: str) -> DataFrame:
    return _details(spark, folder).select(
        "line_number",
        "side",
        "image",
        "error",
        F.array_join("schema_errors", "; ").alias("schema_errors"),
        "http_ok",
        "request_success",
        "schema_success",
        "exact_match",
        "matched_fields",
        "total_fields",
        "latency_s",
    )


def eval_output(spark: SparkSession, folder: str) -> DataFrame:
    """Details and summary written as files; every line read back."""
    details = _details(spark, folder)
    out = W.write_evaluation(details, S.eval_summary(details), new_shared_path(spark, "evaluation"))
    rows = R.read_json_lines(spark, out["details"]).select("text")
    kept = ("side", "error", "request_success", "exact_match", "matched_fields", "total_fields")
    read = rows.select(F.get_json_object("text", "$.line_number").cast("bigint").alias("line_number"), *[F.get_json_object("text", f"$.{name}").alias(name) for name in kept])
    splits = spark.read.text(out["summary"]).select(
        F.lit(None).cast("bigint").alias("line_number"),
        F.get_json_object("value", "$.split").alias("side"),
        F.lit(None).cast("string").alias("error"),
        F.get_json_object("value", "$.samples").alias("request_success"),
        F.get_json_object("value", "$.exact_matches").alias("exact_match"),
        F.get_json_object("value", "$.matched_fields").alias("matched_fields"),
        F.get_json_object("value", "$.total_fields").alias("total_fields"),
    )
    return read.unionByName(splits)


def eval_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = S.eval_summary(_details(spark, folder))
    rates = [name for name in summary.columns if name.endswith("_rate") or name == "field_accuracy"]
    return summary.select(*[F.round(name, 6).alias(name) if name in rates else F.col(name) for name in summary.columns])


def first_error(spark: SparkSession, folder: str) -> DataFrame:
    return S.first_error(_details(spark, folder))


def run_gate(spark: SparkSession, folder: str) -> DataFrame:
    return S.run_gate(_details(spark, folder))


def limit_per_split(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return S.limit_per_split(documents, "lang", "doc_id", 5)


def rule_report(spark: SparkSession, folder: str) -> DataFrame:
    results = table(spark, folder, "labels").select(
        F.when(F.col("toxic") == 1, F.lit("toxic")).otherwise(F.lit("clean")).alias("section"),
        (F.col("quality") == 1).alias("ok"),
    )
    return S.rule_report(results, "section", "ok")


QUERIES = {
    "role_pick": role_pick,
    "response_text": response_text,
    "response_parse": response_parse,
    "response_parse_tolerant": response_parse_tolerant,
    "path_get": path_get,
    "key_diff": key_diff,
    "schema_errors": schema_errors,
    "field_score": field_score,
    "eval_details": eval_details,
    "eval_summary": eval_summary,
    "eval_output": eval_output,
    "first_error": first_error,
    "run_gate": run_gate,
    "limit_per_split": limit_per_split,
    "rule_report": rule_report,
}

# --- checks ---------------------------------------------------------------------------

_MESSAGE = "$.choices[0].message"


def _reply_text(body: str) -> str:
    parts = f"from_json(json_extract({body}, '{_MESSAGE}.content'), '[\"JSON\"]')"
    texts = (
        f"list_transform(list_filter({parts}, lambda p: json_type(p, '$.text') = 'VARCHAR'), "
        "lambda p: json_extract_string(p, '$.text'))"
    )
    return f"""CASE WHEN NOT coalesce(json_valid({body}), false) THEN NULL
  WHEN json_type({body}, '{_MESSAGE}.content') = 'VARCHAR' THEN json_extract_string({body}, '{_MESSAGE}.content')
  WHEN json_type({body}, '{_MESSAGE}.content') = 'ARRAY' THEN array_to_string({texts}, chr(10))
  WHEN json_type({body}, '{_MESSAGE}.parsed') = 'OBJECT' THEN cast(json_extract({body}, '{_MESSAGE}.parsed') AS varchar)
  ELSE '' END"""


def _unfenced(text: str) -> str:
    body = f"trim({text}, chr(32) || chr(10))"
    inner = f"trim(regexp_replace(regexp_replace({body}, '^(```json)?(```)?', ''), '```\\s*$', ''), chr(32) || chr(10))"
    return f"CASE WHEN {body} LIKE '```%' THEN {inner} ELSE {body} END"


def _parse(source: str, text: str) -> str:
    """CTEs that parse `text` of `source` into predicted_text and parse_error."""
    return f"""unfenced AS (SELECT *, {_unfenced(text)} AS bare FROM {source}),
parsed AS (SELECT *, CASE WHEN json_valid(bare) AND bare LIKE '{{%' THEN bare END AS predicted_text,
  CASE WHEN bare IS NULL THEN NULL WHEN NOT json_valid(bare) THEN 'model response is not valid JSON'
       WHEN bare NOT LIKE '{{%' THEN 'model response JSON must be an object' END AS parse_error FROM unfenced)"""


def _leaf(text: str, path: str) -> str:
    where = f"{text}, '$.{path}'"
    return (
        f"CASE json_type({where}) WHEN 'VARCHAR' THEN 's:' || lower(trim(regexp_replace(json_extract_string({where}), '\\s+', ' ', 'g'))) "
        f"WHEN 'NULL' THEN NULL ELSE 'n:' || json_extract_string({where}) END"
    )


def _same(path: str) -> str:
    return f"({_leaf('expected_text', path)}) IS NOT DISTINCT FROM ({_leaf('predicted_text', path)})"


def _score_sql(side: str) -> tuple[str, str, str, int]:
    template = SIDE_TEMPLATES[side]
    paths = P.leaf_paths(template)
    matched = " + ".join(f"cast({_same(path)} AS bigint)" for path in paths)
    missed = ", ".join(f"CASE WHEN NOT ({_same(path)}) THEN '{path}' END" for path in sorted(paths))
    levels = ["$", "$.fields", "$.fields.mrz"] if side == "back" else ["$", "$.fields"]
    keys = " AND ".join(
        f"list_sort(json_keys(expected_text, '{level}')) = list_sort(json_keys(predicted_text, '{level}'))" for level in levels
    )
    every = " AND ".join(_same(path) for path in [*paths, "document_type", "side"])
    return matched, f"array_to_string(list_filter([{missed}], lambda x: x IS NOT NULL), ',')", f"({keys} AND {every})", len(paths)


def _per_side(index: int) -> str:
    return f"CASE side WHEN 'front' THEN {_score_sql('front')[index]} ELSE {_score_sql('back')[index]} END"


def _errors_sql(side: str) -> str:
    template = SIDE_TEMPLATES[side]
    items: list[str] = []
    lists: list[str] = []

    def walk(node, path):
        where = f"$.{path}" if path else "$"
        lead = f"{path}." if path else ""
        known = ", ".join(f"'{key}'" for key in node)
        keys = f"json_keys(predicted_text, '{where}')"
        lists.append(
            f"list_transform(list_filter({keys}, lambda k: NOT list_contains([{known}], k)), lambda k: '{lead}' || k || ' is not allowed')"
        )
        for key, item in node.items():
            here = f"{lead}{key}"
            kind = f"json_type(predicted_text, '$.{here}')"
            items.append(f"CASE WHEN NOT list_contains({keys}, '{key}') THEN '{here} is missing' END")
            if isinstance(item, dict):
                walk(item, here)
            elif item is None:
                items.append(f"CASE WHEN {kind} NOT IN ('VARCHAR', 'NULL') THEN '{here} must be string or null' END")
            else:
                items.append(
                    f"CASE WHEN {kind} IS NOT NULL AND NOT ({kind} = 'VARCHAR' AND json_extract_string(predicted_text, '$.{here}') = '{item}') THEN '{here} must equal ''{item}''' END"
                )

    walk(template, "")
    joined = f"[{', '.join(items)}]"
    for piece in lists:
        joined = f"list_concat({joined}, {piece})"
    return f"array_to_string(list_sort(list_filter({joined}, lambda x: x IS NOT NULL)), '; ')"


_ERRORS = f"CASE side WHEN 'front' THEN {_errors_sql('front')} ELSE {_errors_sql('back')} END"
_TOTAL = f"cast({_per_side(3)} AS bigint)"
_ANSWERS = "answers AS (SELECT line_number, side, expected_text, response FROM f_truth)"
_PARSED = f"{with_clause('f_truth')}, {_ANSWERS}, {_parse('answers', 'response')}"
_DETAILS = f"""{with_clause('f_truth', 'f_replies', 'f_inventory')},
paired AS (SELECT t.line_number, t.side, t.image, t.expected_text, r.http_status, r.body, r.latency_s, i.name IS NOT NULL AS known,
  r.http_status < 400 AS http_ok FROM f_truth t LEFT JOIN f_replies r ON t.side = r.side AND t.line_number = r.line_number
  LEFT JOIN f_inventory i ON t.image = i.name),
texts AS (SELECT *, CASE WHEN known AND http_ok THEN {_reply_text('body')} END AS content FROM paired),
{_parse('texts', 'content')},
details AS (SELECT line_number, side, image, latency_s, http_ok,
  CASE WHEN NOT known THEN 'image not found: ' || image WHEN NOT http_ok THEN 'HTTP ' || cast(http_status AS varchar) || ': ' || body
       ELSE parse_error END AS error,
  predicted_text IS NOT NULL AS request_success,
  CASE WHEN predicted_text IS NULL THEN '' ELSE {_ERRORS} END AS schema_errors,
  coalesce({_per_side(2)}, false) AND predicted_text IS NOT NULL AS exact_match,
  CASE WHEN predicted_text IS NULL THEN cast(0 AS bigint) ELSE {_per_side(0)} END AS matched_fields, {_TOTAL} AS total_fields FROM parsed)"""

_RATES = """count(*) AS samples, count(*) FILTER (WHERE request_success) AS request_success,
 round(count(*) FILTER (WHERE request_success) / count(*), 6) AS request_success_rate,
 count(*) FILTER (WHERE request_success) AS parse_success, round(count(*) FILTER (WHERE request_success) / count(*), 6) AS parse_success_rate,
 count(*) FILTER (WHERE request_success AND schema_errors = '') AS schema_success,
 round(count(*) FILTER (WHERE request_success AND schema_errors = '') / count(*), 6) AS schema_success_rate,
 count(*) FILTER (WHERE exact_match) AS exact_matches, round(count(*) FILTER (WHERE exact_match) / count(*), 6) AS exact_match_rate,
 cast(sum(matched_fields) AS bigint) AS matched_fields, cast(sum(total_fields) AS bigint) AS total_fields,
 round(sum(matched_fields) / sum(total_fields), 6) AS field_accuracy,
 round(avg(latency_s) FILTER (WHERE request_success), 4) AS avg_latency_s, round(min(latency_s) FILTER (WHERE request_success), 4) AS min_latency_s,
 round(max(latency_s) FILTER (WHERE request_success), 4) AS max_latency_s"""

_TOLERANT = f"""{with_clause('f_truth')},
told AS (SELECT *, shape = 1 AND line_number % 7 = 2 AS prose, response LIKE '%{{%' AS has_object,
  CASE WHEN response LIKE '%{{%' THEN regexp_extract(response, '[{{].*[}}]', 0, 's') END AS object FROM f_truth),
judged AS (SELECT line_number, side, object, CASE WHEN http_status = 503 THEN 'model returned invalid response JSON'
  WHEN shape = 2 AND line_number % 7 = 0 THEN 'model refused request: not allowed'
  WHEN shape = 2 AND line_number % 7 = 1 THEN 'model returned empty content'
  WHEN has_object THEN NULL
  WHEN response LIKE '[%' AND NOT prose THEN 'model JSON response must be an object'
  ELSE 'model returned invalid JSON' END AS parse_error FROM told)
SELECT line_number, side, CASE WHEN parse_error IS NULL THEN object END AS payload_text, parse_error FROM judged"""

CHECKS = {
    "response_parse_tolerant": _TOLERANT,
    "eval_output": f"""{_DETAILS} SELECT line_number, side, error, cast(request_success AS varchar) AS request_success, cast(exact_match AS varchar) AS exact_match,
 cast(matched_fields AS varchar) AS matched_fields, cast(total_fields AS varchar) AS total_fields FROM details
UNION ALL SELECT NULL, side, NULL, cast(count(*) AS varchar), cast(count(*) FILTER (WHERE exact_match) AS varchar), cast(sum(matched_fields) AS bigint)::varchar, cast(sum(total_fields) AS bigint)::varchar FROM details GROUP BY side
UNION ALL SELECT NULL, 'overall', NULL, cast(count(*) AS varchar), cast(count(*) FILTER (WHERE exact_match) AS varchar), cast(sum(matched_fields) AS bigint)::varchar, cast(sum(total_fields) AS bigint)::varchar FROM details""",
    "role_pick": """WITH t AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND conv_id % 3 > 0 THEN cast(json_object('text', text) AS varchar)
  WHEN turn % 2 = 0 THEN concat('<image>', chr(10), text) ELSE text END AS text FROM conversations)
SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'assistant') AS truth,
 trim(replace(replace(arg_min(text, turn) FILTER (WHERE role = 'user'), concat('<image>', chr(10)), ''), '<image>', '')) AS prompt,
 coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'system'), '') AS system_texts,
 CASE WHEN count(*) FILTER (WHERE role = 'assistant') = 0 THEN 'record has no assistant ground-truth message'
      WHEN conv_id % 3 = 0 THEN 'assistant ground truth must be a JSON object'
      WHEN count(*) FILTER (WHERE role = 'user') = 0 THEN 'record has no user message' END AS record_error FROM t GROUP BY conv_id""",
    "response_text": f"""{with_clause('f_replies')} SELECT line_number, side, {_reply_text('body')} AS content,
 CASE WHEN json_valid(body) THEN nullif(json_extract_string(body, '{_MESSAGE}.refusal'), '') END AS refusal FROM f_replies""",
    "response_parse": f"{_PARSED} SELECT line_number, side, predicted_text, parse_error FROM parsed",
    "path_get": f"""{_PARSED} SELECT line_number, json_extract_string(predicted_text, '$.side') AS side_value,
 json_extract_string(predicted_text, '$.fields.full_name') AS full_name, json_extract_string(predicted_text, '$.fields.mrz.document_number') AS document_number,
 json_extract_string(predicted_text, '$.side.full_name') AS below_text FROM parsed""",
    "key_diff": f"""{_PARSED}, k AS (SELECT line_number, json_keys(expected_text) AS e, json_keys(predicted_text) AS p, json_keys(expected_text, '$.fields') AS ef,
 json_keys(predicted_text, '$.fields') AS pf, predicted_text IS NOT NULL AS ok FROM parsed)
SELECT line_number, CASE WHEN ok THEN array_to_string(list_sort(list_filter(e, lambda x: NOT list_contains(p, x))), ',') END AS missing_keys,
 CASE WHEN ok THEN array_to_string(list_sort(list_filter(p, lambda x: NOT list_contains(e, x))), ',') END AS extra_keys,
 CASE WHEN ok THEN array_to_string(list_sort(list_filter(ef, lambda x: NOT list_contains(pf, x))), ',') END AS missing_fields,
 CASE WHEN ok THEN array_to_string(list_sort(list_filter(pf, lambda x: NOT list_contains(ef, x))), ',') END AS extra_fields FROM k""",
    "schema_errors": f"{_PARSED} SELECT line_number, side, CASE WHEN predicted_text IS NOT NULL THEN {_ERRORS} END AS schema_errors FROM parsed",
    "field_score": f"""{_PARSED} SELECT line_number, side, CASE WHEN predicted_text IS NULL THEN cast(0 AS bigint) ELSE {_per_side(0)} END AS matched_fields, {_TOTAL} AS total_fields,
 round(CASE WHEN predicted_text IS NULL THEN 0 ELSE ({_per_side(0)}) / {_TOTAL} END, 6) AS field_accuracy,
 coalesce({_per_side(2)}, false) AND predicted_text IS NOT NULL AS exact_match,
 CASE WHEN predicted_text IS NOT NULL THEN {_per_side(1)} END AS missed FROM parsed""",
    "eval_details": f"""{_DETAILS} SELECT line_number, side, image, error, schema_errors, http_ok, request_success,
 request_success AND schema_errors = '' AS schema_success, exact_match, matched_fields, total_fields, latency_s FROM details""",
    "eval_summary": f"""{_DETAILS} SELECT side AS split, {_RATES} FROM details GROUP BY side UNION ALL SELECT 'overall' AS split, {_RATES} FROM details""",
    "first_error": f"{_DETAILS} SELECT side, arg_min(image || ': ' || error, line_number) AS first_error FROM details WHERE error IS NOT NULL GROUP BY side",
    "run_gate": f"{_DETAILS} SELECT count(*) AS samples, bool_or(request_success) AS any_request_success, bool_or(request_success) AS run_ok FROM details",
    "limit_per_split": "SELECT doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 5",
    "rule_report": """SELECT CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS section, count(*) FILTER (WHERE quality = 1) AS passed,
 count(*) FILTER (WHERE quality <> 1) AS failed, bool_and(quality = 1) AS all_passed FROM labels GROUP BY 1""",
}
