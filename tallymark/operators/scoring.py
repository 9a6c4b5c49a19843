"""Recorded model replies scored against ground truth, field by field."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark import constants as K
from tallymark.functions import payload as P
from tallymark.functions.text import canonical_json, ratio, strip
from tallymark.operators.groups import side_format
from tallymark.operators.labels import SIDE_TEMPLATES
from tallymark.operators.skew import first_n, lookup_join

_NOT_AN_OBJECT = "model response JSON must be an object"
_NOT_JSON = "model response is not valid JSON"


# --- chat records -----------------------------------------------------------------


def clean_prompt(text: Column) -> Column:
    """User text without the image placeholder."""
    without = F.replace(F.replace(text, F.lit("<image>\n"), F.lit("")), F.lit("<image>"), F.lit(""))
    return strip(without)


def pick_roles(records: DataFrame) -> DataFrame:
    """Adds truth, system_texts and prompt to records with a messages array."""

    def picked(role: str) -> Column:
        return F.transform(F.filter("messages", lambda m: m["role"] == role), lambda m: m["content"])

    chosen = records.select(
        "*",
        picked("assistant").alias("_assistant"),
        picked("user").alias("_user"),
        picked("system").alias("system_texts"),
    ).withColumn("truth", F.try_element_at("_assistant", F.lit(1)))
    return P.add_object(chosen, "truth", "_truth").select(
        *records.columns,
        "truth",
        "system_texts",
        clean_prompt(F.try_element_at("_user", F.lit(1))).alias("prompt"),
        _record_error(F.size("_assistant") > 0, F.size("_user") > 0).alias("record_error"),
    )


def _record_error(has_truth: Column, has_user: Column) -> Column:
    """What a record lacks; _truth is the parsed truth."""
    return (
        F.when(~has_truth, F.lit("record has no assistant ground-truth message"))
        .when(F.col("_truth").isNull(), F.lit("assistant ground truth must be a JSON object"))
        .when(~has_user, F.lit("record has no user message"))
    )


def pick_roles_by_turn(turns: DataFrame) -> DataFrame:
    """The same picks from one row per turn, without building a record array: the
    first assistant and user text by a mergeable aggregate. Only the system texts, which
    a record returns all of, are gathered."""

    def first(role: str) -> Column:
        return F.min_by("text", F.when(F.col("role") == role, F.col("turn")))

    picked = turns.groupBy("conv_id").agg(
        first("assistant").alias("truth"),
        first("user").alias("prompt"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "system", F.struct("turn", "text")))).alias("_system"),
        F.bool_or(F.col("role") == "assistant").alias("_has_truth"),
        F.bool_or(F.col("role") == "user").alias("_has_user"),
    )
    has_truth, has_user = (F.coalesce(name, F.lit(False)) for name in ("_has_truth", "_has_user"))
    return P.add_object(picked, "truth", "_truth").select(
        "conv_id",
        "truth",
        F.col("_system.text").alias("system_texts"),
        clean_prompt(F.col("prompt")).alias("prompt"),
        _record_error(has_truth, has_user).alias("record_error"),
    )


def request_batch(
    records: DataFrame, model: str, max_tokens: int = K.REQUEST_MAX_TOKENS
) -> DataFrame:
    """One chat-completion request text per record, for an external batch runner; a
    record without truth or prompt keeps its row with an error instead. The image stays a reference; data_url() of the content replaces it where bytes exist."""
    picked = pick_roles(records)
    system = F.transform("system_texts", lambda text: F.to_json(F.struct(F.lit("system").alias("role"), text.alias("content"))))
    part_text = F.struct(F.lit("text").alias("type"), F.col("prompt").alias("text"))
    part_image = F.struct(
        F.lit("image_url").alias("type"), F.struct(F.element_at("images", 1).alias("url")).alias("image_url")
    )
    user = F.concat(
        F.lit('{"role":"user","content":['), F.to_json(part_text), F.lit(","), F.to_json(part_image), F.lit("]}")
    )
    body = F.concat(
        F.lit('{"model":' + json.dumps(model, ensure_ascii=False) + ',"messages":['),
        F.array_join(F.concat(system, F.array(user)), ","),
        F.lit(f'],"temperature":{K.REQUEST_TEMPERATURE},"max_tokens":{max_tokens},"response_format":'),
        P.per_side(F.col("side"), SIDE_TEMPLATES, lambda t: F.lit(_format_text(t))),
        F.lit("}"),
    )
    return picked.select("csv_row", "side", F.when(F.col("record_error").isNull(), body).alias("request"), "record_error")


def _format_text(template: P.Template) -> str:
    return json.dumps(side_format(template), separators=(",", ":"))


# --- replies ------------------------------------------------------------------------


def reply_texts(replies: DataFrame, body: str = "body") -> DataFrame:
    """Adds content and refusal for raw chat replies."""
    reply = F.col("_reply")
    return P.add_value(replies, F.col(body), "_reply").select(
        *replies.columns,
        F.when(reply.isNotNull(), P.reply_text(reply, F.col(body))).alias("content"),
        P.refusal_text(reply).alias("refusal"),
    )


def parse_replies(texts: DataFrame, content: str = "content") -> DataFrame:
    """Adds predicted_text (strict JSON object after fence removal) and parse_error."""
    bare = texts.withColumn("_body", P.unfence(F.col(content)))
    value = F.col("_value")
    is_object = F.col("_body").startswith("{")
    return P.add_value(bare, F.col("_body"), "_value").select(
        *texts.columns,
        F.when(value.isNotNull() & is_object, F.col("_body")).alias("predicted_text"),
        F.when(F.col("_body").isNotNull() & value.isNull(), F.lit(_NOT_JSON))
        .when(~is_object, F.lit(_NOT_AN_OBJECT))
        .alias("parse_error"),
    )


def parse_replies_tolerant(replies: DataFrame, body: str = "body") -> DataFrame:
    """Adds payload_text and parse_error for raw chat replies: a refusal is an error,
    the parsed member counts only when the text is blank, prose around the first
    balanced object is ignored."""
    reply = F.col("_reply")
    kind = P.type_of(P.at(P.message_of(reply), "content"))
    plain = F.when(kind.isin("STRING", "ARRAY"), P.reply_text(reply, F.col(body))).otherwise(F.lit(""))
    read = P.add_value(replies, F.col(body), "_reply").select(
        *replies.columns,
        reply.isNull().alias("_unreadable"),
        P.refusal_text(reply).alias("_refusal"),
        P.tolerant_body(plain).alias("_text"),
        P.parsed_text(F.col(body)).alias("_parsed"),
    )
    cut = read.withColumn("_object", strip(P.first_json_object(F.col("_text"))))
    blank = F.col("_text") == ""
    value = F.col("_value")
    is_object = F.col("_object").startswith("{")
    return P.add_value(cut, F.col("_object"), "_value").select(
        *replies.columns,
        F.when(F.col("_unreadable") | F.col("_refusal").isNotNull(), F.lit(None))
        .when(blank, F.col("_parsed"))
        .when(value.isNotNull() & is_object, F.col("_object"))
        .alias("payload_text"),
        F.when(F.col("_unreadable"), F.lit("model returned invalid response JSON"))
        .when(F.col("_refusal").isNotNull(), F.concat(F.lit("model refused request: "), F.col("_refusal")))
        .when(blank & F.col("_parsed").isNull(), F.lit("model returned empty content"))
        .when(~blank & value.isNull(), F.lit("model returned invalid JSON"))
        .when(~blank & ~is_object, F.lit("model JSON response must be an object"))
        .alias("parse_error"),
    )


# --- scores -------------------------------------------------------------------------


def _leaf(column: str, path: str) -> str:
    """SQL of a leaf of a parsed payload column."""
    return ".".join(f"`{step}`" for step in [column, *path.split(".")])


def score_fields(
    pairs: DataFrame,
    templates: dict[str, P.Template] = SIDE_TEMPLATES,
    expected: str = "expected_text",
    predicted: str = "predicted_text",
) -> DataFrame:
    """Adds field_matches, matched_fields, total_fields, field_accuracy, exact_match.

    Python spells both sides canonically, once per row; each spelling is parsed once
    into a struct of texts and the comparison is a projection. A missing path equals
    null; whole objects are compared with their keys.
    """
    side = F.col("side")
    sources = {"_want": "_want_text", "_got": "_got_text", "_want_shown": expected, "_got_shown": predicted}

    def parsed_columns() -> dict[str, Column]:
        # One struct column per side and text; only the row's own side is parsed.
        return {
            f"{name}_{of}": F.from_json(F.when(side == of, F.col(text)), P.template_struct(template))
            for of, template in templates.items()
            for name, text in sources.items()
        }

    # One SQL text per side: as single calls, dozens of fields would make planning slow.
    def same(of: str, path: str) -> str:
        return f"{_leaf(f'_want_{of}', path)} <=> {_leaf(f'_got_{of}', path)}"

    def hits(of: str, template: P.Template) -> Column:
        return F.expr(" + ".join(f"cast({same(of, path)} AS int)" for path in P.leaf_paths(template)))

    def shown(of: str, template: P.Template) -> Column:
        entries = [
            f"'{path}', named_struct('expected', {_leaf(f'_want_shown_{of}', path)}, "
            f"'predicted', {_leaf(f'_got_shown_{of}', path)}, 'match', {same(of, path)})"
            for path in P.leaf_paths(template)
        ]
        return F.expr(f"map({', '.join(entries)})")

    def by_side(build) -> Column:
        result = F
        for of, template in templates.items():
            result = result.when(side == of, build(of, template))
        return result

    parsed = (
        pairs.withColumn("_want_text", canonical_json(F.col(expected)))
        .withColumn("_got_text", canonical_json(F.col(predicted)))
        .withColumns(parsed_columns())
    )
    readable = F.col("_got_text").startswith("{")
    return parsed.select(
        *pairs.columns,
        F.when(readable, by_side(shown)).alias("field_matches"),
        F.when(readable, by_side(hits)).otherwise(0).cast("bigint").alias("matched_fields"),
        by_side(lambda _, t: F.lit(len(P.leaf_paths(t)))).cast("bigint").alias("total_fields"),
        F.coalesce(readable & (F.col("_want_text") == F.col("_got_text")), F.lit(False)).alias("exact_match"),
    ).withColumn("field_accuracy", ratio(F.col("matched_fields"), F.col("total_fields")))


def check_schema(
    parsed: DataFrame, templates: dict[str, P.Template] = SIDE_TEMPLATES, text: str = "predicted_text"
) -> DataFrame:
    """Adds schema_errors, NULL where there is no payload to check."""
    side, value, types = F.col("side"), F.col("_value"), F.col("_types")
    typed = P.add_value(parsed, F.col(text), "_value").withColumn(
        "_types", P.per_side(side, templates, lambda t: P.level_types(value, t))
    )
    checked = P.per_side(side, templates, lambda t: P.schema_errors(value, types, t))
    return typed.select(*parsed.columns, F.when(value.isNotNull(), checked).alias("schema_errors"))


def key_diff(pairs: DataFrame, expected: str = "expected_text", predicted: str = "predicted_text") -> DataFrame:
    """Adds missing and extra keys of the top level and of fields."""
    read = P.add_value(P.add_value(pairs, F.col(expected), "_want"), F.col(predicted), "_got")

    def keys(value: str, path: str) -> Column:
        return F.map_keys(P.members(P.at(F.col(value), path)))

    found = read.select(
        *pairs.columns,
        *[keys(value, path).alias(f"{value}_{path}") for value in ("_want", "_got") for path in ("", "fields")],
    )
    return found.select(
        *pairs.columns,
        P.missing_keys(F.col("_want_"), F.col("_got_")).alias("missing_keys"),
        P.missing_keys(F.col("_got_"), F.col("_want_")).alias("extra_keys"),
        P.missing_keys(F.col("_want_fields"), F.col("_got_fields")).alias("missing_fields"),
        P.missing_keys(F.col("_got_fields"), F.col("_want_fields")).alias("extra_fields"),
    )


def eval_details(
    truth: DataFrame,
    replies: DataFrame,
    inventory: DataFrame | None = None,
    error_characters: int | None = 1000,
) -> DataFrame:
    """One detail row per truth record: reply paired, parsed, checked and scored.

    truth: line_number, side, image, expected_text; replies: side, line_number,
    http_status, body, latency_s. Of several replies to a record the one with the lowest
    status counts, then the first in order. A failed record keeps its fields in the
    denominator. Error texts quote `error_characters` of a body (None: all).
    """
    one = F.min(F.struct("http_status", "body", "latency_s")).alias("_one")
    replies = replies.groupBy("side", "line_number").agg(one).select("side", "line_number", "_one.*")
    quoted = F.col("body") if error_characters is None else F.left("body", F.lit(error_characters))
    if inventory is None:
        listed = truth.withColumn("_known", F.lit(True))
    else:
        known = inventory.select(F.col("name").alias("image"), F.lit(True).alias("_known")).distinct()
        listed = lookup_join(truth, known, ["image"], ["side", "line_number"])
    paired = listed.join(replies, ["side", "line_number"], "left")
    http_ok = F.coalesce(F.col("http_status") < 400, F.lit(False))
    usable = F.col("_known") & http_ok
    read = reply_texts(paired.withColumn("_reply_body", F.when(usable, F.col("body"))), "_reply_body")
    parsed = parse_replies(read)
    scored = score_fields(check_schema(parsed))
    error = (
        F.when(F.col("_known").isNull(), F.concat(F.lit("image not found: "), F.col("image")))
        .when(F.col("http_status").isNull(), F.lit("no response recorded"))
        .when(~http_ok, F.concat(F.lit("HTTP "), F.col("http_status"), F.lit(": "), quoted))
        .otherwise(F.coalesce("parse_error", F.when(F.col("content").isNull(), F.lit(_NOT_JSON))))
    )
    parse_success = F.col("predicted_text").isNotNull()
    return scored.select(
        "line_number",
        "side",
        "image",
        F.col("expected_text"),
        F.col("predicted_text"),
        F.col("body").alias("raw_response"),
        error.alias("error"),
        F.coalesce("schema_errors", F.array().cast("array<string>")).alias("schema_errors"),
        http_ok.alias("http_ok"),
        parse_success.alias("request_success"),
        parse_success.alias("parse_success"),
        (parse_success & (F.size("schema_errors") == 0)).alias("schema_success"),
        "exact_match",
        "field_matches",
        "matched_fields",
        "total_fields",
        "field_accuracy",
        "latency_s",
    )


def eval_summary(details: DataFrame) -> DataFrame:
    """Fifteen measures per side and overall (split = 'overall')."""
    served = F.when(F.col("request_success"), F.col("latency_s"))
    counted = details.rollup("side").agg(
        F.grouping("side").alias("_all"),
        F.count(F.lit(1)).alias("samples"),
        F.count_if("request_success").alias("request_success"),
        F.count_if("parse_success").alias("parse_success"),
        F.count_if("schema_success").alias("schema_success"),
        F.count_if("exact_match").alias("exact_matches"),
        F.coalesce(F.sum("matched_fields"), F.lit(0)).alias("matched_fields"),
        F.coalesce(F.sum("total_fields"), F.lit(0)).alias("total_fields"),
        F.avg(served).alias("_avg"),
        F.min(served).alias("_min"),
        F.max(served).alias("_max"),
    )
    samples = F.col("samples")
    return counted.select(
        F.when(F.col("_all") == 1, F.lit("overall")).otherwise(F.col("side")).alias("split"),
        "samples",
        "request_success",
        ratio(F.col("request_success"), samples).alias("request_success_rate"),
        "parse_success",
        ratio(F.col("parse_success"), samples).alias("parse_success_rate"),
        "schema_success",
        ratio(F.col("schema_success"), samples).alias("schema_success_rate"),
        "exact_matches",
        ratio(F.col("exact_matches"), samples).alias("exact_match_rate"),
        "matched_fields",
        "total_fields",
        ratio(F.col("matched_fields"), F.col("total_fields")).alias("field_accuracy"),
        *[F.coalesce(F.round(f"_{kind}", 4), F.lit(0.0)).alias(f"{kind}_latency_s") for kind in ("avg", "min", "max")],
    )


def first_error(details: DataFrame) -> DataFrame:
    """First error per side in record order, as 'image: error'."""
    text = F.concat(F.coalesce("image", F.lit("unknown image")), F.lit(": "), F.col("error"))
    # Ordered by failed lines only; a filter would be pushed down and score rows twice.
    failed_line = F.when(F.col("error") != "", F.col("line_number"))
    firsts = details.groupBy("side").agg(F.min_by(text, failed_line).alias("first_error"))
    return firsts.filter(F.col("first_error").isNotNull())


def limit_per_split(records: DataFrame, split: str, order: str, n: int) -> DataFrame:
    return first_n(records, [split], [order], n)


def run_gate(details: DataFrame) -> DataFrame:
    """Whether a run counts: some request succeeded, or nothing was asked."""
    return details.agg(
        F.count(F.lit(1)).alias("samples"),
        F.coalesce(F.bool_or("request_success"), F.lit(False)).alias("any_request_success"),
    ).withColumn("run_ok", (F.col("samples") == 0) | F.col("any_request_success"))


def rule_report(results: DataFrame, section: str, passed: str) -> DataFrame:
    """Pass and fail counts per section and the section's gate."""
    return results.groupBy(section).agg(
        F.count_if(passed).alias("passed"),
        F.count_if(~F.col(passed)).alias("failed"),
        F.bool_and(passed).alias("all_passed"),
    )
