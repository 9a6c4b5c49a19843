"""Queries of the artifact catalog, with their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark import constants as K
from tallymark.functions import text as X
from tallymark.operators import catalog as C
from tallymark.plans.fixtures import entries, load, with_clause
from tallymark.session import new_shared_path
from tallymark.sources import readers as R
from tallymark.sources import writers as W
from tallymark.sources.readers import table


def catalog_assemble(spark: SparkSession, folder: str) -> DataFrame:
    """Entries written as sidecar texts, read back, completed and converted."""
    base = entries(spark, folder)
    out = new_shared_path(spark, "sidecars")
    W.write_lines(base.select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), "format", "path", "serving_target", "serving_targets")).alias("line")), out)
    lines = R.read_json_lines(spark, out)
    parsed = lines.select(F.from_json("text", R.SIDECAR_SCHEMA).alias("d")).select("d.*")
    full = C.add_quantization(C.normalize_entries(parsed), "q4_k_m")
    return full.select(
        F.col("id").cast("bigint").alias("id"),
        "serving_target",
        F.array_join("serving_targets", ",").alias("serving_targets"),
        F.array_join("quantizations", ",").alias("quantizations"),
    )


def sidecar_read(spark: SparkSession, folder: str) -> DataFrame:
    """One document per entry folder; every seventh cannot be read."""
    suppliers = table(spark, folder, "supplier")
    key = F.col("s_suppkey")
    text = F.when(key % 7 == 0, F.lit("not a document")).otherwise(
        F.to_json(F.struct(key.cast("string").alias("id"), F.col("s_name").alias("repo"), F.lit("gguf").alias("format")))
    )
    out = new_shared_path(spark, "entries")
    W.write_documents(suppliers.select(key.alias("entry"), text.alias("value")), out, "entry")
    return R.read_sidecars(spark, out, "part-*").select("entry", "id", "repo", "format", "error")


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Files written per language, listed again without their contents."""
    out = new_shared_path(spark, "files")
    table(spark, folder, "documents").select("lang", F.col("text").alias("value")).write.partitionBy("lang").text(out)
    files = R.read_inventory(spark, out).filter(F.col("length") > 0)
    lang = F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang")
    return files.groupBy(lang).agg(F.sum("length").alias("bytes"))


def compat_check(spark: SparkSession, folder: str) -> DataFrame:
    checked = C.check_compatibility(C.normalize_entries(entries(spark, folder)))
    return checked.select("id", "incompatible", "allowed")


def catalog_check(spark: SparkSession, folder: str) -> DataFrame:
    checked = C.check_catalog(C.normalize_entries(entries(spark, folder)), load(spark, folder, "f_files"))
    return checked.select("id", "check_status")


def catalog_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata only: no file inventory."""
    return C.issue_count(C.check_catalog(C.normalize_entries(entries(spark, folder))))


def dir_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return C.dir_rollup(load(spark, folder, "f_files"))


def resolve_target(spark: SparkSession, folder: str) -> DataFrame:
    requests = load(spark, folder, "f_requests")
    resolved = C.resolve_targets(requests, C.normalize_entries(entries(spark, folder)))
    return resolved.select("request_id", "format", "path", "resolve_error")


def missing_bindings(spark: SparkSession, folder: str) -> DataFrame:
    listed = load(spark, folder, "f_part_names").select("name")
    return C.missing_bindings(listed, load(spark, folder, "f_bindings"))


def binding_check(spark: SparkSession, folder: str) -> DataFrame:
    checked = C.check_bindings(load(spark, folder, "f_bindings"), C.normalize_entries(entries(spark, folder)))
    return checked.select("id", "binding_error")


def catalog_filter(spark: SparkSession, folder: str) -> DataFrame:
    services = load(spark, folder, "f_services")
    return C.with_value(C.services_by_group(services, "group1"), "eval_endpoint").select("service_id", "eval_endpoint")


def compose_files(spark: SparkSession, folder: str) -> DataFrame:
    return C.distinct_files(load(spark, folder, "f_services"))


def pin_check(spark: SparkSession, folder: str) -> DataFrame:
    services = load(spark, folder, "f_services")
    return services.select("service_id", "tag", X.is_floating_tag(F.col("tag")).alias("floating"))


def overlay_merge(spark: SparkSession, folder: str) -> DataFrame:
    return C.overlay_merge(C.parse_settings(load(spark, folder, "f_settings")))


def slugify(spark: SparkSession, folder: str) -> DataFrame:
    """Slugs, ids and names derived from titles and times."""
    orders = R.table(spark, folder, "orders").select(
        "o_orderkey", F.concat("o_orderpriority", F.lit("/..v"), F.col("o_custkey").cast("string"), F.lit("é!")).alias("model"), "o_orderdate"
    )
    runtime = F.when(F.col("o_orderkey") % 3 == 0, F.lit("ollama")).otherwise(F.lit("llama.cpp"))
    return orders.select(
        "o_orderkey",
        X.slug(F.col("model")).alias("slug"),
        X.slug(F.lit("---"), "model").alias("fallback"),
        X.binding_id(runtime, F.col("model")).alias("binding_id"),
        X.default_alias(runtime).alias("alias"),
        X.qualified_model(runtime, F.col("model")).alias("qualified"),
        X.run_id(F.col("model"), F.col("o_orderdate")).alias("run_id"),
        X.report_name(F.col("model"), F.col("o_orderdate")).alias("report_name"),
    )


QUERIES = {
    "sidecar_read": sidecar_read,
    "file_inventory": file_inventory,
    "catalog_assemble": catalog_assemble,
    "compat_check": compat_check,
    "catalog_check": catalog_check,
    "catalog_issues": catalog_issues,
    "dir_rollup": dir_rollup,
    "resolve_target": resolve_target,
    "missing_bindings": missing_bindings,
    "binding_check": binding_check,
    "catalog_filter": catalog_filter,
    "compose_files": compose_files,
    "pin_check": pin_check,
    "overlay_merge": overlay_merge,
    "slugify": slugify,
}

# --- checks ---------------------------------------------------------------------------


def _list(values) -> str:
    return "[" + ", ".join(f"'{value}'" for value in values) + "]"


_ALLOWED = "CASE format " + " ".join(f"WHEN '{fmt}' THEN {_list(t)}" for fmt, t in K.FORMAT_TARGETS.items()) + " END"
_ENTRIES = f"""ent AS (SELECT id, position, format, path, coalesce(string_split(targets_csv, ','), CASE WHEN serving_target IS NOT NULL THEN [serving_target] END, []) AS targets,
  coalesce(serving_target, string_split(targets_csv, ',')[1]) AS first_target, {_ALLOWED} AS allowed FROM f_entries)"""
_WRONG = "list_filter(targets, lambda t: allowed IS NOT NULL AND NOT list_contains(allowed, t))"
_UNKNOWN = f"list_filter(targets, lambda t: NOT list_contains({_list(K.KNOWN_TARGETS)}, t))"
_STATUS = f"""WHEN len({_UNKNOWN}) > 0 THEN 'WARN: invalid target(s): ' || array_to_string({_UNKNOWN}, ', ')
  WHEN len({_WRONG}) > 0 THEN 'WARN: ' || format || ' incompatible with target(s): ' || array_to_string({_WRONG}, ', ') || '; allowed: ' || array_to_string(list_sort(allowed), ', ') ELSE 'OK' END"""
_RESOLVE = """CASE WHEN runtime NOT IN ('vllm', 'sglang', 'llama.cpp', 'mlx') THEN 'unknown runtime ' || runtime
  WHEN e.id IS NULL THEN 'model not found or not targeted for runtime'
  WHEN e.allowed IS NOT NULL AND NOT list_contains(e.allowed, runtime) THEN 'format ' || e.format || ' is not compatible with ' || runtime END"""
_MODEL = "o_orderpriority || '/..v' || cast(o_custkey AS varchar) || 'é!'"
_SLUG = "trim(regexp_replace(lower(model), '[^a-zé0-9]+', '-', 'g'), '-')"

CHECKS = {
    "sidecar_read": """SELECT 'entry=' || s_suppkey AS entry, CASE WHEN s_suppkey % 7 > 0 THEN cast(s_suppkey AS varchar) END AS id,
 CASE WHEN s_suppkey % 7 > 0 THEN s_name END AS repo, CASE WHEN s_suppkey % 7 > 0 THEN 'gguf' END AS format,
 CASE WHEN s_suppkey % 7 = 0 THEN 'document is not a JSON object' END AS error FROM supplier""",
    "file_inventory": "SELECT lang, cast(sum(octet_length(encode(text)) + 1) AS bigint) AS bytes FROM documents GROUP BY lang",
    "catalog_assemble": f"""{with_clause('f_entries')}, {_ENTRIES} SELECT id, first_target AS serving_target,
 array_to_string(list_concat(targets, list_filter(['llama.cpp', 'ollama'], lambda t: NOT list_contains(targets, t))), ',') AS serving_targets, 'q4_k_m' AS quantizations FROM ent""",
    "compat_check": f"{with_clause('f_entries')}, {_ENTRIES} SELECT id, array_to_string({_WRONG}, ', ') AS incompatible, array_to_string(list_sort(allowed), ', ') AS allowed FROM ent",
    "catalog_check": f"""{with_clause('f_entries', 'f_files')}, {_ENTRIES},
fl AS (SELECT dir, bool_or(rel_path NOT LIKE '%/%' AND rel_path LIKE '%.safetensors') AS st, bool_or(rel_path NOT LIKE '%/%' AND rel_path LIKE '%.gguf') AS gg, bool_or(rel_path NOT LIKE '%/%' AND rel_path LIKE '%.bin') AS pt FROM f_files GROUP BY dir)
SELECT id, CASE WHEN fl.dir IS NULL THEN 'MISSING' WHEN format = 'safetensors' AND NOT st THEN 'WARN: no .safetensors files' WHEN format = 'gguf' AND NOT gg THEN 'WARN: no .gguf files'
 WHEN format = 'pytorch' AND NOT pt THEN 'WARN: no .bin files' {_STATUS} AS check_status FROM ent LEFT JOIN fl ON ent.path = fl.dir""",
    "catalog_issues": f"{with_clause('f_entries')}, {_ENTRIES}, s AS (SELECT CASE {_STATUS} AS st FROM ent) SELECT count(*) AS entries, count(*) FILTER (WHERE st <> 'OK') AS issues FROM s",
    "dir_rollup": f"""{with_clause('f_files')} SELECT dir, cast(sum(length) AS bigint) AS bytes, count(*) AS files, round(sum(length) / 1e9, 1) AS size_gb,
 CASE WHEN bool_or(rel_path = 'weights.safetensors') THEN 'safetensors' WHEN bool_or(rel_path = 'model.bin') THEN 'pytorch' WHEN bool_or(rel_path = 'model.gguf') THEN 'gguf' ELSE 'unknown' END AS format FROM f_files GROUP BY dir""",
    "resolve_target": f"""{with_clause('f_entries', 'f_requests')}, {_ENTRIES} SELECT request_id, e.format, e.path, {_RESOLVE} AS resolve_error
FROM f_requests r LEFT JOIN ent e ON r.model_id = e.id AND list_contains(e.targets, r.runtime)""",
    "missing_bindings": f"""{with_clause('f_part_names', 'f_bindings')} SELECT name, count(*) AS listed FROM f_part_names WHERE name NOT IN (SELECT model_name FROM f_bindings WHERE runtime = 'ollama') GROUP BY name""",
    "binding_check": f"""{with_clause('f_entries', 'f_bindings')}, {_ENTRIES} SELECT b.id, CASE WHEN runtime NOT IN ('ollama', 'vllm', 'sglang', 'llama.cpp', 'mlx') THEN 'unsupported runtime: ' || runtime
 WHEN model_type = 'registry' AND model_id IS NULL THEN 'registry model needs model.id'
 WHEN model_type = 'registry' AND runtime NOT IN ('vllm', 'sglang', 'llama.cpp', 'mlx') THEN 'uses registry model but runtime ' || runtime || ' has no env mapping'
 WHEN model_type = 'registry' AND ({_RESOLVE}) IS NOT NULL THEN {_RESOLVE}
 WHEN model_type = 'ollama' AND runtime <> 'ollama' THEN 'uses ollama model type with runtime ' || runtime WHEN model_type = 'ollama' AND model_name = '' THEN 'ollama model needs model.name'
 WHEN model_type NOT IN ('registry', 'ollama') THEN 'unsupported model.type: ' || model_type WHEN provider IS NULL THEN 'needs gateway.provider and gateway.model' END AS binding_error
FROM f_bindings b LEFT JOIN ent e ON b.model_id = e.id AND list_contains(e.targets, b.runtime)""",
    "catalog_filter": f"{with_clause('f_services')} SELECT service_id, eval_endpoint FROM f_services WHERE \"group\" = 'group1' AND eval_endpoint IS NOT NULL",
    "compose_files": f"{with_clause('f_services')} SELECT DISTINCT compose_file FROM f_services WHERE compose_file IS NOT NULL",
    "pin_check": f"{with_clause('f_services')} SELECT service_id, tag, lower(tag) IN ('latest', 'main', 'main-stable', 'stable', 'dev') OR lower(tag) LIKE 'nightly%' AS floating FROM f_services",
    "overlay_merge": f"""{with_clause('f_settings')}, t AS (SELECT service, layer, line_no, trim(text) AS text FROM f_settings),
kv AS (SELECT *, trim(split_part(text, '=', 1)) AS key, trim(trim(regexp_replace(text, '^[^=]*=', '')), '"') AS value FROM t WHERE text <> '' AND text NOT LIKE '#%' AND text LIKE '%=%')
SELECT service, key, value FROM (SELECT *, row_number() OVER (PARTITION BY service, key ORDER BY layer DESC, line_no DESC) AS r FROM kv) WHERE r = 1""",
    "slugify": f"""WITH o AS (SELECT o_orderkey, {_MODEL} AS model, o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN 'ollama' ELSE 'llama.cpp' END AS runtime FROM orders)
SELECT o_orderkey, {_SLUG} AS slug, 'model' AS fallback, CASE runtime WHEN 'ollama' THEN 'chat' ELSE 'llama-cpp' END || '-' || {_SLUG} AS binding_id,
 'local-' || replace(runtime, '.', '-') AS alias, runtime || '/' || model AS qualified, {_SLUG} || '_' || strftime(o_orderdate, '%H%M%S') AS run_id,
 'benchmark_' || replace(model, '/', '_') || '_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '.json' AS report_name FROM o""",
}
