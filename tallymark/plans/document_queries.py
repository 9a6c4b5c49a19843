"""Queries of segmentation, extraction, group definitions and the fetch log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark import constants as K
from tallymark.functions import urls as U
from tallymark.operators import extraction as E
from tallymark.operators import fetchlog as L
from tallymark.operators import groups as G
from tallymark.operators import segments as S
from tallymark.plans.fixtures import SEGMENTS_SQL, load, segments, with_clause
from tallymark.sources.readers import table

ORDER_FIELDS = [
    {"field_key": "order_key", "data_type": "string", "nullable": False},
    {"field_key": "status", "data_type": "string"},
    {"field_key": "total", "data_type": "number"},
    {"field_key": "ordered", "data_type": "date"},
    {"field_key": "urgent", "data_type": "boolean"},
    {
        "field_key": "lines",
        "data_type": "array",
        "child_schema": [
            {"field_key": "sku", "data_type": "string"},
            {"field_key": "qty", "data_type": "number", "nullable": False},
        ],
    },
]
ORDER_GROUPS = {"order": ORDER_FIELDS, "unknown": []}


def _groups(spark: SparkSession) -> DataFrame:
    """Allowed groups of the conversation documents: part of the request, not data."""
    return spark.createDataFrame([("chat", "Chat"), ("mail", "Mail")], "group_code string, group_name string")


def _valid(spark: SparkSession, folder: str) -> DataFrame:
    allowed = S.allowed_groups(segments(spark, folder), _groups(spark))
    return S.check_pages(allowed).filter(F.col("page_error").isNull())


def allowed_groups(spark: SparkSession, folder: str) -> DataFrame:
    kept = S.allowed_groups(segments(spark, folder), _groups(spark))
    return kept.select("file_id", "doc_no", "document_code", "group_name", "document_name")


def page_check(spark: SparkSession, folder: str) -> DataFrame:
    return S.check_pages(segments(spark, folder)).select("file_id", "doc_no", "page_error")


def page_expand(spark: SparkSession, folder: str) -> DataFrame:
    return S.expand_pages(segments(spark, folder))


def page_overlap(spark: SparkSession, folder: str) -> DataFrame:
    found = S.page_overlap(_valid(spark, folder))
    return found.select("file_id", "doc_no", S.overlap_error(F.col("pages")).alias("overlap_error"))


def ordered_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("file_id"), (F.col("turn") + 1).cast("int").alias("page_number"), "role", F.length("text").alias("chars")
    )
    return S.ordered_pages(segments(spark, folder), pages)


def unique_check(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that occur more than once in a language; a digest stands for the text, so
    whole texts are read but not moved."""
    texts = table(spark, folder, "documents").select("lang", F.sha2("text", 256).alias("text_digest"))
    return G.duplicate_keys(texts, ["lang"], "text_digest")


def schema_paths(spark: SparkSession, folder: str) -> DataFrame:
    return G.schema_paths(load(spark, folder, "f_fields"))


def schema_def_check(spark: SparkSession, folder: str) -> DataFrame:
    return G.schema_def_check(
        load(spark, folder, "f_groups"), load(spark, folder, "f_fields"), load(spark, folder, "f_variants")
    )


def prompt_render(spark: SparkSession, folder: str) -> DataFrame:
    described = G.group_descriptions(load(spark, folder, "f_groups"), load(spark, folder, "f_fields"))
    documents = load(spark, folder, "f_part_docs").withColumn("page_order", F.sequence(F.lit(1), "last_page"))
    return G.extraction_prompts(documents, described).select("file_id", "prompt")


def classify_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return G.group_blocks(load(spark, folder, "f_groups"), load(spark, folder, "f_variants"))


def classify_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """One prompt per conversation, with all groups in it."""
    turns = table(spark, folder, "conversations")
    files = turns.groupBy(F.col("conv_id").alias("file_id")).agg((F.max("turn") + 1).alias("n_pages"))
    listed = G.group_list(classify_blocks(spark, folder))
    return G.classify_prompts(files, listed).select("file_id", "prompt")


def extract_normalize(spark: SparkSession, folder: str) -> DataFrame:
    normalized = E.normalize_extracted(load(spark, folder, "f_payloads"), ORDER_GROUPS)
    return normalized.select("file_id", "extraction_error", "extracted_data")


def unknown_check(spark: SparkSession, folder: str) -> DataFrame:
    return E.check_unknown(load(spark, folder, "f_payloads")).select("file_id", "structure_error")


def extract_emit(spark: SparkSession, folder: str) -> DataFrame:
    normalized = E.normalize_extracted(load(spark, folder, "f_payloads"), ORDER_GROUPS)
    documents = normalized.select(
        "file_id",
        F.lit(1).alias("doc_no"),
        "document_code",
        F.initcap("document_code").alias("group_name"),
        F.lit("Scan").alias("document_name"),
        F.array(F.lit(1)).alias("page_order"),
        F.array().cast("array<struct<page: int, duplicate_of: int>>").alias("duplicate_pages"),
        "extraction_error",
        "extracted_data",
    )
    return E.emit_documents(documents)


def _fetches(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "f_fetch")


def url_screen(spark: SparkSession, folder: str) -> DataFrame:
    screened = L.screen_urls(_fetches(spark, folder))
    return screened.select("page_id", U.url_host(F.col("url")).alias("host"), "url_error")


def url_filename(spark: SparkSession, folder: str) -> DataFrame:
    return _fetches(spark, folder).select("page_id", U.file_name(F.col("url")).alias("file_name"))


def mime_sniff(spark: SparkSession, folder: str) -> DataFrame:
    fetched = _fetches(spark, folder).withColumn("content", F.unhex("content_hex"))
    return L.sniff_types(fetched).select("page_id", "mime_type", "mime_error")


def fetch_status(spark: SparkSession, folder: str) -> DataFrame:
    return L.fetch_status(_fetches(spark, folder)).select("page_id", "answer_status", "detail")


def size_caps(spark: SparkSession, folder: str) -> DataFrame:
    return L.size_caps(_fetches(spark, folder)).select("page_id", "cap_status", "cap_error")


def url_public(spark: SparkSession, folder: str) -> DataFrame:
    return L.public_addresses(load(spark, folder, "f_addresses"), "page_id")


QUERIES = {
    "allowed_groups": allowed_groups,
    "page_check": page_check,
    "page_expand": page_expand,
    "page_overlap": page_overlap,
    "ordered_pages": ordered_pages,
    "unique_check": unique_check,
    "schema_paths": schema_paths,
    "schema_def_check": schema_def_check,
    "prompt_render": prompt_render,
    "classify_blocks": classify_blocks,
    "classify_prompts": classify_prompts,
    "extract_normalize": extract_normalize,
    "unknown_check": unknown_check,
    "extract_emit": extract_emit,
    "url_screen": url_screen,
    "url_filename": url_filename,
    "mime_sniff": mime_sniff,
    "fetch_status": fetch_status,
    "size_caps": size_caps,
    "url_public": url_public,
}

# --- checks ---------------------------------------------------------------------------

_SEG = f"WITH seg AS ({SEGMENTS_SQL})"
_PAGE_ERROR = """CASE WHEN len(page_order) = 0 THEN 'page_order must not be empty'
  WHEN last_page < first_page OR first_page < 1 THEN 'page_ranges must contain positive [start_page, end_page] pairs'
  WHEN len(list_distinct(page_order)) < len(page_order) THEN 'page_order must not contain duplicate pages'
  WHEN len(list_filter(page_order, lambda x: x < 1 OR x > n_pages)) > 0 THEN 'page_order references a page outside the file'
  WHEN last_page > n_pages THEN 'page_ranges reference a page outside the file'
  WHEN list_sort(page_order) <> generate_series(first_page, last_page) THEN 'page_order must match the union of page_ranges'
  WHEN copy_page IS NOT NULL AND list_contains(page_order, copy_page) THEN 'duplicate_pages must not appear in page_order'
  WHEN copy_page IS NOT NULL AND copy_page > n_pages THEN 'duplicate_pages reference a page outside the file' END"""

_PATH = "coalesce(parent || '[].', '') || field_key"
_DEF_SQL = f"""{with_clause('f_groups', 'f_fields', 'f_variants')},
paths AS (SELECT *, {_PATH} AS path FROM f_fields), parents AS (SELECT DISTINCT group_code, parent AS path FROM f_fields WHERE parent IS NOT NULL),
nested AS (SELECT p.*, q.path IS NOT NULL AS kids FROM paths p LEFT JOIN parents q ON p.group_code = q.group_code AND p.path = q.path)
SELECT group_code, cast(NULL AS varchar) AS item, 'group_code must match pattern ^[a-z0-9_]+$' AS problem FROM f_groups WHERE NOT regexp_full_match(trim(group_code), '[a-z0-9_]+')
UNION ALL SELECT group_code, NULL, 'group_name and group_description must not be empty' FROM f_groups WHERE trim(group_name) = '' OR trim(group_description) = ''
UNION ALL SELECT group_code, path, 'data_type is not supported' FROM nested WHERE data_type NOT IN ('string', 'number', 'boolean', 'date', 'array')
UNION ALL SELECT group_code, path, 'required=False is not supported with strict structured output' FROM nested WHERE NOT required
UNION ALL SELECT group_code, path, 'child_schema is required when data_type is ''array''' FROM nested WHERE data_type = 'array' AND NOT kids
UNION ALL SELECT group_code, path, 'child_schema is only allowed when data_type is ''array''' FROM nested WHERE data_type <> 'array' AND kids
UNION ALL SELECT group_code, cast(position AS varchar), 'variant name must not be empty' FROM f_variants WHERE trim(name) = ''
UNION ALL SELECT DISTINCT group_code, NULL, 'fields must contain at least one field for non-unknown groups' FROM f_groups WHERE group_code NOT IN (SELECT group_code FROM f_fields WHERE parent IS NULL)
UNION ALL SELECT group_code, NULL, 'group_code values must be unique' FROM f_groups GROUP BY group_code HAVING count(*) > 1
UNION ALL SELECT group_code, field_key, 'field_key values must be unique per group' FROM f_fields WHERE parent IS NULL GROUP BY group_code, field_key HAVING count(*) > 1
UNION ALL SELECT group_code, lower(trim(name)), 'variant name values must be unique per group' FROM f_variants GROUP BY group_code, lower(trim(name)) HAVING count(*) > 1"""


def _lit(text: str) -> str:
    return "concat('" + text.replace("'", "''").replace("\n", "', chr(10), '") + "')"


def _marked(template: str, **values: str) -> str:
    sql = _lit(template)
    for name, value in values.items():
        sql = sql.replace("{" + name + "}", f"', {value}, '")
    return sql


_HEAD = _marked(
    K.EXTRACT_PROMPT_HEAD,
    document_code="d.document_code",
    group_name="g.group_name",
    document_name="d.document_name",
    page_order="'[' || array_to_string(generate_series(1, d.last_page), ', ') || ']'",
)
_PROMPT_SQL = f"""{with_clause('f_groups', 'f_fields', 'f_part_docs')},
hinted AS (SELECT *, coalesce(' - Hint: ' || coalesce(description, field_name), '') AS hint FROM f_fields),
kids AS (SELECT group_code, parent AS field_key, string_agg('- ' || field_key || ' (' || data_type || ')' || hint, ', ' ORDER BY position) AS inner_text FROM hinted WHERE parent IS NOT NULL GROUP BY 1, 2),
lines AS (SELECT h.group_code, h.position, '- ' || h.field_key || CASE WHEN h.data_type = 'array' THEN ' (array of objects: ' || coalesce(k.inner_text, '') || ')' ELSE ' (' || h.data_type || ')' END || h.hint AS line
  FROM hinted h LEFT JOIN kids k ON h.group_code = k.group_code AND h.field_key = k.field_key WHERE h.parent IS NULL),
described AS (SELECT group_code, string_agg(line, chr(10) ORDER BY position, line) AS body FROM lines GROUP BY 1)
SELECT d.file_id, concat({_HEAD}, coalesce(s.body, ''), {_lit(K.EXTRACT_PROMPT_TAIL)}) AS prompt
FROM f_part_docs d JOIN (SELECT group_code, min(group_name) AS group_name FROM f_groups GROUP BY 1) g ON d.document_code = g.group_code LEFT JOIN described s ON s.group_code = g.group_code"""

_BLOCKS_SQL = f"""{with_clause('f_groups', 'f_variants')},
titles AS (SELECT group_code, string_agg(CASE WHEN description IS NOT NULL THEN name || ' (' || description || ')' ELSE name END, ', ' ORDER BY position) AS titles FROM f_variants GROUP BY 1)
SELECT g.group_code, concat('- group_code/document_code: "', g.group_code, '"', chr(10), '  group_name: ', g.group_name, chr(10), '  group_description: ', g.group_description, chr(10),
 '  variants/sample titles: ', coalesce(t.titles, 'None')) AS block FROM f_groups g LEFT JOIN titles t ON g.group_code = t.group_code"""


def _kind(path: str) -> str:
    return f"coalesce(json_type(p, '$.{path}'), 'NULL')"


_NUMBERS = "('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"
_EXTRA_TOP = "list_sort(list_filter(json_keys(p), lambda k: NOT list_contains(['order_key', 'status', 'total', 'ordered', 'urgent', 'lines'], k)))"
_LINE_ERRORS = """list_filter(list_transform(from_json(json_extract(p, '$.lines'), '["JSON"]'), lambda x:
  CASE WHEN json_type(x) <> 'OBJECT' THEN 'lines array items must be objects'
       WHEN len(list_filter(json_keys(x), lambda k: NOT list_contains(['sku', 'qty'], k))) > 0 THEN 'lines array item contains unexpected keys: [' || array_to_string(list_transform(list_sort(list_filter(json_keys(x), lambda k: NOT list_contains(['sku', 'qty'], k))), lambda k: '''' || k || ''''), ', ') || ']'
       WHEN coalesce(json_type(x, '$.sku'), 'NULL') NOT IN ('NULL', 'VARCHAR') THEN 'sku must be a string or null'
       WHEN coalesce(json_type(x, '$.qty'), 'NULL') = 'NULL' THEN 'qty must not be null'
       WHEN json_type(x, '$.qty') NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'qty must be a number' END), lambda e: e IS NOT NULL)"""
_LINES_OUT = """'[' || array_to_string(list_transform(from_json(json_extract(p, '$.lines'), '["JSON"]'), lambda x:
  '{"sku":' || coalesce(cast(json_extract(x, '$.sku') AS varchar), 'null') || ',"qty":' || coalesce(cast(json_extract(x, '$.qty') AS varchar), 'null') || '}'), ',') || ']'"""
_UNKNOWN_ERROR = """CASE WHEN coalesce(array_to_string(list_sort(json_keys(p)), ','), '') <> 'fields,tables' THEN 'unknown extracted_data must contain fields and tables'
  WHEN len(list_filter(from_json(json_extract(p, '$.fields'), '["JSON"]'), lambda x: coalesce(array_to_string(list_sort(json_keys(x)), ','), '') <> 'field_key,field_name,value')) > 0 THEN 'unknown fields must contain field_key, field_name, and value'
  WHEN len(list_filter(from_json(json_extract(p, '$.tables[*].rows[*].cells[*]'), '["JSON"]'), lambda x: coalesce(array_to_string(list_sort(json_keys(x)), ','), '') <> 'key,value')) > 0 THEN 'unknown table row cells must contain key and value' END"""
_UNKNOWN_ERROR = _UNKNOWN_ERROR.replace(
    "from_json(json_extract(p, '$.tables[*].rows[*].cells[*]'), '[\"JSON\"]')", "json_extract(p, '$.tables[*].rows[*].cells[*]')"
)
_ORDER_ERROR = f"""CASE WHEN len({_EXTRA_TOP}) > 0 THEN 'extracted_data contains unexpected keys: [' || array_to_string(list_transform({_EXTRA_TOP}, lambda k: '''' || k || ''''), ', ') || ']'
  WHEN {_kind('order_key')} = 'NULL' THEN 'order_key must not be null' WHEN {_kind('order_key')} <> 'VARCHAR' THEN 'order_key must be a string'
  WHEN {_kind('status')} NOT IN ('NULL', 'VARCHAR') THEN 'status must be a string or null'
  WHEN {_kind('total')} <> 'NULL' AND {_kind('total')} NOT IN {_NUMBERS} THEN 'total must be a number or null'
  WHEN {_kind('ordered')} NOT IN ('NULL', 'VARCHAR') THEN 'ordered must be a string or null'
  WHEN {_kind('urgent')} NOT IN ('NULL', 'BOOLEAN') THEN 'urgent must be a boolean or null'
  WHEN {_kind('lines')} NOT IN ('NULL', 'ARRAY') THEN 'lines must be a array or null'
  WHEN {_kind('lines')} = 'ARRAY' THEN list_extract({_LINE_ERRORS}, 1) END"""


def _out(key: str) -> str:
    return f"coalesce(cast(json_extract(p, '$.{key}') AS varchar), 'null')"


_ORDER_OUT = (
    "concat('{\"order_key\":', " + _out("order_key") + ", ',\"status\":', " + _out("status") + ", ',\"total\":', " + _out("total")
    + ", ',\"ordered\":', " + _out("ordered") + ", ',\"urgent\":', " + _out("urgent")
    + f", ',\"lines\":', CASE WHEN {_kind('lines')} = 'ARRAY' THEN {_LINES_OUT} ELSE 'null' END, '}}')"
)
_EXTRACTED = f"""{with_clause('f_payloads')},
checked AS (SELECT *, CASE WHEN payload_text = 'no json' THEN NULL ELSE payload_text END AS p FROM f_payloads),
judged AS (SELECT *, CASE WHEN p IS NULL THEN 'payload is not a JSON object' WHEN document_code NOT IN ('order', 'unknown') THEN 'document_code has no field list'
  WHEN document_code = 'unknown' THEN {_UNKNOWN_ERROR} ELSE {_ORDER_ERROR} END AS extraction_error FROM checked),
extracted AS (SELECT file_id, document_code, extraction_error, CASE WHEN extraction_error IS NULL THEN CASE WHEN document_code = 'unknown' THEN payload_text ELSE {_ORDER_OUT} END END AS extracted_data FROM judged)"""

_AUTH = "regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')"
_URL_PATH = "regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '^([^?#]*)', 1)"
_LAST = f"list_extract(string_split({_URL_PATH}, '/'), -1)"
_EXT = f"lower(regexp_extract({_LAST}, '\\.([^.]*)$', 1))"
_URLS = f"{with_clause('f_fetch')}, u AS (SELECT *, {_AUTH} AS auth FROM f_fetch), h AS (SELECT *, lower(regexp_extract(auth, '^([^:]*)', 1)) AS host, regexp_extract(auth, ':(.*)$', 1) AS port FROM u)"

CHECKS = {
    "allowed_groups": f"{_SEG} SELECT file_id, doc_no, document_code, 'Chat' AS group_name, coalesce(nullif(document_name, ''), 'Chat') AS document_name FROM seg WHERE document_code = 'chat'",
    "page_check": f"{_SEG} SELECT file_id, doc_no, {_PAGE_ERROR} AS page_error FROM seg",
    "page_expand": f"""{_SEG} SELECT file_id, doc_no, cast(unnest(generate_series(first_page, last_page)) AS int) AS page, cast(NULL AS varchar) AS error FROM seg WHERE last_page <= n_pages
UNION ALL SELECT file_id, doc_no, NULL, 'page_ranges reference a page outside the file' FROM seg WHERE last_page > n_pages""",
    "page_overlap": f"""{_SEG}, ok AS (SELECT * FROM seg WHERE document_code = 'chat' AND ({_PAGE_ERROR}) IS NULL),
px AS (SELECT file_id, doc_no, unnest(generate_series(first_page, last_page)) AS page FROM ok),
lap AS (SELECT a.file_id, a.doc_no, a.page FROM px a WHERE EXISTS (SELECT 1 FROM px b WHERE b.file_id = a.file_id AND b.page = a.page AND b.doc_no < a.doc_no)),
firsts AS (SELECT file_id, min(doc_no) AS doc_no FROM lap GROUP BY 1)
SELECT l.file_id, l.doc_no, 'page_ranges overlap across documents: [' || string_agg(cast(l.page AS varchar), ', ' ORDER BY l.page) || ']' AS overlap_error
FROM lap l JOIN firsts f ON l.file_id = f.file_id AND l.doc_no = f.doc_no GROUP BY 1, 2""",
    "ordered_pages": f"""{_SEG}, w AS (SELECT file_id, doc_no, unnest(page_order) AS page_number, generate_subscripts(page_order, 1) AS position FROM seg)
SELECT w.file_id, w.doc_no, cast(w.position AS int) AS position, cast(w.page_number AS int) AS page_number, c.role, cast(length(c.text) AS int) AS chars,
 CASE WHEN c.conv_id IS NULL THEN 'page_order references missing page ' || cast(w.page_number AS varchar) END AS error
FROM w LEFT JOIN conversations c ON c.conv_id = w.file_id AND c.turn + 1 = w.page_number""",
    "unique_check": "SELECT lang, sha256(text) AS text_digest, count(*) AS uses FROM documents GROUP BY lang, text HAVING count(*) > 1",
    "schema_paths": f"""{with_clause('f_fields')} SELECT group_code, {_PATH} AS path, CASE WHEN data_type IN ('number', 'boolean', 'array') THEN data_type ELSE 'string' END AS json_type,
 nullable, coalesce(description, field_name) AS description FROM f_fields""",
    "schema_def_check": _DEF_SQL,
    "prompt_render": _PROMPT_SQL,
    "classify_blocks": _BLOCKS_SQL,
    "classify_prompts": f"""WITH blocks AS ({_BLOCKS_SQL}), listed AS (SELECT string_agg(block, chr(10) ORDER BY group_code, block) AS groups FROM blocks)
SELECT conv_id AS file_id, concat({_marked(K.CLASSIFY_PROMPT_HEAD, page_count="cast(max(turn) + 1 AS varchar)")}, any_value(groups), {_lit(K.CLASSIFY_PROMPT_TAIL)}) AS prompt FROM conversations, listed GROUP BY conv_id""",
    "extract_normalize": f"{_EXTRACTED} SELECT file_id, extraction_error, extracted_data FROM extracted",
    "unknown_check": f"""{_EXTRACTED} SELECT file_id, CASE WHEN p IS NULL THEN 'payload is not a JSON object' ELSE {_UNKNOWN_ERROR} END AS structure_error FROM checked""",
    "extract_emit": f"""{_EXTRACTED} SELECT file_id, cast(1 AS int) AS doc_no, CASE WHEN extraction_error IS NULL THEN concat('{{"document_code":"', document_code, '","group_name":"', upper(document_code[1]) || document_code[2:], '","document_name":"Scan","page_order":[1],"duplicate_pages":[],"extracted_data":', extracted_data, '}}') END AS document, extraction_error FROM extracted""",
    "url_screen": f"""{_URLS} SELECT page_id, host, CASE WHEN NOT (url LIKE 'http://%' OR url LIKE 'https://%') OR host = '' THEN 'file_url must be a valid HTTP/HTTPS URL'
 WHEN host = 'localhost' OR host LIKE '%.localhost' THEN 'file_url host is not allowed'
 WHEN port <> '' AND (try_cast(port AS int) IS NULL OR try_cast(port AS int) > 65535) THEN 'invalid file_url port' END AS url_error FROM h""",
    "url_filename": f"{with_clause('f_fetch')} SELECT page_id, coalesce(nullif({_LAST}, ''), 'downloaded_file')[1:100] AS file_name FROM f_fetch",
    "mime_sniff": f"""{with_clause('f_fetch')}, t AS (SELECT page_id, lower(trim(split_part(content_type, ';', 1))) AS declared, {_EXT} AS ext, content_hex AS h FROM f_fetch),
m AS (SELECT page_id, CASE WHEN declared <> '' THEN declared WHEN ext = 'pdf' THEN 'application/pdf' WHEN ext IN ('jpg', 'jpeg') THEN 'image/jpeg' WHEN ext = 'png' THEN 'image/png' WHEN ext IN ('html', 'htm') THEN 'text/html'
 WHEN h LIKE '25504446%' THEN 'application/pdf' WHEN h LIKE '89504E470D0A1A0A%' THEN 'image/png' WHEN h LIKE 'FFD8FF%' THEN 'image/jpeg'
 WHEN h LIKE '52494646________57454250%' THEN 'image/webp' ELSE 'application/octet-stream' END AS mime_type FROM t)
SELECT page_id, mime_type, CASE WHEN mime_type NOT IN ('image/png', 'image/jpeg', 'image/jpg', 'image/webp', 'application/pdf') THEN 'unsupported file content type: ' || mime_type END AS mime_error FROM m""",
    "fetch_status": f"""{with_clause('f_fetch')} SELECT page_id, CASE outcome WHEN 'timeout' THEN 504 WHEN 'invalid_url' THEN 400 WHEN 'network' THEN 502
 ELSE CASE WHEN status BETWEEN 200 AND 299 THEN 200 WHEN status = 404 THEN 404 WHEN status BETWEEN 400 AND 499 THEN 400 ELSE 502 END END AS answer_status,
 CASE outcome WHEN 'timeout' THEN 'file download timed out' WHEN 'invalid_url' THEN 'invalid file_url' WHEN 'network' THEN 'failed to download file'
 ELSE CASE WHEN NOT status BETWEEN 200 AND 299 THEN 'failed to download file: upstream returned ' || cast(status AS varchar) END END AS detail FROM f_fetch""",
    "size_caps": f"""{with_clause('f_fetch')}, r AS (SELECT page_id, CASE WHEN redirects > 5 THEN 1 WHEN redirects > 0 AND redirect_location IS NULL THEN 2
 WHEN content_length = 'many' THEN 3 WHEN try_cast(content_length AS bigint) > 52428800 OR body_bytes > 52428800 THEN 4 WHEN n_pages > 20 THEN 5 END AS rule FROM f_fetch)
SELECT page_id, CASE rule WHEN 1 THEN 400 WHEN 2 THEN 502 WHEN 3 THEN 400 WHEN 4 THEN 413 WHEN 5 THEN 413 END AS cap_status,
 CASE rule WHEN 1 THEN 'too many redirects while downloading file' WHEN 2 THEN 'upstream redirect missing location' WHEN 3 THEN 'invalid content-length'
 WHEN 4 THEN 'file exceeds MAX_FILE_BYTES' WHEN 5 THEN 'PDF exceeds MAX_PDF_PAGES' END AS cap_error FROM r""",
    "url_public": f"""{with_clause('f_addresses')} SELECT page_id, count(address) AS addresses, CASE WHEN count(address) = 0 THEN 'file_url host did not resolve'
 WHEN NOT bool_and(address IS NOT NULL AND address IN ('2606:2800:220:1::1', '93.184.216.34', '192.0.0.9', '8.8.8.8')) THEN 'file_url host resolves to a private or reserved address' END AS address_error FROM f_addresses GROUP BY page_id""",
}
