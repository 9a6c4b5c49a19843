"""Operator inputs derived from the driver tables.

Each entry is one SELECT that Spark SQL and DuckDB both read, so a query and its check
start from the same rows. Inputs that need an ordered scan are built with operators.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark import constants as K
from tallymark.operators.labels import SIDE_TEMPLATES
from tallymark.operators.skew import lookup_join, running_sum
from tallymark.session import prepare_session
from tallymark.sources.readers import TABLES, table

BUCKETS = ("10", "25", "50", "100", "250", "+Inf")
BACKSLASH = "chr(92)"


def json_text(template: dict[str, Any], values: dict[str, str], drop: tuple[str, ...] = (), extra: str = "") -> str:
    """SQL for the JSON text of a payload: leaves from `values` (SQL for the JSON
    spelling), else null; keys in `drop` are left out, `extra` ends the fields."""

    def parts(node: dict[str, Any], path: str) -> list[str]:
        pieces: list[str] = []
        first = True
        for key, item in node.items():
            here = f"{path}.{key}" if path else key
            if here in drop:
                continue
            lead = "" if first else ","
            first = False
            if isinstance(item, dict):
                pieces += [f"'{lead}\"{key}\":{{'", *parts(item, here)]
                if here == "fields" and extra:
                    pieces.append(f"'{extra}'")
                pieces.append("'}'")
            elif here in values:
                pieces += [f"'{lead}\"{key}\":'", values[here]]
            elif item is None:
                pieces.append(f"'{lead}\"{key}\":null'")
            else:
                pieces.append(f"'{lead}\"{key}\":\"{item}\"'")
        return pieces

    return "concat('{', " + ", ".join(parts(template, "")) + ", '}')"


_ID = "cast(c_custkey AS string)"
_QUOTED = {
    "front": {
        "fields.id_number": f"concat('\"', {_ID}, '\"')",
        "fields.full_name": "concat('\"', c_name, '\"')",
        "fields.nationality": "concat('\"', c_mktsegment, '\"')",
    },
    "back": {
        "fields.special_mark": "concat('\"', c_name, '\"')",
        "fields.mrz.document_number": f"concat('\"', {_ID}, '\"')",
        "fields.mrz.country": "concat('\"', c_mktsegment, '\"')",
    },
}
_NAME = {"front": "fields.full_name", "back": "fields.special_mark"}
_NUMBER = {"front": "fields.id_number", "back": "fields.mrz.document_number"}
_DROPPED = {"front": "fields.gender", "back": "fields.mrz.checksum"}


def _per_side(build) -> str:
    return f"CASE WHEN c_nationkey < 15 THEN {build('front')} ELSE {build('back')} END"


def _response(side: str) -> str:
    template, values = SIDE_TEMPLATES[side], _QUOTED[side]
    plain = json_text(template, values)
    loud = json_text(template, {**values, _NAME[side]: "concat('\"  ', upper(c_name), ' \"')"})
    short = json_text(template, values, drop=(_DROPPED[side],))
    cased = json_text({**template, "document_type": template["document_type"].upper()}, values, extra=',"extra":"x"')
    typed = json_text(template, {**values, _NUMBER[side]: _ID})
    return (
        f"CASE c_custkey % 8 WHEN 1 THEN concat('```json', chr(10), {plain}, chr(10), '```') WHEN 2 THEN {loud} "
        f"WHEN 3 THEN {short} WHEN 4 THEN {cased} WHEN 5 THEN 'sorry, unreadable' WHEN 6 THEN {typed} "
        f"WHEN 7 THEN '[1,2]' ELSE {plain} END"
    )


def _escaped(column: str) -> str:
    """SQL that writes a text as the inside of a JSON string."""
    double = f"replace({column}, {BACKSLASH}, concat({BACKSLASH}, {BACKSLASH}))"
    quotes = f"replace({double}, '\"', concat({BACKSLASH}, '\"'))"
    return f"replace({quotes}, chr(10), concat({BACKSLASH}, 'n'))"


FIXTURES: dict[str, str] = {}

FIXTURES["f_bench"] = """
SELECT concat('m', cast(user_id % 10 AS string)) AS model, cast(ts AS date) AS run_day, ts, event_id,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, value / 97 AS latency_s
FROM events
"""

FIXTURES["f_labels"] = """
SELECT c_custkey + 2 AS csv_row,
       CASE WHEN c_custkey % 20 = 18 THEN '  '
            WHEN c_custkey % 20 = 17 THEN concat('missing_', c_name)
            WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS c0,
       CASE WHEN c_custkey % 20 < 10 OR c_custkey % 20 = 16 THEN concat(' ', c_name) END AS c1,
       CASE WHEN c_custkey % 20 < 10 THEN c_mktsegment END AS c2,
       CASE WHEN c_custkey % 20 < 10 THEN cast(c_nationkey AS string) END AS c3,
       CASE WHEN c_custkey % 20 BETWEEN 10 AND 16 THEN c_mktsegment END AS c9,
       CASE WHEN c_custkey % 40 = 18 THEN c_name END AS c11,
       CASE WHEN c_custkey % 20 BETWEEN 10 AND 15 THEN concat(cast(c_custkey AS string), ' ') END AS c13
FROM customer
"""

FIXTURES["f_inventory"] = "SELECT CASE WHEN c_acctbal >= 0 THEN c_name ELSE concat('gone_', c_name) END AS name, c_custkey * 1000 AS length FROM customer"

FIXTURES["f_part_names"] = """
SELECT p_partkey AS item, CASE WHEN p_size < 10 THEN upper(p_name) WHEN p_size < 20 AND p_type = 'PROMO' THEN concat(p_name, '.') ELSE p_name END AS name
FROM part
"""

FIXTURES["f_truth"] = f"""
SELECT c_custkey AS line_number, CASE WHEN c_nationkey < 15 THEN 'front' ELSE 'back' END AS side, c_name AS image,
       {_per_side(lambda side: json_text(SIDE_TEMPLATES[side], _QUOTED[side]))} AS expected_text,
       {_per_side(_response)} AS response, c_custkey % 5 AS shape,
       CASE WHEN c_custkey % 8 IN (0, 2, 3, 4, 6) THEN true ELSE false END AS object_reply,
       CASE WHEN c_custkey % 25 = 24 THEN 503 ELSE 200 END AS http_status, (c_custkey % 97) / 10.0 AS latency_s
FROM customer
"""

FIXTURES["f_replies"] = f"""
SELECT line_number, side, http_status, cast(latency_s AS double) AS latency_s,
       CASE WHEN http_status = 503 THEN 'upstream unavailable'
            WHEN shape = 3 THEN concat('{{"choices":[{{"message":{{"content":[{{"type":"text","text":"', {_escaped("response")}, '"}},{{"type":"image"}},{{"type":"text","text":" "}}]}}}}]}}')
            WHEN shape = 4 AND object_reply THEN concat('{{"choices":[{{"message":{{"content":null,"parsed":', response, '}}}}]}}')
            WHEN shape = 2 AND line_number % 7 = 0 THEN '{{"choices":[{{"message":{{"refusal":"not allowed","content":null}}}}]}}'
            WHEN shape = 2 AND line_number % 7 = 1 THEN '{{"choices":[]}}'
            WHEN shape = 1 AND line_number % 7 = 2 THEN concat('{{"choices":[{{"message":{{"content":"Here it is: ', {_escaped("response")}, ' - done }}"}}}}]}}')
            ELSE concat('{{"choices":[{{"message":{{"content":"', {_escaped("response")}, '"}}}}]}}') END AS body
FROM f_truth
"""

FIXTURES["f_fetch"] = """
SELECT page_id,
       CASE page_id % 9 WHEN 1 THEN replace(replace(url, 'https://', 'ftp://'), 'http://', 'ftp://')
                        WHEN 2 THEN 'http://localhost/a.pdf'
                        WHEN 3 THEN 'https://files.example.org:port/a.pdf'
                        WHEN 4 THEN 'https://files.example.org/dir/report.pdf?x=1'
                        WHEN 5 THEN 'https://me@Files.Example.org:8443/pics/scan.JPG'
                        WHEN 6 THEN 'http://files.example.org:70000/x.png'
                        ELSE url END AS url,
       CASE page_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 403 WHEN 3 THEN 503 WHEN 4 THEN 200 ELSE 302 END AS status,
       CASE page_id % 11 WHEN 0 THEN 'timeout' WHEN 1 THEN 'invalid_url' WHEN 2 THEN 'network' ELSE 'http' END AS outcome,
       CASE page_id % 4 WHEN 0 THEN 'Application/PDF; charset=x' WHEN 1 THEN '' WHEN 2 THEN 'image/PNG' ELSE 'text/html' END AS content_type,
       CASE page_id % 13 WHEN 0 THEN 'many' WHEN 1 THEN NULL ELSE cast(length(html) * 20000 AS string) END AS content_length,
       cast(length(html) * 15000 AS bigint) AS body_bytes,
       page_id % 8 AS redirects, CASE WHEN page_id % 16 = 3 THEN NULL ELSE url END AS redirect_location,
       page_id % 24 AS n_pages,
       concat(CASE page_id % 5 WHEN 0 THEN '25504446' WHEN 1 THEN '89504E470D0A1A0A' WHEN 2 THEN 'FFD8FF' WHEN 3 THEN '524946460000000057454250' ELSE '' END, hex(html)) AS content_hex
FROM pages
"""

FIXTURES["f_addresses"] = """
SELECT page_id, CASE page_id % 7 WHEN 0 THEN '10.0.0.7' WHEN 1 THEN '192.168.1.9' WHEN 2 THEN '127.0.0.1' WHEN 3 THEN '2606:2800:220:1::1'
                             WHEN 4 THEN '93.184.216.34' WHEN 5 THEN NULL ELSE '192.0.0.9' END AS address FROM pages
UNION ALL
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'fe80::1' WHEN page_id % 5 = 1 THEN '100.64.1.1' WHEN page_id % 7 = 5 THEN NULL ELSE '8.8.8.8' END AS address FROM pages
"""

FIXTURES["f_entries"] = """
SELECT p_partkey AS id, p_partkey AS position,
       CASE p_partkey % 4 WHEN 0 THEN 'safetensors' WHEN 1 THEN 'pytorch' WHEN 2 THEN 'gguf' ELSE 'other' END AS format,
       CASE WHEN p_size > 40 THEN concat('models/none/', p_name) ELSE concat('models/p', cast(p_partkey AS string)) END AS path,
       CASE WHEN p_partkey % 5 = 0 THEN 'vllm' END AS serving_target,
       CASE p_partkey % 5 WHEN 1 THEN 'vllm,sglang' WHEN 2 THEN 'llama.cpp,ollama' WHEN 3 THEN 'mlx' WHEN 4 THEN 'bogus' END AS targets_csv
FROM part
"""

FIXTURES["f_files"] = """
SELECT concat('models/p', cast(l_partkey AS string)) AS dir,
       CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 'weights.safetensors' WHEN l_returnflag = 'A' THEN 'notes.txt'
            WHEN l_returnflag = 'N' THEN 'sub/model.bin' WHEN l_linenumber = 2 THEN 'model.gguf' ELSE 'model.bin' END AS rel_path,
       cast(l_quantity * 1000000 AS bigint) AS length
FROM lineitem
"""

FIXTURES["f_requests"] = """
SELECT l_orderkey * 10 + l_linenumber AS request_id, l_partkey AS model_id,
       CASE l_linenumber % 6 WHEN 0 THEN 'vllm' WHEN 1 THEN 'sglang' WHEN 2 THEN 'llama.cpp' WHEN 3 THEN 'mlx' WHEN 4 THEN 'ollama' ELSE 'triton' END AS runtime
FROM lineitem
"""

FIXTURES["f_bindings"] = """
SELECT concat('b', cast(p_partkey AS string)) AS id,
       CASE p_size % 7 WHEN 0 THEN 'vllm' WHEN 1 THEN 'sglang' WHEN 2 THEN 'llama.cpp' WHEN 3 THEN 'mlx' WHEN 4 THEN 'triton' ELSE 'ollama' END AS runtime,
       CASE p_type WHEN 'PROMO' THEN 'ollama' WHEN 'SMALL' THEN 'other' WHEN 'LARGE' THEN 'ollama' ELSE 'registry' END AS model_type,
       CASE WHEN p_partkey % 10 = 9 THEN NULL ELSE p_partkey END AS model_id,
       CASE WHEN p_partkey % 10 = 8 THEN '' ELSE p_name END AS model_name,
       CASE WHEN p_partkey % 10 = 7 THEN NULL ELSE 'openai' END AS provider, p_name AS gateway_model
FROM part
"""

FIXTURES["f_services"] = """
SELECT s_suppkey AS service_id, concat('group', cast(s_nationkey % 4 AS string)) AS group,
       CASE WHEN s_suppkey % 3 = 0 THEN concat('http://', lower(replace(s_name, '#', '-'))) END AS eval_endpoint,
       CASE WHEN s_acctbal > 0 THEN concat('stacks/', cast(s_nationkey AS string), '/compose.yml') END AS compose_file,
       CASE s_suppkey % 6 WHEN 0 THEN 'Latest' WHEN 1 THEN 'nightly-2024' WHEN 2 THEN 'v1.2.3' WHEN 3 THEN 'main' WHEN 4 THEN 'main-2' ELSE 'STABLE' END AS tag
FROM supplier
"""

FIXTURES["f_settings"] = """
SELECT concat('svc', cast(c_nationkey AS string)) AS service, CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS layer, c_custkey AS line_no,
       CASE WHEN c_custkey % 9 = 0 THEN concat('# ', c_name) WHEN c_custkey % 9 = 1 THEN '   ' WHEN c_custkey % 9 = 2 THEN c_name
            ELSE concat(' KEY_', c_mktsegment, ' = "', c_name, '=', cast(c_custkey AS string), '" ') END AS text
FROM customer
"""

FIXTURES["f_groups"] = """
SELECT DISTINCT CASE WHEN p_brand = 'Brand#7' THEN p_brand WHEN p_brand = 'Brand#25' THEN 'brand_24' ELSE lower(replace(p_brand, '#', '_')) END AS group_code,
       p_brand AS group_name, CASE WHEN p_brand = 'Brand#3' THEN '  ' ELSE concat('Documents of ', p_brand) END AS group_description
FROM part
"""

FIXTURES["f_fields"] = """
SELECT DISTINCT lower(replace(p_brand, '#', '_')) AS group_code, cast(NULL AS string) AS parent,
       CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4 WHEN 'LARGE' THEN 5 ELSE 6 END AS position,
       CASE WHEN p_brand = 'Brand#5' AND p_type = 'PROMO' THEN 'large' ELSE lower(p_type) END AS field_key,
       CASE p_type WHEN 'ECONOMY' THEN 'array' WHEN 'STANDARD' THEN 'number' WHEN 'MEDIUM' THEN 'boolean' WHEN 'PROMO' THEN 'date' WHEN 'LARGE' THEN 'string' ELSE 'text' END AS data_type,
       initcap_name AS field_name, CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN concat(p_type, ' of ', p_brand) END AS description,
       CASE WHEN p_type = 'LARGE' THEN false ELSE true END AS nullable, CASE WHEN p_brand = 'Brand#9' AND p_type = 'LARGE' THEN false ELSE true END AS required
FROM (SELECT CASE WHEN p_brand = 'Brand#11' THEN 'Brand#110' ELSE p_brand END AS p_brand, p_type, concat('The ', lower(p_type)) AS initcap_name FROM part) p
UNION ALL
SELECT DISTINCT lower(replace(CASE WHEN p_brand = 'Brand#13' THEN 'Brand#130' ELSE p_brand END, '#', '_')) AS group_code, CASE WHEN p_brand = 'Brand#12' THEN 'large' ELSE 'economy' END AS parent, p_size % 3 + 1 AS position,
       concat('c', cast(p_size % 3 AS string)) AS field_key, CASE p_size % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'number' ELSE 'date' END AS data_type,
       cast(NULL AS string) AS field_name, CASE WHEN p_size % 3 = 1 THEN 'count' END AS description, true AS nullable, true AS required
FROM part
"""

FIXTURES["f_variants"] = """
SELECT DISTINCT lower(replace(p_brand, '#', '_')) AS group_code, p_size AS position,
       CASE WHEN p_size = 1 THEN ' ' WHEN p_size = 50 THEN 'VARIANT 49' ELSE concat('Variant ', cast(p_size AS string)) END AS name,
       CASE WHEN p_size > 25 THEN 'late' END AS description
FROM part
"""

FIXTURES["f_part_docs"] = """
SELECT p_partkey AS file_id, cast(1 AS int) AS doc_no, lower(replace(p_brand, '#', '_')) AS document_code, p_name AS document_name, p_size % 3 + 1 AS last_page
FROM part
"""

FIXTURES["f_payloads"] = """
SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 16 = 15 THEN 'unknown' WHEN o_orderkey % 16 = 14 THEN 'receipt' ELSE 'order' END AS document_code,
       CASE o_orderkey % 16
         WHEN 1 THEN concat('{"total":', cast(o_custkey AS string), ',"status":"', o_orderstatus, '","order_key":"', cast(o_orderkey AS string), '"}')
         WHEN 2 THEN concat('{"order_key":null,"status":"', o_orderstatus, '"}')
         WHEN 3 THEN concat('{"order_key":"', cast(o_orderkey AS string), '","zeta":1,"alpha":2}')
         WHEN 4 THEN concat('{"order_key":"', cast(o_orderkey AS string), '","total":"', cast(o_custkey AS string), '"}')
         WHEN 5 THEN concat('{"order_key":"', cast(o_orderkey AS string), '","total":true}')
         WHEN 6 THEN concat('{"order_key":"', cast(o_orderkey AS string), '","urgent":"yes"}')
         WHEN 7 THEN concat('{"order_key":"', cast(o_orderkey AS string), '","lines":{"sku":"a"}}')
         WHEN 8 THEN concat('{"order_key":"', cast(o_orderkey AS string), '","lines":[{"sku":"a","qty":1},7]}')
         WHEN 9 THEN concat('{"order_key":"', cast(o_orderkey AS string), '","lines":[{"qty":2,"sku":"b"},{"sku":"a","tax":3}]}')
         WHEN 10 THEN concat('{"order_key":"', cast(o_orderkey AS string), '","lines":[{"qty":2},{"sku":"a","qty":null}]}')
         WHEN 11 THEN concat('{"order_key":"', cast(o_orderkey AS string), '","ordered":19980101}')
         WHEN 12 THEN 'no json'
         WHEN 15 THEN CASE o_custkey % 4
              WHEN 0 THEN concat('{"fields":[{"field_key":"k","field_name":"K","value":"', o_orderpriority, '"}],"tables":[]}')
              WHEN 1 THEN '{"fields":[{"field_key":"k","value":"v"}],"tables":[]}'
              WHEN 2 THEN '{"fields":[],"tables":[{"table_key":"t","table_name":"T","columns":[{"key":"a","label":"A"}],"rows":[{"cells":[{"key":"a"}]}]}]}'
              ELSE '{"fields":[]}' END
         ELSE concat('{"order_key":"', cast(o_orderkey AS string), '","status":"', o_orderstatus, '","total":', cast(o_custkey AS string),
                     ',"urgent":', CASE WHEN o_orderpriority = '1-URGENT' THEN 'true' ELSE 'false' END,
                     ',"lines":[{"qty":', cast(o_custkey % 9 AS string), ',"sku":"s"},{"sku":null,"qty":2}]}') END AS payload_text
FROM orders
"""

FIXTURES["f_metrics"] = """
SELECT event_type AS metric, concat('i', cast(user_id % 3 AS string)) AS instance, ts, cast(ts AS date) AS day, event_id, value,
       cast(round(value * 100) AS bigint) AS cents
FROM events
"""

FIXTURES["f_lines"] = """
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN concat('# HELP ', event_type, ' help')
       ELSE concat(event_type, CASE WHEN event_id % 10 = 1 THEN '' ELSE concat('{instance="i', cast(user_id % 3 AS string), '",user="', CASE WHEN event_id % 10 = 2 THEN concat('a', chr(92), '"b') ELSE cast(user_id AS string) END, '"}') END,
                   ' ', cast(cast(round(value * 100) AS bigint) AS string), CASE WHEN event_id % 3 = 0 THEN concat(' ', cast(event_id AS string)) ELSE '' END) END AS line
FROM events
"""

FIXTURES["f_models"] = """
SELECT s_suppkey AS model_no, concat('host', cast(s_nationkey AS string)) AS source, CASE WHEN s_acctbal > 4000 THEN true ELSE false END AS loaded,
       s_name AS model, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat('say "', cast(s_suppkey AS string), '"') END AS family,
       CASE WHEN s_suppkey % 5 = 0 THEN 'n/a' ELSE cast(cast(round(s_acctbal * 1000) AS bigint) AS string) END AS size
FROM supplier
"""

FIXTURES["f_sources"] = """
SELECT concat('host', cast(n_nationkey AS string)) AS source, CASE WHEN n_nationkey % 6 = 5 THEN false ELSE true END AS up, (n_nationkey + 1) / 8.0 AS scrape_seconds
FROM nation
"""

# Fixtures that read another fixture.
NEEDS = {"f_replies": ("f_truth",)}


def with_clause(*names: str) -> str:
    """WITH list for a check that reads the fixtures."""
    wanted: list[str] = []
    for name in names:
        wanted += [item for item in (*NEEDS.get(name, ()), name) if item not in wanted]
    return "WITH " + ", ".join(f"{name} AS ({FIXTURES[name]})" for name in wanted)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of a fixture at a scale folder."""
    prepare_session(spark)
    for needed in NEEDS.get(name, ()):
        load(spark, folder, needed).createOrReplaceTempView(needed)
    for base in TABLES:
        if re.search(rf"FROM {base}\b", FIXTURES[name]):
            table(spark, folder, base).createOrReplaceTempView(base)
    return spark.sql(FIXTURES[name])


def timed(df: DataFrame) -> DataFrame:
    """Session-zone timestamps instead of zoneless ones."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def entries(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, "f_entries")
    return df.withColumn("serving_targets", F.split("targets_csv", ",")).drop("targets_csv")


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """Counter per metric and instance that starts again every day."""
    base = timed(load(spark, folder, "f_metrics"))
    summed = running_sum(
        base, ["metric", "instance", "day"], ["ts", "event_id"], {"counter": F.col("cents")}
    )
    return summed.select("metric", "instance", "ts", (F.col("counter") / 100.0).alias("value"))


def bucket_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Cumulative histogram buckets of the values, restarting every day."""
    base = timed(load(spark, folder, "f_metrics"))

    def inside(bound: str):
        return F.lit(1) if bound == "+Inf" else F.when(F.col("value") <= float(bound), 1).otherwise(0)

    summed = running_sum(
        base,
        ["metric", "instance", "day"],
        ["ts", "event_id"],
        {f"le_{i}": inside(bound).cast("bigint") for i, bound in enumerate(BUCKETS)},
    )
    pairs = F.array(
        *[F.struct(F.lit(bound).alias("le"), F.col(f"le_{i}").cast("double").alias("value")) for i, bound in enumerate(BUCKETS)]
    )
    return summed.select("metric", "instance", "ts", F.inline(pairs))


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of two turns each; a conversation is a file, a turn a page."""
    turns = table(spark, folder, "conversations").withColumnRenamed("conv_id", "file_id")
    pairs = turns.groupBy("file_id", F.floor(F.col("turn") / 2).cast("bigint").alias("doc_no")).agg(
        (F.min("turn") + 1).alias("first_page"), (F.max("turn") + 1).alias("last_page")
    )
    files = turns.groupBy("file_id").agg((F.max("turn") + 1).alias("n_pages"))
    kind = F.pmod("file_id", F.lit(6))
    shaped = lookup_join(pairs, files, ["file_id"], ["doc_no"], "inner").select(
        "file_id",
        "doc_no",
        F.col("n_pages").cast("int").alias("n_pages"),
        F.col("first_page").cast("int").alias("first_page"),
        F.when(kind == 2, F.col("n_pages") + 1)
        .when((kind == 4) & (F.col("last_page") < F.col("n_pages")), F.col("last_page") + 1)
        .otherwise(F.col("last_page"))
        .cast("int")
        .alias("last_page"),
        F.when((kind == 5) & (F.col("doc_no") == 1), F.lit("unknown")).otherwise("chat").alias("document_code"),
        F.when(F.col("doc_no") % 2 == 0, F.lit("")).otherwise("Titled").alias("document_name"),
    )
    order = (
        F.when(kind == 1, F.slice(F.sequence("first_page", "last_page"), F.lit(1), F.col("last_page") - F.col("first_page")))
        .when(kind == 3, F.concat(F.sequence("first_page", "last_page"), F.array("first_page")))
        .otherwise(F.sequence("first_page", "last_page"))
    )
    copies = F.when(
        (kind == 0) & (F.col("doc_no") == 0),
        F.array(F.struct((F.col("last_page") + 1).alias("page"), F.col("first_page").alias("duplicate_of"))),
    ).otherwise(F.array().cast("array<struct<page: int, duplicate_of: int>>"))
    return shaped.select(
        "*",
        F.array(F.array("first_page", "last_page")).alias("page_ranges"),
        order.alias("page_order"),
        copies.alias("duplicate_pages"),
    )


# Check-side twin of segments(), with the page lists as DuckDB lists.
SEGMENTS_SQL = """
SELECT *, CASE WHEN file_id % 6 = 1 THEN generate_series(first_page, last_page - 1)
               WHEN file_id % 6 = 3 THEN list_concat(generate_series(first_page, last_page), [first_page])
               ELSE generate_series(first_page, last_page) END AS page_order,
       CASE WHEN file_id % 6 = 0 AND doc_no = 0 THEN last_page + 1 END AS copy_page
FROM (
  SELECT p.file_id, p.doc_no, f.n_pages, p.first_page,
         CASE WHEN p.file_id % 6 = 2 THEN f.n_pages + 1
              WHEN p.file_id % 6 = 4 AND p.last_page < f.n_pages THEN p.last_page + 1 ELSE p.last_page END AS last_page,
         CASE WHEN p.file_id % 6 = 5 AND p.doc_no = 1 THEN 'unknown' ELSE 'chat' END AS document_code,
         CASE WHEN p.doc_no % 2 = 0 THEN '' ELSE 'Titled' END AS document_name
  FROM (SELECT conv_id AS file_id, turn // 2 AS doc_no, min(turn) + 1 AS first_page, max(turn) + 1 AS last_page FROM conversations GROUP BY 1, 2) p
  JOIN (SELECT conv_id AS file_id, max(turn) + 1 AS n_pages FROM conversations GROUP BY 1) f ON p.file_id = f.file_id)
"""
