import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from tallymark import constants as K
from tallymark.functions import urls as U
from tallymark.operators import extraction as E
from tallymark.operators import fetchlog as L
from tallymark.operators import groups as G
from tallymark.operators import segments as S

DOC = (
    "file_id bigint, doc_no bigint, n_pages int, document_code string, group_name string, document_name string, "
    "page_ranges array<array<int>>, page_order array<int>, duplicate_pages array<struct<page: int, duplicate_of: int>>"
)


def docs(spark, *items):
    data = []
    for i, item in enumerate(items):
        ranges, order, copies, n = item.get("r", [[1, 2]]), item.get("o", [1, 2]), item.get("d", []), item.get("n", 3)
        data.append((item.get("f", 1), i, n, item.get("c", "invoice"), "?", item.get("t", ""), ranges, order, copies))
    return spark.createDataFrame(data, DOC)


def test_page_rules_in_order(spark):
    cases = [
        ({}, None),
        ({"o": []}, "page_order must not be empty"),
        ({"r": []}, "page_ranges must not be empty"),
        ({"r": [[0, 1]]}, "page_ranges must contain positive [start_page, end_page] pairs"),
        ({"r": [[2, 1]]}, "page_ranges must contain positive [start_page, end_page] pairs"),
        ({"r": [[1, 2], [2, 3]]}, "page_ranges must be disjoint"),
        ({"r": [[1, 2], [2, 2], [3, 1]]}, "page_ranges must be disjoint"),
        ({"r": [[1, 2], [3, 1], [2, 2]]}, "page_ranges must contain positive [start_page, end_page] pairs"),
        ({"o": [1, 1]}, "page_order must not contain duplicate pages"),
        ({"o": [1, 9]}, "page_order references a page outside the file"),
        ({"r": [[1, 9]]}, "page_ranges reference a page outside the file"),
        ({"r": [[1, 2_000_000_000]]}, "page_ranges reference a page outside the file"),
        ({"o": [1]}, "page_order must match the union of page_ranges"),
        ({"o": [2, 1]}, None),
        ({"r": [[2, 2], [1, 1]]}, None),
        ({"d": [(2, 1)]}, "duplicate_pages must not appear in page_order"),
        ({"d": [(7, 1)]}, "duplicate_pages reference a page outside the file"),
        ({"d": [(3, 3)]}, "duplicate_of must reference a page in page_order"),
        ({"d": [(3, 2)]}, None),
        ({"n": 21}, None),
    ]
    checked = S.check_pages(docs(spark, *[case for case, _ in cases]))
    got = {r.doc_no: r.page_error for r in checked.collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_files_of_any_length_expand(spark):
    frame = docs(
        spark,
        {"n": 21, "r": [[1, 21]]},
        {"f": 2, "n": 5000, "r": [[i, i] for i in range(1, 5001)]},
        {"f": 3, "n": 2, "r": [[1, 3]]},
        {"f": 4, "r": [[2, 1]]},
    )
    got = {}
    for r in S.expand_pages(frame).collect():
        got.setdefault(r.file_id, []).append((r.page, r.error))
    assert sorted(p for p, _ in got[1]) == list(range(1, 22)) and len(got[2]) == 5000
    assert got[3] == [(None, "page_ranges reference a page outside the file")]
    assert got[4] == [(None, "page_ranges must contain positive [start_page, end_page] pairs")]
    shared = docs(spark, {"n": 5000, "r": [[1, 4000]]}, {"n": 5000, "r": [[2, 2], [4001, 5000]]})
    assert [(r.doc_no, r.pages) for r in S.page_overlap(shared).collect()] == [(1, [2])]


def test_groups_allow_and_name(spark):
    groups = spark.createDataFrame([("invoice", "Invoice")], "group_code string, group_name string")
    kept = S.allowed_groups(docs(spark, {"t": ""}, {"t": "Bill"}, {"c": "unknown"}), groups).collect()
    assert sorted((r.document_name, r.group_name) for r in kept) == [("Bill", "Invoice"), ("Invoice", "Invoice")]


def test_overlap_names_first_offender(spark):
    frame = docs(
        spark,
        {"f": 1, "r": [[1, 2]]}, {"f": 1, "r": [[3, 3]]}, {"f": 1, "r": [[2, 3]]}, {"f": 1, "r": [[1, 1]]},
        {"f": 2, "r": [[1, 1]]}, {"f": 2, "r": [[2, 2]]},
    )
    rows = S.page_overlap(frame).select("file_id", "doc_no", S.overlap_error(F.col("pages")).alias("e")).collect()
    assert [tuple(r) for r in rows] == [(1, 2, "page_ranges overlap across documents: [2, 3]")]


def test_ordered_pages(spark):
    pages = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "file_id bigint, page_number int, content string")
    rows = S.ordered_pages(docs(spark, {"o": [2, 1, 3]}), pages).orderBy("position").collect()
    assert [(r.page_number, r.content) for r in rows] == [(2, "b"), (1, "a"), (3, None)]
    assert rows[2].error == "page_order references missing page 3"


INVOICE = [
    {"field_key": "number", "data_type": "string", "nullable": False},
    {"field_key": "total", "data_type": "number"},
    {"field_key": "paid", "data_type": "boolean"},
    {
        "field_key": "lines", "data_type": "array",
        "child_schema": [
            {"field_key": "sku", "data_type": "string"},
            {"field_key": "parts", "data_type": "array", "child_schema": [{"field_key": "n", "data_type": "number", "nullable": False}]},
        ],
    },
]


def extract(spark, payload, code="invoice"):
    text = payload if isinstance(payload, str) else json.dumps(payload)
    row = spark.createDataFrame([(code, text)], "document_code string, payload_text string")
    return E.normalize_extracted(row, {"invoice": INVOICE, "unknown": []}).first()


def test_extraction_fills_and_orders(spark):
    row = extract(spark, {"total": 2.5, "number": "é"})
    assert row.extracted_data == '{"number":"é","total":2.5,"paid":null,"lines":null}'
    nested = extract(spark, {"number": "1", "lines": [{"parts": [{"n": 1}], "sku": None}, {}]})
    assert nested.extracted_data == (
        '{"number":"1","total":null,"paid":null,"lines":[{"sku":null,"parts":[{"n":1}]},{"sku":null,"parts":null}]}'
    )


def test_extraction_errors(spark):
    cases = [
        ({}, "number must not be null"),
        ({"number": None}, "number must not be null"),
        ({"number": 1}, "number must be a string"),
        ({"number": "1", "b": 1, "a": 2}, "extracted_data contains unexpected keys: ['a', 'b']"),
        ({"number": "1", "total": True}, "total must be a number or null"),
        ({"number": "1", "paid": 1}, "paid must be a boolean or null"),
        ({"number": "1", "lines": {}}, "lines must be a array or null"),
        ({"number": "1", "lines": [1]}, "lines array items must be objects"),
        ({"number": "1", "lines": [{}, {"x": 1}]}, "lines array item contains unexpected keys: ['x']"),
        ({"number": "1", "lines": [{"parts": [{"n": None}]}]}, "n must not be null"),
        ("[]", "payload is not a JSON object"),
    ]
    for payload, want in cases:
        row = extract(spark, payload)
        assert (row.extraction_error, row.extracted_data) == (want, None), payload


def test_unknown_payload(spark):
    good = {
        "fields": [{"field_key": "a", "field_name": "A", "value": "1"}],
        "tables": [{"table_key": "t", "table_name": "T", "columns": [{"key": "a", "label": "A"}], "rows": [{"cells": [{"key": "a", "value": "1"}]}]}],
    }
    assert extract(spark, good, "unknown").extraction_error is None
    cases = [
        ({"fields": []}, "unknown extracted_data must contain fields and tables"),
        ({"fields": {}, "tables": []}, "unknown fields and tables must be arrays"),
        ({"fields": [{"field_key": "a"}], "tables": []}, "unknown fields must contain field_key, field_name, and value"),
        ({"fields": [], "tables": [1]}, "unknown tables must contain table_key, table_name, columns, and rows"),
        ({**good, "tables": [{**good["tables"][0], "rows": 1}]}, "unknown table columns and rows must be arrays"),
        ({**good, "tables": [{**good["tables"][0], "columns": [{"key": 1}]}]}, "unknown table columns must contain key and label"),
        ({**good, "tables": [{**good["tables"][0], "rows": [{"cells": 1}]}]}, "unknown table rows must contain cells"),
        ({**good, "tables": [{**good["tables"][0], "rows": [{"cells": [{"key": 1}]}]}]}, "unknown table row cells must contain key and value"),
    ]
    for payload, want in cases:
        assert extract(spark, payload, "unknown").extraction_error == want


def test_formats():
    group = {"group_code": "invoice", "group_name": "Invoice", "fields": INVOICE}
    schema = G.extraction_format(group)["json_schema"]["schema"]
    assert schema["required"] == ["number", "total", "paid", "lines"] and schema["additionalProperties"] is False
    assert schema["properties"]["total"]["anyOf"][1] == {"type": "null"}
    assert schema["properties"]["number"] == {"type": "string"}
    document = G.classify_format([group])["json_schema"]["schema"]["properties"]["documents"]["items"]
    assert document["properties"]["document_code"]["enum"] == ["invoice"]
    pair = document["properties"]["page_ranges"]["items"]
    assert (pair["minItems"], pair["maxItems"]) == (2, 2)
    unknown = G.extraction_format({"group_code": "unknown", "fields": []})["json_schema"]["schema"]
    assert unknown["required"] == ["fields", "tables"]


def test_url_rules(spark):
    cases = [
        ("https://Example.org./a/b.pdf?x", None, "example.org", "b.pdf"),
        ("HTTP://example.org", None, "example.org", "downloaded_file"),
        ("ftp://example.org/a", "file_url must be a valid HTTP/HTTPS URL", "example.org", "a"),
        ("https:///x", "file_url must be a valid HTTP/HTTPS URL", "", "x"),
        ("http://a.LOCALHOST:80/x", "file_url host is not allowed", "a.localhost", "x"),
        ("http://u:p@example.org:99999/", "invalid file_url port", "example.org", "downloaded_file"),
        ("http://example.org:x/", "invalid file_url port", "example.org", "downloaded_file"),
        ("http://[2001:db8::1]:8080/p/", None, "2001:db8::1", "downloaded_file"),
        ("https://example.org/" + "n" * 120, None, "example.org", "n" * 100),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, url string")
    got = {
        r.i: (r.e, r.h, r.f)
        for r in rows.select(
            "i", U.url_problem(F.col("url")).alias("e"), U.url_host(F.col("url")).alias("h"), U.file_name(F.col("url")).alias("f")
        ).collect()
    }
    assert [got[i] for i in range(len(cases))] == [c[1:] for c in cases]


def test_addresses_against_the_standard_library(spark):
    import ipaddress

    samples = [
        "8.8.8.8", "10.1.2.3", "100.64.0.1", "127.0.0.1", "169.254.1.1", "172.31.255.255", "172.32.0.0", "192.0.0.9",
        "192.0.0.1", "192.0.2.5", "192.168.0.1", "198.19.0.1", "198.51.100.1", "203.0.113.9", "224.0.0.1", "240.0.0.1",
        "255.255.255.255", "0.1.2.3", "1.1.1.1", "::1", "fe80::1%eth0", "2606:4700::1", "2001:db8::1", "fc00::1", "64:ff9b::1",
    ]
    rows = spark.createDataFrame([(a, a) for a in samples], "key string, address string")
    got = {r.key: r.address_error is None for r in L.public_addresses(rows, "key").collect()}
    for text in samples:
        assert got[text] == ipaddress.ip_address(text.split("%")[0]).is_global, text
    bad = spark.createDataFrame([("a", "8.8.8"), ("b", None), ("c", "8.8.8.8"), ("c", "10.0.0.1"), ("d", "01.2.3.4")], "key string, address string")
    errors = {r.key: r.address_error for r in L.public_addresses(bad, "key").collect()}
    assert errors["b"] == "file_url host did not resolve"
    assert all(errors[k] == "file_url host resolves to a private or reserved address" for k in "acd")


def test_media_types_and_caps(spark):
    rows = spark.createDataFrame(
        [
            (0, "Application/PDF; q", "u", b""), (1, "", "https://h/a.PNG?x", b""), (2, "application/octet-stream", "https://h/a", b"%PDF-1"),
            (3, None, "https://h/a", b"\x89PNG\r\n\x1a\n0"), (4, "", "https://h/a", b"RIFF1234WEBPx"), (5, "", "https://h/a", b"\xff\xd8\xff"),
            (6, "text/html", "u", b""), (7, "", "https://h/a", b""),
        ],
        "i int, content_type string, url string, content binary",
    )
    got = {r.i: r.mime_type for r in L.sniff_types(rows).collect()}
    assert [got[i] for i in range(8)] == [
        "application/pdf", "image/png", "application/pdf", "image/png", "image/webp", "image/jpeg", "text/html", "application/octet-stream",
    ]
    content = bytes(range(256))
    import base64

    url = spark.createDataFrame([("x.jpg", content)], "n string, c binary").select(U.data_url(F.col("c"), F.col("n")).alias("u")).first().u
    assert url == "data:image/jpeg;base64," + base64.b64encode(content).decode()


def test_definition_rules(spark):
    groups = spark.createDataFrame(
        [("ok", "Ok", "d"), ("Bad!", "B", "d"), ("empty", "E", " "), ("ok2", "x", "d"), ("ok2", "y", "d"), ("unknown", "U", "d")],
        "group_code string, group_name string, group_description string",
    )
    field = "group_code string, parent string, position int, field_key string, data_type string, field_name string, description string, nullable boolean, required boolean"
    fields = spark.createDataFrame(
        [
            ("ok", None, 1, "a", "string", None, None, True, True), ("ok", None, 2, "l", "array", "Lines", "", True, True),
            ("ok", "l", 1, "x", "number", None, "count", True, True), ("ok", "l", 2, "y", "date", "Day", None, True, True),
            ("Bad!", None, 1, "a", "array", None, None, True, True), ("Bad!", None, 2, "a", "string", None, None, True, False),
            ("ok2", None, 1, " ", "text", None, None, True, True), ("ok2", " ", 1, "c", "string", None, None, True, True),
        ],
        field,
    )
    variants = spark.createDataFrame([("ok", 1, "Straße", None), ("ok", 2, "STRASSE ", "d")], "group_code string, position int, name string, description string")
    found = {(r.group_code, r.problem) for r in G.schema_def_check(groups, fields, variants).collect()}
    assert found == {
        ("Bad!", "group_code must match pattern ^[a-z0-9_]+$"), ("empty", "group_name and group_description must not be empty"),
        ("Bad!", "child_schema is required when data_type is 'array'"), ("Bad!", "field_key values must be unique per group"),
        ("Bad!", "required=False is not supported with strict structured output"), ("ok2", "field_key must not be empty"),
        ("ok2", "data_type is not supported"), ("ok2", "child_schema is only allowed when data_type is 'array'"),
        ("empty", "fields must contain at least one field for non-unknown groups"), ("ok2", "group_code values must be unique"),
        ("ok", "variant name values must be unique per group"),
    }
    lines = [r.line for r in G.field_lines(fields.filter("group_code = 'ok'")).orderBy("position").collect()]
    assert lines == ["- a (string)", "- l (array of objects: - x (number) - Hint: count, - y (date) - Hint: Day) - Hint: Lines"]
    block = G.group_blocks(groups.filter("group_code = 'ok'"), variants).first().block
    assert block.endswith("variants/sample titles: Straße, STRASSE  (d)")


def claims(documents):
    """First document that shares pages with earlier ones, by sets of pages."""
    out = {}
    for file_id in {d[0] for d in documents}:
        seen = set()
        for _, doc_no, n, ranges in sorted(d for d in documents if d[0] == file_id):
            sound = all(1 <= a <= b <= n for a, b in ranges) and sum(b - a + 1 for a, b in ranges) == len({p for a, b in ranges for p in range(a, b + 1)})
            mine = {p for a, b in ranges for p in range(a, b + 1)} if sound else set()
            if mine & seen:
                out[file_id] = (doc_no, sorted(mine & seen))
                break
            seen |= mine
    return out


@pytest.mark.parametrize("rows_per_task", [None, "6"])
def test_overlaps_against_sets_of_pages(spark, rows_per_task):
    rng = random.Random(11)
    documents = []
    for file_id in range(60):
        count = 120 if file_id == 0 else rng.randrange(1, 12)
        free = 0
        for doc_no in range(count):
            ranges = []
            for _ in range(rng.randrange(0, 4)):
                a = free + 1 if rng.random() < 0.9 else rng.randrange(0, 40)
                b = a + rng.randrange(-1 if rng.random() < 0.05 else 0, 6)
                ranges.append([a, b])
                free = max(free, b)
            documents.append((file_id, doc_no + file_id % 2, 400, ranges))
    want = claims(documents)
    assert 10 < len(want) < 60
    frame = spark.createDataFrame(documents, "file_id long, doc_no int, n_pages int, page_ranges array<array<int>>")
    if rows_per_task:
        spark.conf.set("tallymark.rowsPerTask", rows_per_task)
    try:
        got = {r.file_id: (r.doc_no, r.pages) for r in S.page_overlap(frame).collect()}
    finally:
        spark.conf.unset("tallymark.rowsPerTask")
    assert got == want


def test_long_ranges_cost_nothing(spark):
    """Ranges of two billion pages, and a file of 50,000 documents side by side."""
    documents = [(1, 0, 2**31 - 1, [[1, 2**31 - 10]]), (1, 1, 2**31 - 1, [[2**31 - 9, 2**31 - 1]]), (2, 0, 2**31 - 1, [[5, 2**31 - 2]]), (2, 3, 10, [[1, 3]]), (2, 4, 10, [[4, 7]])]
    documents += [(3, i, 200_000, [[2 * i + 1, 2 * i + 1], [2 * i + 2, 2 * i + 2]]) for i in range(50_000)]
    frame = spark.createDataFrame(documents, "file_id long, doc_no int, n_pages int, page_ranges array<array<int>>")
    assert [tuple(r) for r in S.page_overlap(frame).collect()] == [(2, 4, [5, 6, 7])]
    assert S.page_overlap(frame.filter("file_id > 9")).count() == 0


def deep_fields(depth):
    """Rows of a group whose arrays are nested `depth` times, two members at each level."""
    rows, parent = [], None
    for level in range(depth):
        rows.append(("g", parent, 1, f"a{level}", "array", None, f"level {level}", True, True))
        rows.append(("g", parent, 2, f"s{level}", "string", "S", None, True, True))
        parent = f"a{level}" if parent is None else f"{parent}[].a{level}"
    rows.append(("g", parent, 1, "leaf", "number", None, None, False, True))
    return rows


def spoken(depth, level=0):
    if level == depth:
        return "- leaf (number)"
    return f"- a{level} (array of objects: {spoken(depth, level + 1)}) - Hint: level {level}, - s{level} (string) - Hint: S"


@pytest.mark.parametrize("depth", [1, 2, 5, 8])
def test_members_at_any_depth(spark, depth):
    field = "group_code string, parent string, position int, field_key string, data_type string, field_name string, description string, nullable boolean, required boolean"
    orphans = [("g", "nowhere", 1, "x", "string", None, None, True, True), ("g", "s0", 1, "y", "string", None, None, True, True)]
    fields = spark.createDataFrame(deep_fields(depth) + orphans, field)
    lines = {r.position: r.line for r in G.field_lines(fields).collect()}
    whole = spoken(depth)
    assert ", ".join(lines[k] for k in sorted(lines)) == whole
    paths = {r.path: r.json_type for r in G.schema_paths(fields).collect()}
    inner = "[].".join(f"a{i}" for i in range(depth)) + "[].leaf"
    assert paths[inner] == "number"
    groups = spark.createDataFrame([("g", "Group")], "group_code string, group_name string")
    described = G.group_descriptions(groups, fields).first().schema_description
    assert described == "\n".join(lines[k] for k in sorted(lines))


def test_extraction_at_depth_five(spark):
    def spec(level):
        if level == 5:
            return [{"field_key": "leaf", "data_type": "number", "nullable": False}]
        return [{"field_key": f"a{level}", "data_type": "array", "child_schema": spec(level + 1)}]

    def nested(level, leaf):
        return {"leaf": leaf} if level == 5 else {f"a{level}": [nested(level + 1, leaf)]}

    texts = [(1, "g", json.dumps(nested(0, 7))), (2, "g", json.dumps(nested(0, "x"))), (3, "g", json.dumps(nested(0, None)))]
    frame = spark.createDataFrame(texts, "id int, document_code string, payload_text string")
    got = {r.id: (r.extraction_error, r.extracted_data) for r in E.normalize_extracted(frame, {"g": spec(0)}).collect()}
    assert got[1] == (None, json.dumps(nested(0, 7), separators=(",", ":")))
    assert got[2][0] == "leaf must be a number" and got[3][0] == "leaf must not be null"


def test_a_long_list_of_groups_is_an_error(spark, monkeypatch):
    blocks = spark.createDataFrame([("b", "two"), ("a", "one")], "group_code string, block string")
    files = spark.createDataFrame([(1, 3)], "file_id long, n_pages int")
    assert "one\ntwo" in G.classify_prompts(files, G.group_list(blocks)).first().prompt
    monkeypatch.setattr(G, "MAX_LIST_CHARS", 5)
    with pytest.raises(Exception, match="too long"):
        G.classify_prompts(files, G.group_list(blocks)).collect()


def test_addresses_against_the_standard_library(spark):
    rng = random.Random(3)
    blocks = [ipaddress.ip_network(b) for b in (*K.RESERVED_IPV4, *K.REACHABLE_IPV4, *K.RESERVED_IPV6, *K.REACHABLE_IPV6)]
    texts = ["", "::", "::1", "1::", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8:9", ":1::", "1:::2", "1::2::3", "g::", "12345::", "::ffff:8.8.8.8",
             "::ffff:10.0.0.1", "64:ff9b::8.8.8.8", "::1.2.3", "::01.2.3.4", "fe80::1%eth0", "8.8.8.8%x", "1.2.3", "1.2.3.256", "2001:DB8::1", "1:2:3:4:5:6:1.2.3.4", " 8.8.8.8"]
    for block in blocks:
        for at in (int(block.network_address) - 1, int(block.network_address), int(block.broadcast_address), int(block.broadcast_address) + 1):
            kind = ipaddress.IPv4Address if block.version == 4 else ipaddress.IPv6Address
            if 0 <= at < 2 ** kind(0).max_prefixlen:
                address = kind(at)
                texts += [str(address), address.exploded] + ([f"::ffff:{address}"] if block.version == 4 else [])
    for _ in range(500):
        texts.append(str(ipaddress.IPv6Address(rng.getrandbits(128))))
        texts.append(str(ipaddress.IPv4Address(rng.getrandbits(32))))
        texts.append("".join(rng.choices(["1", "ab", ":", "::", ".", "0", "ffff"], k=rng.randint(1, 12))))

    def known(text):
        try:
            address = ipaddress.ip_address(text.split("%", 1)[0])
        except ValueError:
            return False
        # As documented: a mapped address is what the IPv4 address is (the library's own
        # answer differs for the shared space 100.64.0.0/10).
        return (getattr(address, "ipv4_mapped", None) or address).is_global

    frame = spark.createDataFrame([(t,) for t in texts] + [(None,)], "address string")
    got = {r.address: r.ok for r in frame.select("address", U.is_global(F.col("address")).alias("ok")).collect()}
    assert got.pop(None) is False
    assert {t: ok for t, ok in got.items() if ok != known(t)} == {}
    verdicts = L.public_addresses(frame.withColumn("k", F.lit(1)), "k")
    plan = verdicts._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("Scan") == 1
