import json

import pytest
from pyspark.sql import functions as F

from tallymark.functions import payload as P
from tallymark.operators import scoring as S
from tallymark.operators.groups import side_format
from tallymark.operators.labels import SIDE_TEMPLATES

FRONT = {
    "document_type": "cccd",
    "side": "front",
    "fields": {
        "id_number": "001", "full_name": "Nguyễn Văn A", "date_of_birth": None, "gender": "Nam",
        "nationality": "Việt Nam", "place_of_origin": None, "date_of_expiry": None, "place_of_residence": "Hà Nội",
    },
}


def changed(**fields):
    return {**FRONT, "fields": {**FRONT["fields"], **fields}}


def without(key):
    return {**FRONT, "fields": {k: v for k, v in FRONT["fields"].items() if k != key}}


def score(spark, predicted, expected=FRONT):
    text = predicted if isinstance(predicted, str) else json.dumps(predicted, ensure_ascii=False)
    row = spark.createDataFrame([("front", json.dumps(expected), text)], "side string, expected_text string, predicted_text string")
    return S.score_fields(row).first()


def test_one_field_differs(spark):
    result = score(spark, changed(full_name="B"))
    assert (result.matched_fields, result.total_fields, result.exact_match) == (7, 8, False)
    assert result.field_accuracy == pytest.approx(7 / 8)
    assert result.field_matches["fields.full_name"].predicted == "B"
    assert not result.field_matches["fields.full_name"].match


def test_case_and_blanks_do_not_count(spark):
    result = score(spark, changed(full_name="  NGUYỄN   văn a "))
    assert (result.matched_fields, result.exact_match) == (8, True)


def test_missing_key_matches_null_but_not_exactly(spark):
    result = score(spark, without("date_of_birth"))
    assert (result.matched_fields, result.exact_match) == (8, False)
    extra = score(spark, changed(more="x"))
    assert (extra.matched_fields, extra.exact_match) == (8, False)


def test_numbers_are_not_texts(spark):
    expected = changed(id_number="1")
    assert score(spark, changed(id_number=1), expected).matched_fields == 7
    assert score(spark, changed(id_number="1"), expected).matched_fields == 8


def test_nested_value_where_text_is_expected(spark):
    assert score(spark, changed(gender={"a": 1})).matched_fields == 7
    assert score(spark, {**FRONT, "fields": "none"}).matched_fields == 3


def errors(spark, payload, side="front"):
    row = spark.createDataFrame([(side, json.dumps(payload))], "side string, predicted_text string")
    return S.check_schema(row).first().schema_errors


def test_schema_errors(spark):
    assert errors(spark, FRONT) == []
    broken = without("place_of_residence")
    broken["fields"]["extra"] = "x"
    assert errors(spark, broken) == ["fields.extra is not allowed", "fields.place_of_residence is missing"]
    assert errors(spark, {**FRONT, "document_type": "CCCD"}) == ["document_type must equal 'cccd'"]
    assert errors(spark, changed(gender=1)) == ["fields.gender must be string or null"]
    assert errors(spark, {**FRONT, "fields": []}) == ["fields must be an object"]
    assert errors(spark, {"side": "front", "fields": None}) == ["document_type is missing", "fields must be an object"]
    back = {"document_type": "cccd", "side": "back", "fields": {"special_mark": None, "back_date": None, "mrz": {"dob": 1}}}
    found = errors(spark, back, "back")
    assert "fields.mrz.dob must be string or null" in found and "fields.mrz.country is missing" in found
    assert len(found) == 18


def parse(spark, text):
    return S.parse_replies(spark.createDataFrame([(text,)], "content string")).first()


def test_strict_parse(spark):
    assert parse(spark, '```json\n{"a": 1}\n```').predicted_text == '{"a": 1}'
    assert parse(spark, ' {"a": 1, "a": 2} ').predicted_text is not None
    assert parse(spark, "[1]").parse_error == "model response JSON must be an object"
    for text in ("sorry", "", '{"a": 1} trailing', '{"a": 1}}', '{"a":1},"b":2', "```\nx\n```"):
        assert parse(spark, text).parse_error == "model response is not valid JSON"
        assert parse(spark, text).predicted_text is None


def body(message):
    return json.dumps({"choices": [{"message": message}]}, ensure_ascii=False)


def test_reply_text(spark):
    cases = {
        body({"content": "x\ny"}): "x\ny",
        body({"content": [{"text": "a"}, {"type": "image"}, {"text": 1}, "s", {"text": "b"}]}): "a\nb",
        body({"content": None, "parsed": {"z": 1, "a": "é"}}): '{"z":1,"a":"é"}',
        body({"parsed": [1]}): "",
        '{"choices": []}': "",
        "{}": "",
    }
    for text, want in cases.items():
        assert S.reply_texts(spark.createDataFrame([(text,)], "body string")).first().content == want
    assert S.reply_texts(spark.createDataFrame([("nonsense",)], "body string")).first().content is None


def test_tolerant_parse(spark):
    cases = [
        (body({"content": 'Sure: {"a": "}\\"{"} and {"b": 1}'}), '{"a": "}\\"{"}', None),
        (body({"content": "```json\n{\"a\": 1}\n```"}), '{"a": 1}', None),
        (body({"content": '{ broken {"b": 1}'}), '{"b": 1}', None),
        (body({"content": "  ", "parsed": {"z": 1}}), '{"z":1}', None),
        (body({"content": "text", "parsed": {"z": 1}}), None, "model returned invalid JSON"),
        (body({"content": ""}), None, "model returned empty content"),
        (body({"content": "[1]"}), None, "model JSON response must be an object"),
        (body({"refusal": "no", "content": "{}"}), None, "model refused request: no"),
        ("<html>", None, "model returned invalid response JSON"),
    ]
    for text, payload, error in cases:
        row = S.parse_replies_tolerant(spark.createDataFrame([(text,)], "body string")).first()
        assert (row.payload_text, row.parse_error) == (payload, error), text


def balanced(text):
    """The rule by brute force: every start, every character."""
    for start in [i for i, c in enumerate(text) if c == "{"]:
        quoted = skip = False
        depth = 0
        for i in range(start, len(text)):
            c = text[i]
            if skip:
                skip = False
            elif quoted and c == "\\":
                skip = True
            elif c == '"':
                quoted = not quoted
            elif not quoted and c in "{}":
                depth += 1 if c == "{" else -1
                if depth == 0:
                    return text[start : i + 1]
    return text


def test_balanced_scan_against_brute_force():
    import itertools

    for size in range(7):
        for letters in itertools.product('{}"\\a', repeat=size):
            text = "".join(letters)
            assert P._balanced_object(text) == balanced(text), text


def truth(spark, n):
    data = [(i, "front", f"img{i}", json.dumps(FRONT)) for i in range(1, n + 1)]
    return spark.createDataFrame(data, "line_number bigint, side string, image string, expected_text string")


def test_details_and_summary(spark):
    replies = spark.createDataFrame(
        [
            ("front", 1, 200, body({"content": json.dumps(FRONT)}), 1.0),
            ("front", 2, 500, "boom", 9.0),
            ("front", 4, 200, body({"content": "[1]"}), 9.0),
            ("front", 5, 200, body({"content": json.dumps(changed(gender="Nữ"))}), 2.0),
        ],
        "side string, line_number bigint, http_status int, body string, latency_s double",
    )
    files = spark.createDataFrame([(f"img{i}", 1) for i in (1, 2, 3, 5)], "name string, length bigint")
    details = S.eval_details(truth(spark, 5), replies, files)
    got = {r.line_number: r for r in details.collect()}
    assert got[1].exact_match and got[1].schema_success and got[1].error is None
    assert got[2].error == "HTTP 500: boom" and not got[2].http_ok and got[2].total_fields == 8
    assert got[3].error == "no response recorded"
    assert got[4].error == "image not found: img4" and got[4].matched_fields == 0
    summary = {r.split: r for r in S.eval_summary(details).collect()}
    overall = summary["overall"]
    assert (overall.samples, overall.request_success, overall.matched_fields, overall.total_fields) == (5, 2, 15, 40)
    assert overall.avg_latency_s == 1.5 and overall.field_accuracy == pytest.approx(15 / 40)
    assert S.first_error(details).first().first_error == "img2: HTTP 500: boom"
    assert S.run_gate(details).first().run_ok


def test_nothing_served_gives_zeros(spark):
    details = S.eval_details(truth(spark, 2), spark.createDataFrame([], "side string, line_number bigint, http_status int, body string, latency_s double"))
    row = S.eval_summary(details).filter("split = 'overall'").first()
    assert (row.avg_latency_s, row.request_success_rate, row.total_fields) == (0.0, 0.0, 16)
    assert not S.run_gate(details).first().run_ok


def test_role_pick_from_arrays(spark):
    schema = "messages array<struct<role: string, content: string>>, images array<string>, side string, csv_row bigint"
    rows = spark.createDataFrame(
        [
            ([("system", "s"), ("user", "<image>\nReturn JSON."), ("assistant", "{}"), ("user", "again")], ["i"], "front", 1),
            ([("user", "u")], ["i"], "front", 2),
            ([("assistant", "[]"), ("user", "u")], ["i"], "front", 3),
            ([("assistant", "{}")], ["i"], "front", 4),
        ],
        schema,
    )
    got = {r.csv_row: r for r in S.pick_roles(rows).collect()}
    assert (got[1].prompt, got[1].truth, got[1].system_texts, got[1].record_error) == ("Return JSON.", "{}", ["s"], None)
    assert got[2].record_error == "record has no assistant ground-truth message"
    assert got[3].record_error == "assistant ground truth must be a JSON object"
    assert got[4].record_error == "record has no user message"
    request = {r.csv_row: r.request for r in S.request_batch(rows, "m").collect()}
    asked = json.loads(request[1])
    assert [m["role"] for m in asked["messages"]] == ["system", "user"] and asked["temperature"] == 0
    assert asked["messages"][1]["content"][0] == {"type": "text", "text": "Return JSON."}
    assert asked["response_format"]["json_schema"]["strict"] and request[2] is None


def test_formats_are_strict():
    for side in ("front", "back"):
        schema = side_format(SIDE_TEMPLATES[side])["json_schema"]["schema"]
        fields = schema["properties"]["fields"]
        assert schema["additionalProperties"] is False and fields["required"] == list(fields["properties"])
    assert "document_number" in fields["properties"]["mrz"]["required"]


def test_dotted_lookup(spark):
    row = P.add_value(spark.createDataFrame([('{"a": {"b": "x"}, "c": 1}',)], "t string"), F.col("t"), "v")
    got = row.select(P.text_at(F.col("v"), "a.b"), P.text_at(F.col("v"), "c.b"), P.text_at(F.col("v"), "z")).first()
    assert tuple(got) == ("x", None, None)
