import tracemalloc
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from tallymark.functions import text as X


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first().r


def test_clean_cell_trims_every_blank(spark):
    assert one(spark, "  a b \x1f", X.clean_cell) == "a b"
    assert one(spark, " \t　", X.clean_cell) is None
    assert one(spark, None, X.clean_cell) is None


def test_fold_key_keeps_blanks(spark):
    assert one(spark, " ＡＢＣ Straße ﬁ ", X.fold_key) == " abc strasse fi "


def test_fold_text_matches_python_on_mixed_batches(spark):
    values = ["  Ａ b\tC ", "plain  ASCII\x0btext\x1c", None, "ĐẶNG  THỊ", "", "İstanbul", "ﬀ"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    got = {r.i: r.r for r in rows.select("i", X.fold_text("v").alias("r")).collect()}
    for i, value in enumerate(values):
        want = None if value is None else " ".join(unicodedata.normalize("NFKC", value).split()).casefold()
        assert got[i] == want


def test_canonical_json_types(spark):
    def same(a, b):
        return one(spark, a, X.canonical_json) == one(spark, b, X.canonical_json)

    assert same('{"a": 1, "b": true}', '{"b": 1.0, "a": 1}')
    assert not same('{"a": "1"}', '{"a": 1}')
    assert same('{"a": "x", "a": " Ý  Z "}', '{"a": "ý z"}')
    assert not same('{"a": null}', "{}")
    assert one(spark, "{", X.canonical_json) is None


def test_slug_and_ids(spark):
    assert one(spark, "Qwen2.5:0.5b", X.slug) == "qwen2-5-0-5b"
    assert one(spark, "--Ä b__", X.slug) == "ä-b"
    assert one(spark, "***", lambda v: X.slug(v, "model")) == "model"
    assert one(spark, "llama.cpp", X.default_alias) == "local-llama-cpp"
    assert one(spark, "ollama", lambda v: X.binding_id(v, F.lit("A/B"))) == "chat-a-b"


def test_numbers_and_tags(spark):
    assert one(spark, "bad", X.number_or_zero) == 0.0
    assert one(spark, "2.5", X.number_or_zero) == 2.5
    assert one(spark, "NIGHTLY-x", X.is_floating_tag)
    assert not one(spark, "v1", X.is_floating_tag)
    assert one(spark, "x", lambda v: X.ratio(F.lit(1), F.lit(0))) == 0.0


def test_canonical_texts_are_not_held_as_a_batch():
    text = '{"b": "' + "Ab " * 300 + '", "a": 1.0}'
    values = pa.array([text, None, "no json"] * 4000)
    tracemalloc.start()
    got = X.canonical_texts(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.slice(0, 3).to_pylist() == [X._canonical(text), None, None] and got.slice(11_997).equals(got.slice(0, 3))
    assert len(got) == 12_000 and peak < 3 * X.HELD_CHARACTERS
    assert X.canonical_texts(values.slice(0, 0)).to_pylist() == []
