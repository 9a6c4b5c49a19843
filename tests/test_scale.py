"""Skew paths with tiny limits against brute force, and the shape of the plans."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tallymark.operators import skew as K
from tallymark.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def tiny_tasks(spark):
    spark.conf.set("tallymark.rowsPerTask", "7")
    yield
    spark.conf.unset("tallymark.rowsPerTask")


def test_lookup_join_with_a_hot_and_a_missing_key(spark, tiny_tasks):
    rng = random.Random(1)
    keys = ["hot"] * 300 + [None] * 100 + [f"k{rng.randrange(80)}" for _ in range(300)]
    left = spark.createDataFrame(list(enumerate(keys)), "id bigint, k string")
    right = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 80, 2)]], "k string, v int")
    want = sorted((r.id, r.k, r.v) for r in left.join(right, "k", "left").collect())
    got = sorted((r.id, r.k, r.v) for r in K.lookup_join(left, right, ["k"], ["id"]).collect())
    assert repr(got) == repr(want)
    inner = K.lookup_join(left, right, ["k"], ["id"], "inner")
    assert inner.count() == left.join(right, "k").count()
    hot = {r.k: r._parts for r in K.hot_keys(left, ["k"]).collect()}
    assert hot["hot"] == 43 and hot[None] == 15


def test_running_sum_over_cut_slices(spark, tiny_tasks):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = []
    for i in range(600):
        # Half of the rows of one key fall into a few minutes.
        seconds = rng.random() * (300 if rng.random() < 0.5 else 90_000)
        rows.append((i, "hot" if rng.random() < 0.7 else "cold", start + dt.timedelta(seconds=seconds), rng.randrange(9)))
    rows += [(1000 + i, "hot", start + dt.timedelta(seconds=5), 1) for i in range(20)]  # one instant
    df = spark.createDataFrame(rows, "id bigint, k string, ts timestamp, v bigint")
    got = {r.id: (r.s, r.n) for r in K.running_sum(df, ["k"], ["ts", "id"], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    totals = {}
    for i, k, ts, v in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        s, n = totals.get(k, (0, 0))
        totals[k] = (s + v, n + 1)
        assert got[i] == totals[k]
    sliced = K.with_time_slices(df, ["k"], "ts", 3600)
    assert sliced.groupBy("k", "_slice").count().agg(F.max("count")).first()[0] < 120


def test_first_n(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(50)], "id int, k string")
    got = K.first_n(df, ["k"], ["id"], 2).orderBy("k", "id").collect()
    assert [(r.k, r.id) for r in got] == [("a", 1), ("a", 2), ("b", 0), ("b", 3)]
    assert K.first_n(df, ["k"], ["id"], 0).count() == 0
    assert "WindowGroupLimit" in K.first_n(df, ["k"], ["id"], 2)._jdf.queryExecution().executedPlan().toString()


SKEWED = ["resolve_names", "allowed_groups", "ordered_pages", "page_overlap", "resolve_target", "catalog_check", "counter_rate", "request_sequence", "prompt_render"]


@pytest.mark.parametrize("name", SKEWED)
def test_results_do_not_depend_on_the_task_size(spark, name):
    query = registry.QUERIES[name]
    plain = sorted(map(str, query(spark, FOLDER).collect()))
    spark.conf.set("tallymark.rowsPerTask", "5")
    try:
        assert sorted(map(str, query(spark, FOLDER).collect())) == plain
    finally:
        spark.conf.unset("tallymark.rowsPerTask")


BATCH = [n for n in registry.QUERIES if not n.startswith("stream_") and n not in ("csv_scan", "jsonl_scan", "chat_jsonl", "catalog_assemble", "run_report", "latency_series")]


def plan(spark, name):
    return registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_nested_loops_or_products(spark, name):
    text = plan(spark, name)
    assert not re.search(r"CartesianProduct|NestedLoopJoin", text)
    # Row-at-a-time Python never appears.
    assert "BatchEvalPython" not in text


def test_scans_are_pruned_and_filters_pushed(spark):
    text = plan(spark, "metric_or")
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text
    assert "In(event_type" in text
    assert "ReadSchema: struct<p_brand:string,p_type:string>" in plan(spark, "schema_paths")
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan(spark, "unused_items")


def test_per_row_operators_do_not_shuffle(spark):
    for name in ("clean_cells", "classify_rows", "schema_errors", "field_score", "extract_normalize", "response_parse_tolerant", "path_get", "scrape_parse", "mime_sniff", "url_screen", "norm_text"):
        assert "Exchange" not in plan(spark, name), name
