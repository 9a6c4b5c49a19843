import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tallymark.functions import exposition as X
from tallymark.operators import latency as L
from tallymark.operators import timeseries as T
from tallymark.sources import readers as R
from tallymark.streaming import counters as S
from tallymark.streaming import jobs as J
from tallymark.streaming import scrapes as P

BASE = 1_700_000_040  # a multiple of 60


def frame(spark, points, series="a"):
    rows = [(series, dt.datetime.fromtimestamp(BASE + s, dt.timezone.utc), float(v)) for s, v in points]
    return spark.createDataFrame(rows, "series string, ts timestamp, value double")


def naive_rate(points, end, reach):
    """Extrapolated rate of the samples in (end - reach, end], one by one."""
    inside = [(s, v) for s, v in points if end - reach < s <= end]
    if len(inside) < 2:
        return None
    (first, v0), (last, v1) = inside[0], inside[-1]
    increase = v1 - v0 + sum(a for (_, a), (_, b) in zip(inside, inside[1:]) if b < a)
    span = last - first
    gap = span / (len(inside) - 1)
    start, stop = first - (end - reach), end - last
    start = gap / 2 if start >= gap * 1.1 else start
    stop = gap / 2 if stop >= gap * 1.1 else stop
    if increase > 0 and v0 >= 0:
        start = min(start, span * v0 / increase)
    return increase * (span + start + stop) / span / reach


@pytest.mark.parametrize("step,reach", [(15, 60), (60, 300), (40, 60), (300, 60)])
def test_rate_against_brute_force(spark, step, reach):
    rng = random.Random(step)
    points, value, now = [], 0.0, 0.0
    for _ in range(300):
        now += rng.choice([5, 15, 15, 15, 90, 400]) + rng.random()
        value = 0.0 if rng.random() < 0.08 else value + rng.random() * 10
        points.append((round(now, 3), value))
    got = {r.step_s - BASE: r.rate for r in T.counter_rate(frame(spark, points), ["series"], step, reach).collect()}
    want = {}
    first = -(-(BASE + points[0][0]) // step) * step - BASE
    for end in range(int(first), int(points[-1][0]) + reach + step, step):
        rate = naive_rate(points, end, reach)
        if rate is not None:
            want[end] = rate
    assert got.keys() == want.keys()
    for end, rate in want.items():
        assert got[end] == pytest.approx(rate, rel=1e-9, abs=1e-12)


def test_window_is_open_on_the_left(spark):
    windows = {r.step_s - BASE: r.samples for r in T.counter_windows(frame(spark, [(0, 1), (60, 2), (120, 3)]), ["series"], 60, 60).collect()}
    assert windows == {0: 1, 60: 1, 120: 1}


def test_instant_values_and_lookback(spark):
    values = T.instant_values(frame(spark, [(0, 1), (10, 2), (200, 3)]), ["series"], 60, 120)
    got = {r.step_s - BASE: r.value for r in values.collect()}
    assert got == {0: 1.0, 60: 2.0, 120: 2.0, 240: 3.0, 300: 3.0}


def quantile(spark, counts, q=0.95):
    rows = [("a", 0, le, float(c)) for le, c in counts]
    df = spark.createDataFrame(rows, "series string, step_s bigint, le string, rate double")
    return T.histogram_quantile(df, ["series"], q).first().quantile


def test_histogram_quantile(spark):
    assert quantile(spark, [("1", 10), ("2", 20), ("+Inf", 20)], 0.75) == pytest.approx(1.5)
    assert quantile(spark, [("1", 10), ("2", 20), ("+Inf", 20)], 0.25) == pytest.approx(0.5)
    assert quantile(spark, [("1", 1), ("2", 2), ("+Inf", 100)]) == 2.0
    assert quantile(spark, [("-1", 10), ("+Inf", 10)], 0.5) == -1.0
    assert quantile(spark, [("1", 10), ("2", 9), ("+Inf", 20)], 0.5) == 1.0
    for broken in ([("1", 0), ("+Inf", 0)], [("+Inf", 5)], [("1", 5), ("2", 6)]):
        assert quantile(spark, broken) is None


def test_sum_takes_the_first_metric_present(spark):
    rows = [("b", 0, 2.0), ("c", 0, 9.0), ("a", 60, 1.0), ("b", 60, 5.0), ("a", 60, 3.0), ("c", 120, 4.0)]
    df = spark.createDataFrame(rows, "metric string, step_s bigint, value double")
    got = {r.step_s: r.value for r in T.sum_with_fallback(df, ["a", "b", "c"]).collect()}
    assert got == {0: 2.0, 60: 4.0, 120: 4.0}


def test_scrape_grid_fills_gaps(spark):
    points = frame(spark, [(0, 1), (1, 1), (46, 1)])
    got = [(r.step_s - BASE, r.up, r.scraped) for r in T.scrape_grid(points, "series").orderBy("step_s").collect()]
    assert got == [(0, 1, 2), (15, 0, 0), (30, 0, 0), (45, 1, 1)]
    longer = T.scrape_grid(points, "series", 3600, BASE - 200_000, BASE + 200_000)
    assert longer.count() == (BASE + 200_000) // 3600 - (BASE - 200_000) // 3600 + 1
    assert longer.agg(F.countDistinct("step_s")).first()[0] == longer.count()


def test_exposition_round_trip(spark):
    labels = {"b": 'say "hi"\\n', "a": "line\nbreak", "none": "", "c": "x,y={}"}
    row = spark.createDataFrame([(labels, "1.5")], "labels map<string,string>, value string")
    line = row.select(X.render_line(F.lit("vllm:e2e_total"), F.col("labels"), F.col("value")).alias("line"))
    text = line.first().line
    assert text == 'vllm:e2e_total{a="line\\nbreak",b="say \\"hi\\"\\\\n",c="x,y={}"} 1.5'
    parsed = T.parse_scrape(line).first()
    assert parsed.metric == "vllm:e2e_total" and parsed.value == 1.5
    assert parsed.labels == {k: v for k, v in labels.items() if v}
    odd = spark.createDataFrame([("# TYPE a gauge",), ("",), ("a",), ("a{b=1} 2",), ("a +Inf 17",), ('a { b = "1" , } 4',), ("a{} 3",), ("a NaN",)], "line string")
    got = [(r.metric, r.value, r.time_ms) for r in T.parse_scrape(odd).collect()]
    assert got[:3] == [("a", math.inf, 17), ("a", 4.0, None), ("a", 3.0, None)]
    assert math.isnan(got[3][1]) and len(got) == 4
    twice = spark.createDataFrame([('bad{a="1",a="2"} 3',), ("x y z",), ("# c",), (" ",), ("ok 1",)], "line string")
    assert [r.metric for r in T.parse_scrape(twice).collect()] == ["ok"]
    assert {(r.line, r.error) for r in T.scrape_rejects(twice).collect()} == {
        ('bad{a="1",a="2"} 3', "a label name is repeated"),
        ("x y z", "line is no sample"),
    }
    huge = spark.createDataFrame([('a{b="' + "x\\\\" * 200_000 + '"} 1',)], "line string")
    assert len(T.parse_scrape(huge).first().labels["b"]) == 400_000


def test_inventory_lines(spark):
    models = spark.createDataFrame(
        [("h", False, {"model": "m", "family": ""}, None, None), ("h", True, {"model": "m"}, "5", "bad"), ("down", True, {"model": "x"}, "1", "1")],
        "source string, loaded boolean, labels map<string,string>, size string, size_vram string",
    )
    sources = spark.createDataFrame([("h", True, 0.25), ("down", False, 1.0)], "source string, up boolean, scrape_seconds double")
    lines = {}
    for r in T.render_inventory(models, sources).collect():
        lines.setdefault(r.source, set()).add(r.line)
    assert lines["h"] == {
        "ollama_up 1", "ollama_models_total 1", "ollama_loaded_models_total 1", "ollama_scrape_duration_seconds 0.250000",
        'ollama_model_info{model="m"} 1', 'ollama_loaded_model_info{model="m"} 1',
        'ollama_loaded_model_size_bytes{model="m"} 5.0', 'ollama_loaded_model_size_vram_bytes{model="m"} 0.0',
    }
    assert lines["down"] == {"ollama_up 0", "ollama_models_total 0", "ollama_loaded_models_total 0", "ollama_scrape_duration_seconds 1.000000"}
    text = T.exposition_text(T.render_inventory(models, sources), sources).orderBy("source", "line_number").collect()
    mine = [r.line for r in text if r.source == "h"]
    assert mine[0] == "# HELP ollama_up Whether the Ollama API is reachable." and mine[1:3] == ["# TYPE ollama_up gauge", "ollama_up 1"]
    assert sum(line.startswith("#") for line in mine) == 16


def test_floats_are_spelled_as_in_expositions(spark):
    values = [5.0, 12345678.5, 0.00001, 1e17, 1e16, 123456789012345680.0, 0.0001, 1.5e-7, 0.25, -2e20]
    frame = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    assert [r[0] for r in frame.select(T._float_text(F.col("v"))).collect()] == [repr(v) for v in values]


def test_latest_value_has_a_look_back(spark):
    samples = frame(spark, [(0, 1.0)], "dead").unionByName(frame(spark, [(500, 2.0)], "live"))
    got = T.latest_values(samples, ["series"], BASE + 500, 300).collect()
    assert [(r.series, r.value) for r in got] == [("live", 2.0)]
    values = spark.createDataFrame([("litellm_requests_metric_total", 0, 4.0)], "metric string, step_s bigint, value double")
    assert [tuple(r) for r in T.dashboard_sums(values).collect()] == [("requests", 0, 4.0)]


def test_run_summary_counts_only_200(spark):
    df = spark.createDataFrame([("m", 200, 1.0), ("m", 201, 9.0), ("m", 200, 2.0), ("n", 500, 3.0)], "model string, status_code int, latency_s double")
    got = {r.model: tuple(r)[1:] for r in L.run_summary(df, ["model"]).collect()}
    assert got == {"m": (3, 2, 1.5, 1.0, 2.0), "n": (1, 0, 0.0, 0.0, 0.0)}


def counter_points(seed=7, n=240):
    rng = random.Random(seed)
    points, value = [], 0.0
    for i in range(n):
        value = 0.0 if rng.random() < 0.1 else value + rng.random()
        points.append((i * 15 + rng.random(), value))
    return points


def test_stateful_rate_equals_batch_over_resumed_runs(spark, tmp_path):
    """Three runs over the same folders; resets lie inside slices, between slices and
    between runs; rows arrive shuffled inside a run, some twice and some too late."""
    series = {"a": counter_points(7), "b": counter_points(8)}
    whole = None
    for name, points in series.items():
        one = frame(spark, points, name)
        whole = one if whole is None else whole.unionByName(one)
    whole = whole.cache()
    where, beats = str(tmp_path / "in"), str(tmp_path / "beats")
    spark.createDataFrame([], whole.schema).write.parquet(where)
    spark.createDataFrame([], "ts timestamp").write.parquet(beats)

    def run():
        stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 2).parquet(where)
        beat = spark.readStream.schema("ts timestamp").parquet(beats)
        return S.run_totals(S.with_beats(stream, beat), ["series"], late="30 seconds", out=str(tmp_path / "out"), state=str(tmp_path / "state"))

    edges = [0, 1203, 2407, 10_000]
    for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        at = F.unix_seconds("ts") - BASE
        part = whole.filter((at >= low) & (at < high)).orderBy(F.rand(k)).coalesce(1)
        part.unionByName(part.limit(20)).coalesce(1).write.mode("append").parquet(where)
        if k == 2:
            # Long closed: dropped and counted, not taken for a reset.
            frame(spark, [(100.5, 99.0), (101.5, 1.0)], "a").coalesce(1).write.mode("append").parquet(where)
            spark.createDataFrame([(dt.datetime.fromtimestamp(BASE + 9000, dt.timezone.utc),)], "ts timestamp").write.mode("append").parquet(beats)
        ran = run()
        # A value and a timer per series, however many samples there were.
        assert ran.series_rows <= 2 * len(series)
    assert ran.late_rows >= 1 and ran.slice_rows == 0
    totals = spark.read.schema(f"series string, {S.SLICE_COLUMNS}").parquet(ran.path)
    for step, reach in ((60, 60), (60, 300)):
        got = {(r.series, r.step_s): r.rate for r in S.total_rates(totals, ["series"], step, reach).collect()}
        want = {(r.series, r.step_s): r.rate for r in T.counter_rate(whole, ["series"], step, reach).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    falling = totals.filter("last_total < first_total").count()
    assert falling == 0


def test_silent_series_expire(spark, tmp_path):
    """A series that is silent for longer than its time starts anew; others stay."""
    where = str(tmp_path / "in")
    rows = frame(spark, [(5, 10.0), (65, 20.0)], "quiet").unionByName(frame(spark, [(5, 1.0)], "busy"))
    rows.coalesce(1).write.parquet(where)

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(where)
        return S.run_totals(stream, ["series"], late="1 second", expire_s=600, out=str(tmp_path / "out"), state=str(tmp_path / "state"))

    run()
    frame(spark, [(500, 2.0), (3000, 3.0)], "busy").coalesce(1).write.mode("append").parquet(where)
    run()
    frame(spark, [(3100, 5.0), (3200, 6.0)], "quiet").unionByName(frame(spark, [(3300, 1.0), (4000, 0.0)], "busy")).coalesce(1).write.mode("append").parquet(where)
    ran = run()
    totals = spark.read.schema(f"series string, {S.SLICE_COLUMNS}").parquet(ran.path)
    got = {(r.series, r.end_s - BASE): (r.first_total, r.last_total) for r in totals.collect()}
    # The quiet counter lost 20 to a reset, but its state had gone by then.
    assert got["quiet", 3120] == (5.0, 5.0) and got["quiet", 120] == (20.0, 20.0)
    assert got["busy", 3300] == (4.0, 4.0)


def test_streams_resume_over_a_folder_table(spark, tmp_path):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

    def add(rows):
        data = [(i, dt.datetime(2024, 1, day), i, kind, value, None) for i, day, kind, value in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))

    def run():
        events = R.table_stream(spark, str(tmp_path), "events").select(
            F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model"), F.lit(200).alias("status_code"), F.col("value").alias("latency_s")
        )
        ran = J.run_updates(J.latency_stream(events, late="1 second"), "latency", str(tmp_path / "out"), str(tmp_path / "state"))
        last = J.last_versions(spark, ran.path, ["window_start", "model"])
        return {(r.window_start.day, r.model): r.num_requests for r in last.collect()}, ran.late_rows

    (tmp_path / "events.parquet").mkdir()
    assert run() == ({}, 0)
    add([(1, 1, "a", 1.0), (2, 1, "a", 2.0)])
    add([(3, 1, "b", 2.0), (4, 9, "a", 2.0)])
    assert run() == ({(1, "a"): 2, (1, "b"): 1, (9, "a"): 1}, 0)
    add([(5, 9, "a", 3.0), (6, 2, "a", 1.0)])
    assert run() == ({(1, "a"): 2, (1, "b"): 1, (9, "a"): 2}, 1)


def test_due_scrapes_resume_and_tell_what_is_missing(spark, tmp_path):
    """Offsets are due times: a target that landed nothing is a row, a resumed run goes on."""
    root = tmp_path / "landed"

    def land(target, due, lines, took=None):
        folder = root / f"target={target}" / (f"due={due}" + (f"-{took}" if took else ""))
        folder.mkdir(parents=True)
        (folder / "part-0.txt").write_text("".join(line + "\n" for line in lines))
        (folder / "_SUCCESS").write_text("")

    def run():
        stream = P.due_scrapes(spark, str(root), ["a", "b"], 15, 1000)
        out = J.run_append(stream, "due", str(tmp_path / "out"), str(tmp_path / "state"))
        return sorted((r.due_s, r.target, r.up, r.took_s, r.lines) for r in spark.read.schema(stream.schema).parquet(out).collect())

    land("a", 1000, ["x 1", "é 2"], 0.5)
    land("b", 1015, [])
    first = run()
    assert first == [(1000, "a", 1, 0.5, ["x 1", "é 2"]), (1000, "b", 0, None, []), (1015, "a", 0, None, []), (1015, "b", 1, None, [])]
    assert run() == first
    land("a", 1060, ["y 3"])
    assert run()[4:] == [(t, n, int((t, n) == (1060, "a")), None, ["y 3"] if (t, n) == (1060, "a") else []) for t in (1030, 1045, 1060) for n in "ab"]


def test_instant_values_of_a_crowded_series(spark):
    rng = random.Random(6)
    points = sorted((rng.random() * 900, float(i)) for i in range(3000))
    got = {r.step_s - BASE: r.value for r in T.instant_values(frame(spark, points), ["series"], 60, 150).collect()}
    for end in range(0, 1100, 60):
        seen = [(round(t, 6), v) for t, v in points if end - 150 < round(t, 6) <= end]
        assert got.get(end) == (max(seen)[1] if seen else None)
