"""Queries of latency reports, metric samples and streams, with their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark import constants as K
from tallymark.operators import latency as L
from tallymark.operators import timeseries as T
from tallymark.plans.fixtures import BUCKETS, bucket_counters, counters, load, timed, with_clause
from tallymark.session import new_shared_path
from tallymark.sources import readers as R
from tallymark.sources import writers as W
from tallymark.streaming import counters as S
from tallymark.streaming import jobs as J
from tallymark.streaming import scrapes as P

HOUR, REACH = 3600, 6 * 3600
SERIES = ["metric", "instance"]
PRIORITY = ("purchase", "signup", "view")


def _bench(spark: SparkSession, folder: str) -> DataFrame:
    return timed(load(spark, folder, "f_bench"))


def _gauges(spark: SparkSession, folder: str) -> DataFrame:
    return timed(load(spark, folder, "f_metrics")).select("metric", "instance", "ts", "value")


def bench_summary(spark: SparkSession, folder: str) -> DataFrame:
    return L.run_summary(_bench(spark, folder), ["model", "run_day"]).withColumn("run_day", F.col("run_day").cast("string"))


def request_sequence(spark: SparkSession, folder: str) -> DataFrame:
    numbered = L.number_requests(_bench(spark, folder), ["model", "run_day"], "ts", "event_id")
    return numbered.select("event_id", "model", "request_id")


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    """One report per model and day, written as JSON and scanned back."""
    summary = L.run_summary(_bench(spark, folder), ["model", "run_day"])
    name = F.concat(F.lit("benchmark_"), "model", F.lit("_"), F.date_format("run_day", "yyyyMMdd"), F.lit(".json"))
    stamp = F.concat(F.col("run_day").cast("string"), F.lit("T00:00:00"))
    out = new_shared_path(spark, "reports")
    text = F.to_json(F.struct(stamp.alias("timestamp"), "model", *J.LATENCY_COLUMNS), {"pretty": "true"})
    # A report is a folder here, since Spark names the files itself.
    summary.select(name.alias("report"), text.alias("value")).repartition("report").write.partitionBy("report").text(out)
    folder_name = F.regexp_extract("_metadata.file_path", "report=([^/]+)/", 1)
    return R.read_run_reports(spark, f"{out}/report=benchmark_*.json", "part-*", folder_name)


def run_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report over all runs, written as CSV and read back."""
    report = L.run_report(_reports(spark, folder))
    out = new_shared_path(spark, "report")
    W.write_csv(report, out)
    return spark.read.schema(report.schema).option("header", True).csv(out)


def latency_series(spark: SparkSession, folder: str) -> DataFrame:
    return L.latency_series(_reports(spark, folder))


def distinct_models(spark: SparkSession, folder: str) -> DataFrame:
    return L.distinct_models(_bench(spark, folder))


def latest_gauge(spark: SparkSession, folder: str) -> DataFrame:
    gauges = _gauges(spark, folder)
    now = gauges.agg(F.max("ts").alias("ts")).select(F.unix_seconds(F.col("ts").cast("timestamp"))).first()[0]
    latest = T.latest_values(gauges, SERIES, None if now is None else now + 1, 6 * HOUR)
    return latest.select(*SERIES, "value", F.unix_micros("ts").alias("ts_us"))


def instant_gauge(spark: SparkSession, folder: str) -> DataFrame:
    return T.instant_values(_gauges(spark, folder), SERIES, HOUR, 2 * HOUR)


def gauge_mib(spark: SparkSession, folder: str) -> DataFrame:
    files = load(spark, folder, "f_files").groupBy("dir").agg(F.sum("length").alias("bytes"))
    return files.select("dir", F.round(T.bytes_to_mib(F.col("bytes")), 6).alias("mib"))


def counter_rate(spark: SparkSession, folder: str) -> DataFrame:
    rated = T.counter_rate(counters(spark, folder), SERIES, HOUR, REACH)
    return rated.withColumn("rate", F.round("rate", 6))


def hist_quantile(spark: SparkSession, folder: str) -> DataFrame:
    rates = T.counter_rate(bucket_counters(spark, folder), [*SERIES, "le"], HOUR, REACH)
    return T.histogram_quantile(rates, SERIES, 0.95).withColumn("quantile", F.round("quantile", 4))


def metric_or(spark: SparkSession, folder: str) -> DataFrame:
    values = T.instant_values(_gauges(spark, folder), SERIES, HOUR, HOUR)
    return T.sum_with_fallback(values, PRIORITY).withColumn("value", F.round("value", 4))


#: Event types as the counters that the dashboard sums; in each panel some names have gaps.
_PANEL_METRICS = {
    "purchase": "litellm_proxy_total_requests_metric_total",
    "view": "litellm_requests_metric_total",
    "error": "litellm_proxy_failed_requests_metric_total",
    "click": "litellm_in_flight_requests_metric",
    "signup": "litellm_in_flight_requests",
}


def dashboard_sums(spark: SparkSession, folder: str) -> DataFrame:
    """All sums of the dashboard over hourly instant values."""
    names = F.create_map(*[F.lit(x) for pair in _PANEL_METRICS.items() for x in pair])
    gauges = _gauges(spark, folder).withColumn("metric", names[F.col("metric")]).filter("metric is not null")
    values = T.instant_values(gauges, SERIES, HOUR, HOUR)
    return T.dashboard_sums(values).withColumn("value", F.round("value", 4))


def scrape_grid(spark: SparkSession, folder: str) -> DataFrame:
    gauges = _gauges(spark, folder)
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    first, last = gauges.agg(F.min(seconds), F.max(seconds)).first()
    jobs = gauges.select("metric").unionByName(spark.createDataFrame([("silent",)], "metric string"))
    grid = T.scrape_grid(gauges, "metric", 900, first, last, jobs)
    return grid.select("metric", "step_s", F.col("up").cast("bigint").alias("up"), "scraped")


def scrape_parse(spark: SparkSession, folder: str) -> DataFrame:
    parsed = T.parse_scrape(load(spark, folder, "f_lines"))
    return parsed.select("event_id", "metric", T.series_key(F.col("labels")).alias("series"), "value", "time_ms")


def expose_render(spark: SparkSession, folder: str) -> DataFrame:
    models = load(spark, folder, "f_models")
    labels = F.create_map(F.lit("model"), F.col("model"), F.lit("family"), F.col("family"), F.lit("processor"), F.lit(None).cast("string"))
    typed = models.select("source", "loaded", labels.alias("labels"), "size", F.lit("7").alias("size_vram"))
    sources = load(spark, folder, "f_sources").withColumn("scrape_seconds", F.col("scrape_seconds").cast("double"))
    return T.render_inventory(typed, sources)


def expose_text(spark: SparkSession, folder: str) -> DataFrame:
    sources = load(spark, folder, "f_sources")
    return T.exposition_text(expose_render(spark, folder), sources)


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    stream = R.table_stream(spark, folder, "events")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_summary(spark: SparkSession, folder: str) -> DataFrame:
    requests = _event_stream(spark, folder).select(
        "ts",
        F.concat(F.lit("m"), (F.col("user_id") % 10).cast("string")).alias("model"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        (F.col("value") / 97).alias("latency_s"),
    )
    out = J.run_updates(J.latency_stream(requests), "latency").path
    last = J.last_versions(spark, out, ["window_start", "model"])
    return last.select(F.date_format("window_start", "yyyy-MM-dd").alias("run_day"), "model", *J.LATENCY_COLUMNS)


def stream_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Rate over hourly windows of a counter that grows with the time of day."""
    samples = _event_stream(spark, folder).select(
        F.col("event_type").alias("metric"),
        F.concat(F.lit("i"), (F.col("user_id") % 3).cast("string")).alias("instance"),
        "ts",
        _day_counter(F.col("ts")).alias("value"),
    )
    # A beat two days after the last sample closes all slices.
    beat = R.table(spark, folder, "events").agg(F.max("ts").cast("timestamp") + F.expr("interval 2 days")).toDF("ts")
    path = new_shared_path(spark, "beats")
    beat.filter("ts is not null").write.parquet(path)
    beats = spark.readStream.schema("ts timestamp").parquet(path)
    totals = S.run_totals(S.with_beats(samples, beats), SERIES).path
    read = spark.read.schema(f"metric string, instance string, {S.SLICE_COLUMNS}").parquet(totals)
    return S.total_rates(read, SERIES, REACH, REACH).withColumn("rate", F.round("rate", 6))


def _day_counter(ts):
    """Milliseconds since midnight: a counter that starts again every day."""
    return (F.floor(F.unix_micros(ts) / 1000) % 86_400_000).cast("double")


def stream_scrape(spark: SparkSession, folder: str) -> DataFrame:
    """Scrape lines landed as files and parsed as a stream."""
    landed = new_shared_path(spark, "landed")
    W.write_lines(load(spark, folder, "f_lines"), landed)
    parsed = J.scrape_stream(spark, landed).select("metric", T.series_key(F.col("labels")).alias("series"), "value")
    return spark.read.parquet(J.run_append(parsed, "samples"))


DUE = 6 * 3600


def stream_due(spark: SparkSession, folder: str) -> DataFrame:
    """Samples landed per target and due time, read as a stream that has a row for every
    due time, and the number of samples that each scrape brought."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    lines = load(spark, folder, "f_lines").select("event_id", "line")
    events = R.table(spark, folder, "events").select(
        "event_id", (F.col("user_id") % 7).alias("k"), (F.floor(seconds / DUE) * DUE).alias("due")
    )
    # One scrape in five is missing.
    there = lines.join(events, "event_id").filter((F.col("due") / DUE + F.col("k")).cast("long") % 5 != 0)
    landed = there.withColumn("target", F.concat(F.lit("i"), F.col("k").cast("string"))).select("target", "due", "line")
    start, named = landed.agg(F.min("due"), F.array_sort(F.collect_set("target"))).first()
    if start is None:
        return spark.createDataFrame([], "target string, due_s bigint, up int, samples bigint")
    path = new_shared_path(spark, "landed")
    W.write_lines(landed.withColumn("due", F.concat(F.col("due").cast("string"), F.lit("-0.25"))).repartition("target", "due"), path, by=["target", "due"])
    scrapes = P.due_scrapes(spark, path, [*named, "silent"], DUE, start)
    kept = scrapes.select("target", "due_s", "up", F.size(F.filter("lines", lambda x: ~x.startswith("#"))).cast("long").alias("samples"))
    return spark.read.schema(kept.schema).parquet(J.run_append(kept, "scrapes"))


QUERIES = {
    "bench_summary": bench_summary,
    "request_sequence": request_sequence,
    "run_report": run_report,
    "latency_series": latency_series,
    "distinct_models": distinct_models,
    "latest_gauge": latest_gauge,
    "instant_gauge": instant_gauge,
    "gauge_mib": gauge_mib,
    "counter_rate": counter_rate,
    "hist_quantile": hist_quantile,
    "metric_or": metric_or,
    "dashboard_sums": dashboard_sums,
    "scrape_grid": scrape_grid,
    "scrape_parse": scrape_parse,
    "expose_render": expose_render,
    "expose_text": expose_text,
    "stream_summary": stream_summary,
    "stream_rate": stream_rate,
    "stream_scrape": stream_scrape,
    "stream_due": stream_due,
}

# --- checks ---------------------------------------------------------------------------

_MEASURES = """count(*) AS num_requests, count(*) FILTER (WHERE status_code = 200) AS successful,
 coalesce(round(avg(latency_s) FILTER (WHERE status_code = 200), 4), 0) AS avg_latency_s,
 coalesce(round(min(latency_s) FILTER (WHERE status_code = 200), 4), 0) AS min_latency_s,
 coalesce(round(max(latency_s) FILTER (WHERE status_code = 200), 4), 0) AS max_latency_s"""
_RUNS = f"{with_clause('f_bench')}, runs AS (SELECT model, run_day, cast(run_day AS varchar) || 'T00:00:00' AS timestamp, 'benchmark_' || model || '_' || strftime(run_day, '%Y%m%d') || '.json' AS file_name, {_MEASURES} FROM f_bench GROUP BY model, run_day)"


def _grid(source: str, reach: int) -> str:
    """Samples at every hourly point of the windows that hold them."""
    return (
        f"SELECT s.*, epoch_us(ts) AS us, g.step_s FROM {source} s, "
        f"LATERAL (SELECT unnest(generate_series(cast(ceil(epoch_us(s.ts) / 3600000000.0) AS bigint) * 3600, "
        f"cast(ceil((epoch_us(s.ts) + {reach}000000) / 3600000000.0) AS bigint) * 3600 - 3600, 3600)) AS step_s) g"
    )


def _rate_ctes(source: str, keys: str) -> str:
    """Reset-aware, extrapolated rate by window functions over the expanded samples."""
    return f"""grid AS ({_grid(source, REACH)}),
steps AS (SELECT *, lag(value) OVER (PARTITION BY {keys}, step_s ORDER BY us) AS before FROM grid),
win AS (SELECT {keys}, step_s, count(*) AS n, min(us) AS f, max(us) AS l, arg_min(value, us) AS fv, arg_max(value, us) AS lv,
  sum(CASE WHEN value < before THEN before ELSE 0 END) AS resets FROM steps GROUP BY {keys}, step_s HAVING count(*) >= 2),
g1 AS (SELECT *, (l - f) / 1e6 AS span, lv - fv + resets AS inc, (f - (step_s - {REACH}) * 1000000) / 1e6 AS s0, (step_s * 1000000 - l) / 1e6 AS e0 FROM win),
g2 AS (SELECT *, span / (n - 1) AS gap FROM g1),
g3 AS (SELECT *, CASE WHEN s0 >= gap * 1.1 THEN gap / 2 ELSE s0 END AS s1, CASE WHEN e0 >= gap * 1.1 THEN gap / 2 ELSE e0 END AS e1 FROM g2),
g4 AS (SELECT *, CASE WHEN inc > 0 AND fv >= 0 THEN least(s1, span * (fv / inc)) ELSE s1 END AS s2 FROM g3),
rates AS (SELECT {keys}, step_s, inc * ((span + s2 + e1) / span) / {REACH} AS rate FROM g4)"""


_COUNTERS = f"""{with_clause('f_metrics')},
counters AS (SELECT metric, instance, ts, sum(cents) OVER (PARTITION BY metric, instance, day ORDER BY ts, event_id) / 100.0 AS value FROM f_metrics)"""
_LES = ", ".join(f"('{bound}', {'1e999' if bound == '+Inf' else bound})" for bound in BUCKETS)
_BUCKETS = f"""{with_clause('f_metrics')}, les AS (SELECT * FROM (VALUES {_LES.replace('1e999', "'infinity'::double")}) v(le, bound)),
buckets AS (SELECT metric, instance, le, ts, cast(sum(CASE WHEN value <= bound THEN 1 ELSE 0 END) OVER (PARTITION BY metric, instance, day, le ORDER BY ts, event_id) AS double) AS value FROM f_metrics, les)"""
_DAY_COUNTER = """WITH base AS (SELECT event_type AS metric, 'i' || cast(user_id % 3 AS varchar) AS instance, ts, cast((epoch_us(ts) // 1000) % 86400000 AS double) AS value FROM events)"""

_GAUGE_ROWS = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(K.EXPORTED_GAUGES.items()))

CHECKS = {
    "bench_summary": f"{with_clause('f_bench')} SELECT model, cast(run_day AS varchar) AS run_day, {_MEASURES} FROM f_bench GROUP BY model, run_day",
    "request_sequence": f"{with_clause('f_bench')} SELECT event_id, model, row_number() OVER (PARTITION BY model, run_day ORDER BY ts, event_id) AS request_id FROM f_bench",
    "run_report": f"{_RUNS} SELECT model, timestamp, avg_latency_s, min_latency_s, max_latency_s, num_requests, successful FROM runs",
    "latency_series": f"{_RUNS} SELECT model, file_name, timestamp, avg_latency_s FROM runs",
    "distinct_models": f"{with_clause('f_bench')} SELECT DISTINCT model FROM f_bench",
    "latest_gauge": f"{with_clause('f_metrics')} SELECT metric, instance, arg_max(value, ts) AS value, epoch_us(max(ts)) AS ts_us FROM f_metrics WHERE epoch_us(ts) > (SELECT epoch_us(max(ts)) // 1000000 + 1 - 6 * 3600 FROM f_metrics) * 1000000 GROUP BY 1, 2",
    "instant_gauge": f"{with_clause('f_metrics')}, grid AS ({_grid('f_metrics', 2 * HOUR)}) SELECT metric, instance, step_s, arg_max(value, us) AS value FROM grid GROUP BY 1, 2, 3",
    "gauge_mib": f"{with_clause('f_files')} SELECT dir, round(sum(length) / 1024 / 1024, 6) AS mib FROM f_files GROUP BY dir",
    "counter_rate": f"{_COUNTERS}, {_rate_ctes('counters', 'metric, instance')} SELECT metric, instance, step_s, round(rate, 6) AS rate FROM rates",
    "hist_quantile": f"""{_BUCKETS}, {_rate_ctes('buckets', 'metric, instance, le')},
b AS (SELECT r.metric, r.instance, r.step_s, l.bound, max(r.rate) OVER (PARTITION BY r.metric, r.instance, r.step_s ORDER BY l.bound) AS c FROM rates r JOIN les l ON r.le = l.le),
p AS (SELECT *, lag(bound) OVER w AS lo, lag(c) OVER w AS done, max(c) OVER (PARTITION BY metric, instance, step_s) AS total,
  max(CASE WHEN bound < 'infinity'::double THEN bound END) OVER (PARTITION BY metric, instance, step_s) AS top,
  max(bound) OVER (PARTITION BY metric, instance, step_s) AS edge, count(*) OVER (PARTITION BY metric, instance, step_s) AS k FROM b WINDOW w AS (PARTITION BY metric, instance, step_s ORDER BY bound)),
h AS (SELECT *, row_number() OVER (PARTITION BY metric, instance, step_s ORDER BY bound) AS r FROM p WHERE c >= 0.95 * total)
SELECT metric, instance, step_s, CASE WHEN k < 2 OR edge < 'infinity'::double OR total <= 0 THEN NULL WHEN bound = 'infinity'::double THEN round(top, 4)
 ELSE round(coalesce(lo, 0) + (bound - coalesce(lo, 0)) * ((0.95 * total - coalesce(done, 0)) / (c - coalesce(done, 0))), 4) END AS quantile FROM h WHERE r = 1""",
    "metric_or": f"""{with_clause('f_metrics')}, grid AS ({_grid('f_metrics', HOUR)}), v AS (SELECT metric, instance, step_s, arg_max(value, us) AS value FROM grid GROUP BY 1, 2, 3)
SELECT step_s, round(coalesce({', '.join(f"sum(value) FILTER (WHERE metric = '{m}')" for m in PRIORITY)}), 4) AS value FROM v WHERE metric IN {PRIORITY} GROUP BY step_s""",
    "scrape_grid": f"""{with_clause('f_metrics')}, c AS (SELECT metric, epoch_us(ts) // 900000000 * 900 AS step_s, count(*) AS n FROM f_metrics GROUP BY 1, 2),
g AS (SELECT metric, unnest(generate_series((SELECT min(step_s) FROM c), (SELECT max(step_s) FROM c), 900)) AS step_s
  FROM (SELECT DISTINCT metric FROM c UNION ALL SELECT 'silent'))
SELECT g.metric, g.step_s, CASE WHEN c.n IS NULL THEN 0::bigint ELSE 1::bigint END AS up, coalesce(c.n, 0) AS scraped FROM g LEFT JOIN c ON g.metric = c.metric AND g.step_s = c.step_s""",
    "scrape_parse": """SELECT event_id, event_type AS metric, CASE WHEN event_id % 10 = 1 THEN '' ELSE '{instance="i' || cast(user_id % 3 AS varchar) || '",user="' || CASE WHEN event_id % 10 = 2 THEN 'a' || chr(92) || '"b' ELSE cast(user_id AS varchar) END || '"}' END AS series,
 cast(cast(round(value * 100) AS bigint) AS double) AS value, CASE WHEN event_id % 3 = 0 THEN event_id END AS time_ms FROM events WHERE event_id % 10 <> 0""",
    "expose_render": f"""{with_clause('f_models', 'f_sources')},
c AS (SELECT source, count(*) FILTER (WHERE NOT loaded) AS a, count(*) FILTER (WHERE loaded) AS l FROM f_models GROUP BY 1),
s AS (SELECT s.*, CASE WHEN up THEN coalesce(a, 0) ELSE 0 END AS a, CASE WHEN up THEN coalesce(l, 0) ELSE 0 END AS l FROM f_sources s LEFT JOIN c ON s.source = c.source),
m AS (SELECT m.source, m.loaded, '{{' || CASE WHEN family = '' THEN '' ELSE 'family="' || replace(family, '"', chr(92) || '"') || '",' END || 'model="' || model || '"}}' AS labels,
  CASE WHEN size = 'n/a' THEN '0.0' ELSE size || '.0' END AS size FROM f_models m JOIN f_sources s ON m.source = s.source AND s.up)
SELECT source, 'ollama_up ' || CASE WHEN up THEN '1' ELSE '0' END AS line FROM s UNION ALL SELECT source, 'ollama_models_total ' || cast(a AS varchar) FROM s
UNION ALL SELECT source, 'ollama_loaded_models_total ' || cast(l AS varchar) FROM s UNION ALL SELECT source, 'ollama_scrape_duration_seconds ' || printf('%.6f', cast(scrape_seconds AS double)) FROM s
UNION ALL SELECT source, CASE WHEN loaded THEN 'ollama_loaded_model_info' ELSE 'ollama_model_info' END || labels || ' 1' FROM m
UNION ALL SELECT source, 'ollama_loaded_model_size_bytes' || labels || ' ' || size FROM m WHERE loaded
UNION ALL SELECT source, 'ollama_loaded_model_size_vram_bytes' || labels || ' 7.0' FROM m WHERE loaded""",
    "stream_summary": f"{with_clause('f_bench')} SELECT cast(run_day AS varchar) AS run_day, model, {_MEASURES} FROM f_bench GROUP BY model, run_day",
    "stream_rate": f"""{_DAY_COUNTER}, {_rate_ctes('base', 'metric, instance')} SELECT metric, instance, step_s, round(rate, 6) AS rate FROM rates WHERE step_s % {REACH} = 0""",
    "stream_scrape": """SELECT event_type AS metric, CASE WHEN event_id % 10 = 1 THEN '' ELSE '{instance="i' || cast(user_id % 3 AS varchar) || '",user="' || CASE WHEN event_id % 10 = 2 THEN 'a' || chr(92) || '"b' ELSE cast(user_id AS varchar) END || '"}' END AS series,
 cast(cast(round(value * 100) AS bigint) AS double) AS value FROM events WHERE event_id % 10 <> 0""",
}
_NAMED = ", ".join(f"('{kind}', '{metric}')" for kind, metric in _PANEL_METRICS.items())
_PLACES = ", ".join(f"('{panel}', '{metric}', {i})" for panel, metrics in K.SUM_FALLBACKS.items() for i, metric in enumerate(metrics))
CHECKS["dashboard_sums"] = f"""{with_clause('f_metrics')}, names AS (SELECT * FROM (VALUES {_NAMED}) n(kind, name)), places AS (SELECT * FROM (VALUES {_PLACES}) p(panel, name, place)),
grid AS ({_grid('f_metrics', HOUR)}), v AS (SELECT metric, instance, step_s, arg_max(value, us) AS value FROM grid GROUP BY 1, 2, 3),
s AS (SELECT panel, step_s, place, sum(value) AS value FROM v JOIN names ON metric = kind JOIN places ON places.name = names.name GROUP BY 1, 2, 3)
SELECT panel, step_s, round(arg_min(value, place), 4) AS value FROM s GROUP BY 1, 2"""
CHECKS["stream_due"] = f"""WITH e AS (SELECT event_id, user_id % 7 AS k, epoch_us(ts) // {DUE}000000 * {DUE} AS due FROM events),
l AS (SELECT 'i' || cast(k AS varchar) AS target, due, count(*) FILTER (WHERE event_id % 10 <> 0) AS n FROM e WHERE (due // {DUE} + k) % 5 <> 0 GROUP BY 1, 2),
g AS (SELECT target, unnest(generate_series((SELECT min(due) FROM l), (SELECT max(due) FROM l), {DUE})) AS due_s
  FROM (SELECT DISTINCT target FROM l UNION ALL SELECT 'silent'))
SELECT g.target, g.due_s, cast(CASE WHEN l.due IS NULL THEN 0 ELSE 1 END AS int) AS up, coalesce(l.n, 0) AS samples
FROM g LEFT JOIN l ON g.target = l.target AND g.due_s = l.due"""
CHECKS["expose_text"] = f"""WITH rendered AS ({CHECKS["expose_render"]}),
fam AS (SELECT * FROM (VALUES {_GAUGE_ROWS}) v(i, name, help)),
src AS (SELECT DISTINCT source FROM rendered),
lines AS (SELECT r.source, f.i, 2 AS part, r.line FROM rendered r JOIN fam f ON regexp_extract(r.line, '^[a-zA-Z_]+') = f.name
  UNION ALL SELECT source, i, 0, '# HELP ' || name || ' ' || help FROM src, fam
  UNION ALL SELECT source, i, 1, '# TYPE ' || name || ' gauge' FROM src, fam)
SELECT source, cast(row_number() OVER (PARTITION BY source ORDER BY i, part, line) AS int) AS line_number, line FROM lines"""
