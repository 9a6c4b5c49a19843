"""URL filter: rules by host and path, else logistic regression on hashed n-grams.
DataFrame functions only.

The host stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; the
path follows up to `?`, `#` or the end. A rule fits its host and all subdomains if the
path starts with the rule's; the longest fitting rule decides.

All other urls are judged by a logistic regression on the character n-grams of host and
path, hashed into `features` places. It is trained from a small labelled table (url
parts and verdict): each step sums the gradient over all labelled rows in one
aggregation, per place, and the driver holds the `features` weights, no more. The
query's labelled table are the urls that rules decide: the `labelled_rows` of them with
the smallest hashes, at most (a documented bound), weighted so that both verdicts count
the same.

Defined results: a NULL url and one without `://` have an empty host and path, hold no
n-gram and get the verdict of the intercept; without labelled rows, or with only one
verdict among them, everything undecided gets `allow` or that verdict; NULL ids and
repeated rows are judged alike; urls of any length are whole; an empty table gives no
rows. Further columns pass through unless they bear the name of a result column.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import ascii_lower, neutral, restored, written

#: (host, path, verdict), fixed for the query.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
FEATURES = 4096
LABELLED_ROWS = 4096
STEPS = 24
RATE = 2.0
RIDGE = 1e-4
SIZES = (3, 4)
RESULT = ("host", "path", "rule", "verdict", "score")


def url_parts(url: Column) -> tuple[Column, Column]:
    after = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """Rule text and verdict of the longest fitting rule; NULL if none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, answer in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        text = F.when(fits, F.lit(name + start)).otherwise(text)
        verdict = F.when(fits, F.lit(answer)).otherwise(verdict)
    return text, verdict


def _grams(chars: str, mark: str, n: int, places: int) -> Column:
    starts = F.expr(f"if(size({chars}) < {n}, array(), sequence(0, size({chars}) - {n}))")

    def place(i: Column) -> Column:
        hashed = F.xxhash64(F.lit(mark), *[F.get(F.col(chars), i + k) for k in range(n)])
        return F.pmod(hashed, F.lit(places)).cast("int")

    return F.transform(starts, place)


def with_features(parts: DataFrame, places: int, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """parts (host, path) with `_f`: distinct places of the n-grams of host and path, and
    last the intercept's place. Host and path have n-grams of their own, with marks at
    both ends."""
    marked = parts
    for name in ("host", "path"):
        # Characters once, so that each n-gram costs the same wherever it stands.
        marked = marked.withColumn(f"_{name}", F.split(F.concat(F.lit("^"), F.col(name), F.lit("$")), ""))
    grams = F.array_distinct(
        F.concat(*[_grams(f"_{name}", name, n, places) for name in ("host", "path") for n in sizes])
    )
    none = F.array().cast("array<int>")
    found = F.when((F.col("host") == "") & (F.col("path") == ""), none).otherwise(grams)
    return marked.withColumn("_f", F.array_append(found, F.lit(places))).drop("_host", "_path")


def _score(weights: list[float]) -> Column:
    """Probability of `block`. The weights are one constant array."""
    held = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    total = F.aggregate("_f", F.lit(0.0), lambda a, i: a + F.get(held, i))
    return 1 / (1 + F.exp(-total / F.sqrt(F.size("_f"))))


def train(labelled: DataFrame, places: int = FEATURES, steps: int = STEPS, rate: float = RATE) -> list[float]:
    """Weights, the intercept last, from rows of host, path and verdict.

    Every step is one aggregation over all rows; places adapt their own step lengths."""
    sums = {row["verdict"]: row["n"] for row in labelled.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = [0.0] * (places + 1)
    n_block, n_allow = sums.get("block", 0), sums.get("allow", 0)
    if not n_block or not n_allow:
        weights[places] = 0.0 if n_block == n_allow else math.copysign(10.0, n_block - n_allow)
        return weights
    weight = F.when(F.col("verdict") == "block", 0.5 / n_block).otherwise(0.5 / n_allow)
    wanted = F.when(F.col("verdict") == "block", 1.0).otherwise(0.0)
    rows = written(
        with_features(labelled, places).select("_f", weight.alias("_w"), wanted.alias("_y")).coalesce(1), "labelled"
    )
    seen = [1e-12] * (places + 1)
    for _ in range(steps):
        wrong = rows.select("_f", ((_score(weights) - F.col("_y")) * F.col("_w") / F.sqrt(F.size("_f"))).alias("_g"))
        slopes = wrong.select(F.explode("_f").alias("i"), "_g").groupBy("i").agg(F.sum("_g").alias("g"))
        # At most one row for each place.
        for i, slope in slopes.collect():
            slope += RIDGE * weights[i]
            seen[i] += slope * slope
            weights[i] -= rate * slope / math.sqrt(seen[i])
    return weights


def judge(
    pages: DataFrame,
    labelled: DataFrame,
    url: str = "url",
    rules: tuple = RULES,
    places: int = FEATURES,
) -> DataFrame:
    """pages with host, path, rule, verdict and score, the probability of `block`."""
    weights = train(labelled, places)
    pages, names = neutral(pages)
    host, path = url_parts(F.col(names[url]))
    parts = pages.select("*", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = with_features(parts, places).withColumn("score", _score(weights))
    learned = F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        *restored(names, RESULT),
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, learned).alias("verdict"),
        "score",
    )


def labelled_by_rules(pages: DataFrame, url: str = "url", rules: tuple = RULES, rows: int = LABELLED_ROWS) -> DataFrame:
    """The labelled table of the query: host, path, verdict of at most `rows` distinct
    urls that rules decide, those with the smallest hashes."""
    host, path = url_parts(F.col(url))
    parts = pages.select(host.alias("host"), path.alias("path"))
    decided = parts.withColumn("verdict", rule_of(F.col("host"), F.col("path"), rules)[1]).filter("verdict is not null")
    ranked = decided.distinct().withColumn("_rank", F.xxhash64("host", "path")).orderBy("_rank", "host", "path")
    return written(ranked.limit(rows).drop("_rank"), "urls")


def url_filter(pages: DataFrame) -> DataFrame:
    """Query: verdict of every page."""
    judged = judge(pages.select("page_id", "url"), labelled_by_rules(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")
