"""Line-first quality rules: lines are judged, failing lines removed, and documents that
lose too much of their text rejected. DataFrame functions only; no shuffle, every
document is judged inside its own row.

A line with a word fails by the first rule that fits:
* `punctuation`: more than one run of repeated marks or symbols in `words_per_run`
  words, or no closing mark at its end;
* `navigation`: a separator for every `words_per_bar` words or fewer, or a short menu entry;
* `boilerplate`: licence, copyright, cookie and similar notices.
Lines without a word stay. A document that keeps its base checks is kept if at most
`max_lost` percent of its words stood in failing lines.

Repeated windows are found by sorting one number per window (its hash above, its place
below) and comparing neighbours; equal hashes count only if the words are equal.

Defined results: a NULL or blank text has zero counts and fails the base checks; texts of
any length are one row's work, n log n in their words; ties do not arise; repeated rows
are judged alike; an empty table gives no rows; further columns pass through unless they
bear the name of a result column, which then replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import WORD, neutral, restored

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WORDS_PER_RUN = 5
WORDS_PER_BAR = 4
MAX_LOST_PERCENT = 50
#: Fixed patterns of the rules, valid for Java and RE2 alike.
SYMBOLS = r"[#*$%&|<>]"
RUNS = r"[!?]{2,}|[#*$%&]{2,}|\.{4,}"
CLOSED = "[.!?:;…)\\]\"'”»][\\x20\\x09-\\x0D]*$"
BARS = "[|»›•→]"
MENU = (
    r"(?i)^[^a-z]*(home|menu|login|log in|sign in|sign up|register|contact|about us|search|next|previous|"
    r"back to top|share|read more|skip to content)[^a-z]*$"
)
NOTICE = (
    r"(?i)(copyright|all rights reserved|terms of use|terms of service|privacy policy|use cookies|"
    r"enable javascript|lorem ipsum|licensed under|under the [a-z0-9.-]+ license|permission is hereby granted|"
    r"spdx-license-identifier)"
)
RESULT = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed lost_words n_failed_lines kept clean_text"
).split()


def line_rule(line: Column, words: Column, words_per_run: int, words_per_bar: int) -> Column:
    """Name of the rule that a line fails, else NULL."""
    return (
        F.when(words == 0, F.lit(None))
        .when(F.regexp_count(line, F.lit(BARS)) * words_per_bar >= words, F.lit("navigation"))
        .when(line.rlike(MENU), F.lit("navigation"))
        .when(line.rlike(NOTICE), F.lit("boilerplate"))
        .when(F.regexp_count(line, F.lit(RUNS)) * words_per_run > words, F.lit("punctuation"))
        .when(~line.rlike(CLOSED), F.lit("punctuation"))
    )


def _repeat_places(words: str, ordered: str) -> Column:
    """Places of windows that occur twice or more, in order. `ordered` holds the sorted
    numbers, `_bits` how many of their low bits are the place."""
    w, o, bits = F.col(words), F.col(ordered), F.col("_bits")
    low = F.expr("shiftleft(1L, _bits) - 1")

    def same(x: Column, y: Column) -> Column:
        i, j = x.bitwiseAND(low).cast("int"), y.bitwiseAND(low).cast("int")
        equal = F.expr("true")
        for k in range(3):
            equal = equal & (F.get(w, i + k) == F.get(w, j + k))
        return (F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits)) & equal

    def repeated(x: Column, i: Column) -> Column:
        before, after = F.get(o, i - 1), F.get(o, i + 1)
        return F.coalesce(same(x, before), F.lit(False)) | F.coalesce(same(x, after), F.lit(False))

    return F.sort_array(F.transform(F.filter(o, repeated), lambda x: x.bitwiseAND(low)))


def clean_lines(
    docs: DataFrame,
    text: str = "text",
    min_words: int = MIN_WORDS,
    max_repeat: int = MAX_REPEAT_PERCENT,
    words_per_run: int = WORDS_PER_RUN,
    words_per_bar: int = WORDS_PER_BAR,
    max_lost: int = MAX_LOST_PERCENT,
) -> DataFrame:
    """docs with the counts, `kept` and `clean_text`, the text without failing lines.

    Steps are separate projections, each used more than once by the next, so that no
    array is computed again for every element of another one.
    """
    docs, names = neutral(docs)
    carried = [F.col(name) for name in names.values()]
    full = F.coalesce(F.col(names[text]), F.lit(""))
    split = docs.select(
        *carried,
        F.regexp_extract_all(full, F.lit(WORD), F.lit(0)).alias("_words"),
        F.transform(
            F.split(full, "\n"), lambda line: F.struct(line.alias("line"), F.regexp_count(line, F.lit(WORD)).alias("words"))
        ).alias("_lines"),
    )
    places = F.expr("if(size(_words) < 3, array(), sequence(0, size(_words) - 3))")
    judged = split.select(
        *carried,
        "_words",
        F.expr("cast(ceil(log2(size(_words) + 1)) as int)").alias("_bits"),
        F.transform(
            "_lines",
            lambda x: F.struct(
                x["line"].alias("line"),
                x["words"].alias("words"),
                line_rule(x["line"], x["words"], words_per_run, words_per_bar).alias("rule"),
            ),
        ).alias("_lines"),
        places.alias("_places"),
    )
    number = F.transform(
        "_places",
        lambda i: F.call_function(
            "shiftleft",
            F.xxhash64(*[F.get("_words", i + k) for k in range(3)]),
            F.col("_bits"),
        ).bitwiseOR(i.cast("bigint")),
    )
    ordered = judged.select(
        *carried,
        "_words",
        "_bits",
        "_lines",
        F.filter("_lines", lambda x: x["words"] > 0).getField("line").alias("_said"),
        F.sort_array(number).alias("_ordered"),
    )
    repeated = ordered.select(
        *carried,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.length(full) - F.length(F.regexp_replace(full, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_said") - F.size(F.array_distinct("_said"))).cast("bigint").alias("n_dup_lines"),
        "_lines",
        _repeat_places("_words", "_ordered").alias("_repeats"),
    )
    # A repeated window adds the words that its predecessor in line did not cover.
    gain = F.transform(
        "_repeats", lambda p, i: F.least(F.lit(3).cast("bigint"), F.coalesce(p - F.get("_repeats", i - 1), F.lit(3)))
    )
    zero = F.lit(0).cast("bigint")
    counted = repeated.select(
        *carried,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.aggregate(gain, zero, lambda a, x: a + x).alias("n_repeat_words"),
        F.aggregate("_lines", zero, lambda a, x: a + F.when(x["rule"].isNotNull(), x["words"]).otherwise(0)).alias(
            "lost_words"
        ),
        F.size(F.filter("_lines", lambda x: x["rule"].isNotNull())).cast("bigint").alias("n_failed_lines"),
        F.array_join(F.filter("_lines", lambda x: x["rule"].isNull()).getField("line"), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat)
    lost = F.col("lost_words") * 100 > F.col("n_words") * max_lost
    judged = counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~lost)
    return judged.select(*restored(names, RESULT), *RESULT)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Query: counts and verdict of every document."""
    return clean_lines(docs.select("doc_id", "text")).select(
        "doc_id", *[c for c in RESULT if c != "clean_text"]
    )


def _sql() -> str:
    quoted = {k: v.replace("'", "''") for k, v in globals().items() if k in ("RUNS", "CLOSED", "BARS", "MENU", "NOTICE")}
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
  FROM documents),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + j) AS n FROM rep, unnest([0, 1, 2]) AS v(j) GROUP BY r),
lines AS (
  SELECT r, line, len(regexp_extract_all(line, '{WORD}')) AS words
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
judged AS (
  SELECT r, line, words,
    len(regexp_extract_all(line, '{quoted["BARS"]}')) * {WORDS_PER_BAR} >= words
    OR regexp_matches(line, '{quoted["MENU"]}') OR regexp_matches(line, '{quoted["NOTICE"]}')
    OR len(regexp_extract_all(line, '{quoted["RUNS"]}')) * {WORDS_PER_RUN} > words
    OR NOT regexp_matches(line, '{quoted["CLOSED"]}') AS bad
  FROM lines WHERE words > 0),
l AS (
  SELECT r, count(*) - count(DISTINCT line) AS dup,
         sum(CASE WHEN bad THEN words ELSE 0 END)::BIGINT AS lost, count(*) FILTER (bad) AS n_bad
  FROM judged GROUP BY r),
f AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
    list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS chars,
    (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup, 0) AS dup, coalesce(cov.n, 0) AS rep, coalesce(lost, 0) AS lost, coalesce(n_bad, 0) AS n_bad
  FROM d LEFT JOIN l USING (r) LEFT JOIN cov USING (r))
SELECT doc_id, n_words, coalesce(chars, 0) AS word_chars, n_symbols, dup AS n_dup_lines, rep AS n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * rep > {MAX_REPEAT_PERCENT} * n_words AS base_failed, lost AS lost_words,
  n_bad AS n_failed_lines,
  NOT (n_words < {MIN_WORDS} OR 100 * rep > {MAX_REPEAT_PERCENT} * n_words)
    AND NOT 100 * lost > {MAX_LOST_PERCENT} * n_words AS kept
FROM f"""


SQL = _sql()
