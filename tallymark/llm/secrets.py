"""Secret scan with a trigram inverted index. DataFrame functions only.

From every rule's pattern a Boolean trigram query is derived: the literal runs that each
alternative cannot do without, lower-cased and cut into trigrams, ANDed within an
alternative and ORed between them. The index holds the postings (trigram, document) of
all trigrams that some query asks for; a query intersects postings by counting, per
alternative and document, its trigrams. Documents that satisfy no alternative of a rule
cannot match it. Rules with an alternative without a trigram are scanned in full.

Candidates are verified with the pattern itself on the whole text. Places of matches
come from splitting the text at the pattern: pieces and matches alternate, and their
lengths add up to code point offsets.

The candidate table holds a hash of (doc_id, text), a collision of which costs one more
verification and nothing else. It is written once; up to `broadcast_rows` of its rows
are broadcast, a larger table is joined by shuffle.

Defined results: NULL and empty texts hold no secrets; spans of several kinds may overlap
and are all reported, by start, then in the order of the rules; NULL ids and repeated
rows are scanned like others; an empty table gives no rows; texts of any length are
whole. Further columns pass through unless they bear the name of a result column.
"""

from __future__ import annotations

import re._constants as C
import re._parser as P
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import neutral, restored, written

BROADCAST_ROWS = 1_000_000
#: Alternatives of a query beyond which literal runs are given up for shorter ones.
MOST_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """`pattern` finds candidates; a match counts if `group` of it has `least` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: The base kinds first, then those that the scan adds.
BASE = (
    Rule(
        "assign",
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        6,
        2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + MORE


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, each the set of trigrams that it needs; an empty one needs none."""
    runs = _runs(list(P.parse(pattern)))
    queries = {frozenset(run[i : i + 3] for run in alternative for i in range(len(run) - 2)) for alternative in runs}
    # A weaker alternative includes the stronger ones.
    return [q for q in sorted(queries, key=sorted) if not any(other < q for other in queries)]


def _runs(parts: list) -> list[tuple[str, ...]]:
    """Literal runs of each alternative of a sequence, '' marking where a run breaks."""
    held: list[tuple[str, ...]] = [("",)]
    for name, value in parts:
        options = _options(name, value)
        if len(held) * len(options) > MOST_ALTERNATIVES:
            options = [("", "")]
        joined = []
        for left in held:
            for right in options:
                # The last run of the left goes on with the first run of the right.
                joined.append((*left[:-1], left[-1] + right[0], *right[1:]))
        held = list(dict.fromkeys(joined))
    return held


def _options(name, value) -> list[tuple[str, ...]]:
    """Ways to match one element, as runs: ('ab',) goes on on both sides, ('', '') is
    something unknown, ('ab', 'cd') has something unknown in between."""
    unknown = [("", "")]
    if name is C.LITERAL:
        low = chr(value).lower()
        return [(low,)] if len(low) == 1 else unknown
    if name is C.SUBPATTERN:
        return _runs(list(value[3]))
    if name is C.BRANCH:
        found = [run for branch in value[1] for run in _runs(list(branch))]
        return found if len(found) <= MOST_ALTERNATIVES else unknown
    if name in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, body = value
        if (low, high) == (0, 1):
            return [("",), *_runs(list(body))]
        if low == 0:
            return unknown
        # At least once: what it begins with follows the left, what it ends with meets the right.
        inner = _runs(list(body))
        if low == high == 1:
            return inner
        return [(run[0], *run[1:-1], run[-1]) if len(run) > 1 else (run[0], run[0]) for run in inner]
    if name is C.IN and all(kind is C.LITERAL for kind, _ in value) and len(value) <= 6:
        return [(chr(code).lower(),) for _, code in value]
    if name is C.AT:
        return [("",)]
    return unknown


def queries(rules: tuple[Rule, ...]) -> dict[str, list[frozenset[str]]]:
    """Queries of the rules that have one; the others are scanned in full."""
    derived = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    return {kind: query for kind, query in derived.items() if all(query)}


def postings(docs: DataFrame, key: Column, text: str, trigrams: list[str]) -> DataFrame:
    """The inverted index for the trigrams in use: (trigram, doc). A document's own
    entries are distinct."""
    low = F.lower(F.col(text))
    held = docs.select(key.alias("doc"), low.alias("low")).filter("low is not null")
    found = F.filter(F.lit(trigrams), lambda t: F.contains(F.col("low"), t))
    return held.select("doc", F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, key: Column, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc, mask): bit i is set if rule i may match. Only rules with a query."""
    asked = queries(rules)
    rows = [
        (trigram, number, clause, len(alternative))
        for number, rule in enumerate(rules)
        for clause, alternative in enumerate(asked.get(rule.kind, []))
        for trigram in sorted(alternative)
    ]
    # As long as the rules are: never more than their literals.
    wanted = docs.sparkSession.createDataFrame(rows, "trigram string, rule int, clause int, need int")
    index = postings(docs, key, text, sorted({row[0] for row in rows}))
    met = (
        index.join(F.broadcast(wanted), "trigram")
        .groupBy("doc", "rule", "clause", "need")
        .agg(F.count_distinct("trigram").alias("found"))
        .filter("found = need")
    )
    return met.groupBy("doc").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("mask"))


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Spans of one rule: structs of start, rule number, end and kind."""
    pattern = rule.pattern
    matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    groups = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(rule.group + 1))
    pieces = F.split(text, pattern, -1)
    lengths = F.zip_with(
        F.transform(pieces, lambda x: F.length(x)), F.transform(matches, lambda x: F.length(x)),
        lambda piece, match: F.struct(piece.alias("piece"), match.alias("match")),
    )
    measured = F.zip_with(
        lengths,
        F.transform(groups, lambda x: F.length(x)),
        lambda x, group: F.struct(x["piece"].alias("piece"), x["match"].alias("match"), group.alias("group")),
    )
    stops = _running(
        F.transform(measured, lambda x: x["piece"] + F.coalesce(x["match"], F.lit(0))), lambda a, b: a + b
    )
    # The last piece has no match behind it.
    spans = F.zip_with(
        measured,
        stops,
        lambda x, stop: F.struct(
            (stop - x["match"]).alias("start"), F.lit(number).alias("rule"), stop.alias("stop"), x["group"].alias("group")
        ),
    )
    good = F.filter(spans, lambda x: x["start"].isNotNull() & (x["group"] >= rule.least))
    return F.transform(good, lambda x: F.struct(x["start"], x["rule"], x["stop"]))


#: Strides of a running combination: more elements than an array can have.
_STRIDES = [1 << k for k in range(31)]


def _running(values: Column, join) -> Column:
    """Running combination of an array of numbers: each stride joins every element with
    the one so many places before, which by then stands for as many elements. Short arrays
    keep still once the stride exceeds them."""

    def joined(all_: Column, far: Column) -> Column:
        step = F.transform(all_, lambda x, i: F.when(i < far, x).otherwise(join(x, F.get(all_, i - far))))
        return F.when(F.size(all_) > far, step).otherwise(all_)

    return F.aggregate(F.lit(_STRIDES), values, joined)


def scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
    broadcast_rows: int = BROADCAST_ROWS,
    into: str = "secrets",
) -> DataFrame:
    """docs with a column `into`: all spans (start, rule, stop) by start, then rule."""
    docs, names = neutral(docs)
    doc_id, text = names[doc_id], names[text]
    key = F.xxhash64(F.col(doc_id), F.col(text))
    found = written(candidates(docs, key, text, rules), "candidates")
    found = F.broadcast(found) if found.count() <= broadcast_rows else found
    indexed = set(queries(rules))
    none = F.array().cast("array<struct<start:int,rule:int,stop:int>>")
    joined = docs.withColumn("doc", key).join(found, "doc", "left")
    full = F.coalesce(F.col(text), F.lit(""))
    parts = [
        F.when(F.col("mask").bitwiseAND(1 << i) != 0, _spans(full, rule, i)).otherwise(none)
        if rule.kind in indexed
        else F.when(full.rlike(rule.pattern), _spans(full, rule, i)).otherwise(none)
        for i, rule in enumerate(rules)
    ]
    return joined.select(*restored(names, [into]), F.sort_array(F.concat(*parts)).alias(into))


def joined_spans(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.lit([rule.kind for rule in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"], s["stop"])), ",")


def redact(scanned: DataFrame, text: str = "text", mark: str = "[SECRET]", spans: str = "secrets") -> DataFrame:
    """Scanned documents with every span replaced; overlapping spans are one."""
    full = F.col(f"`{text}`")
    found = F.col(f"`{spans}`")
    ends = _running(F.transform(found, lambda s: s["stop"]), F.greatest)

    def clean(bound: Column) -> Column:
        ends = bound["ends"]
        before = F.transform(bound["spans"], lambda s, i: F.struct(s["start"].alias("start"), F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("end")))
        apart = F.filter(before, lambda x: x["start"] >= x["end"])
        pieces = F.transform(apart, lambda x: F.concat(F.substring(full, x["end"] + 1, x["start"] - x["end"]), F.lit(mark)))
        return F.concat(F.array_join(pieces, ""), F.substring(full, F.element_at(ends, -1) + 1, F.length(full)))

    bound = F.array(F.struct(found.alias("spans"), ends.alias("ends")))
    return scanned.withColumn(text, F.when(F.size(found) > 0, F.get(F.transform(bound, clean), F.lit(0))).otherwise(full))


def secret_scan(docs: DataFrame) -> DataFrame:
    """Query: counts and spans of every document."""
    scanned = scan(docs.select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["rule"] < len(BASE))
    counts = [
        F.expr(f"cast(size(filter(secrets, s -> s.rule = {i})) as bigint)").alias(f"n_{rule.kind}")
        for i, rule in enumerate(BASE)
    ]
    return scanned.select(
        "doc_id",
        *counts,
        F.sha2(joined_spans(base, RULES), 256).alias("base_sha256"),
        joined_spans(F.col("secrets"), RULES).alias("spans"),
    )


def _sql() -> str:
    """Splits the text at each pattern, as above, with window sums for the places."""
    parts = []
    for i, rule in enumerate(RULES):
        quoted = rule.pattern.replace("'", "''")
        parts.append(f"""
SELECT r, {i} AS rule, '{rule.kind}' AS kind, stop - length(m) AS start, stop FROM (
  SELECT r, m, g, sum(length(p) + length(m)) OVER (PARTITION BY r ORDER BY i)::BIGINT AS stop FROM (
    SELECT r, i, ms[i] AS m, gs[i] AS g, ps[i] AS p FROM (
      SELECT r, regexp_extract_all(t, '{quoted}') AS ms, regexp_extract_all(t, '{quoted}', {rule.group}) AS gs,
             string_split_regex(t, '{quoted}') AS ps FROM d), unnest(range(1, len(ms) + 1)) AS u(i)))
WHERE length(g) >= {rule.least}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)}),
a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rule) FILTER (rule < {len(BASE)}) AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rule) AS spans
      FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)"""


SQL = _sql()
