"""Text exposition of metric samples: rendering and parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape_label(value: Column) -> Column:
    text = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("\n"), F.lit("\\n"))
    return F.replace(text, F.lit('"'), F.lit('\\"'))


def unescape_label(value: Column) -> Column:
    """Escapes are read left to right, so an escaped backslash before an n stays one."""
    marked = F.replace(value, F.lit("\\\\"), F.lit("\x00"))
    text = F.replace(F.replace(marked, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
    return F.replace(text, F.lit("\x00"), F.lit("\\"))


def render_labels(labels: Column) -> Column:
    """{a="x",b="y"} with sorted names; blank labels are dropped, '' when none is left."""
    kept = F.map_filter(labels, lambda _, value: F.coalesce(value, F.lit("")) != "")
    pairs = F.transform(
        F.sort_array(F.map_entries(kept)),
        lambda pair: F.concat(pair["key"], F.lit('="'), escape_label(pair["value"]), F.lit('"')),
    )
    return F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.lit(""))


def render_line(metric: Column, labels: Column, value: Column) -> Column:
    return F.concat(metric, render_labels(labels), F.lit(" "), value)


# Possessive repeats: long label values must not recurse.
_TEXT = r'"(?:[^"\\]++|\\.)*+"'
_NAME = "[a-zA-Z_][a-zA-Z0-9_]*+"
_LABELS = rf"\{{\s*+(?:{_NAME}\s*+=\s*+{_TEXT}\s*+,?\s*+)*+\}}"
_LINE = rf"^([a-zA-Z_:][a-zA-Z0-9_:]*+)\s*+({_LABELS})?\s*+([^\s{{]\S*+)(?:\s++(-?[0-9]++))?\s*$"
_PAIR = rf'({_NAME})\s*+=\s*+"((?:[^"\\]++|\\.)*+)"'


def line_parts(line: Column) -> Column:
    """Metric, value, time and label block of a sample line, from one match; an array of
    one text when the line is no sample. Labels come last, they may hold anything."""
    return F.split(F.regexp_replace(line, _LINE, "$1\x01$3\x01$4\x01$2"), "\x01", 4)


def is_sample(parts: Column) -> Column:
    return F.size(parts) == 4


def label_map(parts: Column) -> Column:
    """Labels of a sample line; NULL when a name stands there twice."""
    block = F.get(parts, F.lit(3))
    names = F.regexp_extract_all(block, F.lit(_PAIR), F.lit(1))
    values = F.regexp_extract_all(block, F.lit(_PAIR), F.lit(2))
    plain = F.transform(values, lambda value: F.when(value.contains("\\"), unescape_label(value)).otherwise(value))
    return F.when(F.size(F.array_distinct(names)) == F.size(names), F.map_from_arrays(names, plain))


def sample_value(parts: Column) -> Column:
    text = F.get(parts, F.lit(1))
    return (
        F.when(F.lower(text).isin("+inf", "inf"), F.lit(float("inf")))
        .when(F.lower(text) == "-inf", F.lit(float("-inf")))
        .otherwise(text.try_cast("double"))
    )


def sample_time_ms(parts: Column) -> Column:
    return F.nullif(F.get(parts, F.lit(2)), F.lit("")).try_cast("bigint")
