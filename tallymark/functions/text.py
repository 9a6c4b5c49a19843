"""Text normalisation as column expressions; Python only where Unicode needs it."""

from __future__ import annotations

import json
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark import constants as K
from tallymark.functions import once_per_row, ship_by_value

ship_by_value(__name__)

HELD_CHARACTERS = 1 << 20
# Unicode white space plus the four ASCII separators that \s leaves out.
_SPACE = r"[\s\x1c-\x1f]"


def strip(value: Column) -> Column:
    """Trim every kind of white space (SQL trim takes only the ASCII blank)."""
    return F.regexp_replace(value, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def clean_cell(value: Column) -> Column:
    """Trimmed text, or NULL when nothing is left."""
    return F.nullif(strip(value), F.lit(""))


def _per_text(values: pa.Array, ascii_path, unicode_path) -> pa.Array:
    """Vector kernel on the plain ASCII values, Python on the others."""
    is_ascii = pc.fill_null(pc.string_is_ascii(values), True)
    result = ascii_path(values)
    if pc.all(is_ascii).as_py() is False:
        others = pc.invert(is_ascii)
        mapped = [unicode_path(text) for text in values.filter(others).to_pylist()]
        result = pc.replace_with_mask(result, others, pa.array(mapped, values.type))
    return result


@once_per_row(T.StringType())
def fold_key(values: pa.Array) -> pa.Array:
    """Name key: compatibility form and case fold; blanks stay as they are."""
    return _per_text(
        values,
        pc.ascii_lower,
        lambda text: unicodedata.normalize("NFKC", text).casefold(),
    )


def _fold_words(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).split()).casefold()


@once_per_row(T.StringType())
def fold_text(values: pa.Array) -> pa.Array:
    """Comparison text: compatibility form, single blanks, trimmed, case fold."""

    def plain(texts: pa.Array) -> pa.Array:
        single = pc.replace_substring_regex(texts, r"[\s\x0b\x1c-\x1f]+", " ")
        return pc.ascii_lower(pc.utf8_trim(single, characters=" "))

    return _per_text(values, plain, _fold_words)


def _tagged(value):
    """Leaves become text that starts with their type, so that '1' and 1 differ
    while 1, 1.0 and true agree."""
    if isinstance(value, str):
        return "s:" + _fold_words(value)
    if isinstance(value, dict):
        return {key: _tagged(item) for key, item in value.items()}
    if isinstance(value, list):
        return [_tagged(item) for item in value]
    if value is None:
        return None
    if isinstance(value, float):
        whole = value.is_integer() if value == value else False
        return f"n:{int(value) if whole else value!r}"
    return f"n:{int(value)}"


def _canonical(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return json.dumps(_tagged(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def canonical_texts(values: pa.Array) -> pa.Array:
    """One spelling per JSON value under the comparison rules; NULL if unreadable.

    Texts are read one at a time and spellings packed by the megabyte, so a batch is never
    there as Python texts: what a task needs does not follow the rows of its batches.
    """
    parts, held, size = [], [], 0
    for value in values:
        text = _canonical(value.as_py())
        held.append(text)
        size += len(text or "")
        if size >= HELD_CHARACTERS:
            parts.append(pa.array(held, values.type))
            held, size = [], 0
    return pa.concat_arrays([*parts, pa.array(held, values.type)])


canonical_json = once_per_row(T.StringType())(canonical_texts)


def slug(value: Column, fallback: str | None = None) -> Column:
    """Lower case, runs of anything but letters and digits become one dash."""
    dashed = F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", "-")
    trimmed = F.regexp_replace(dashed, "^-+|-+$", "")
    return trimmed if fallback is None else F.coalesce(F.nullif(trimmed, F.lit("")), F.lit(fallback))


def binding_id(runtime: Column, model_name: Column) -> Column:
    prefix = F.when(runtime == "ollama", F.lit("chat")).otherwise(F.replace(runtime, F.lit("."), F.lit("-")))
    return F.concat(prefix, F.lit("-"), slug(model_name))


def default_alias(runtime: Column) -> Column:
    return F.concat(F.lit("local-"), F.replace(runtime, F.lit("."), F.lit("-")))


def qualified_model(provider: Column, model: Column) -> Column:
    """provider/model, NULL when either part is missing."""
    return F.concat(F.nullif(provider, F.lit("")), F.lit("/"), F.nullif(model, F.lit("")))


def run_id(model: Column, started: Column) -> Column:
    return F.concat(slug(model, "model"), F.lit("_"), F.date_format(started, "HHmmss"))


def report_name(model: Column, started: Column) -> Column:
    return F.concat(
        F.lit("benchmark_"),
        F.replace(model, F.lit("/"), F.lit("_")),
        F.lit("_"),
        F.date_format(started, "yyyyMMdd_HHmmss"),
        F.lit(".json"),
    )


def is_floating_tag(tag: Column) -> Column:
    lowered = F.lower(tag)
    return lowered.isin(*K.FLOATING_TAGS) | lowered.startswith(K.FLOATING_PREFIX)


def number_or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 instead of NULL when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def quoted(text: Column) -> Column:
    """Text in single quotes, the way messages show a value."""
    return F.concat(F.lit("'"), text, F.lit("'"))
