"""Recorded JSON replies: text extraction, strict parsing, lookups, checks."""

from __future__ import annotations

import re
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import once_per_row, ship_by_value
from tallymark.functions.text import strip

ship_by_value(__name__)

Template = dict[str, Any]

_END = "end of the recorded text"
KEPT_NULLS = {"ignoreNullFields": "false"}


def _step(path: str) -> str:
    return "$" + "".join(f'["{part}"]' for part in path.split(".")) if path else "$"


def add_value(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds the VARIANT of a text that is one JSON value and nothing else.

    The variant parser ignores whatever follows the first value. Put into an array with
    an end mark, a text with such a rest moves the mark from its place or leaves more
    behind it, and then it is refused. The array is a column of its own, so that every text is parsed once.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    whole = (F.try_variant_get("_wrapped", "$[1]", "string") == _END) & F.try_variant_get(
        "_wrapped", "$[2]", "variant"
    ).isNull()
    return (
        df.withColumn("_wrapped", wrapped)
        .withColumn(name, F.when(whole, F.try_variant_get("_wrapped", "$[0]", "variant")))
        .drop("_wrapped")
    )


def add_object(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the VARIANT of a text column that is one JSON object, else NULL."""
    is_object = strip(F.col(text)).startswith("{")
    return add_value(df, F.when(is_object, F.col(text)), name)


def type_of(value: Column) -> Column:
    """STRING, BIGINT, DOUBLE, DECIMAL, BOOLEAN, VOID, ARRAY, OBJECT; NULL when absent."""
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)


def member_types(value: Column) -> Column:
    """Type of every member of an object as a map; NULL when the value is no object."""
    return F.transform_values(members(value), lambda _, member: type_of(member))


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, for places that have no column to put
    it in (the inside of a lambda)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")


def members(value: Column) -> Column:
    """Object members as a map, NULL when the value is no object."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def at(value: Column, path: str, as_type: str = "variant") -> Column:
    """Dotted lookup; NULL when a step is missing or is no object."""
    return F.try_variant_get(value, _step(path), as_type)


def text_at(value: Column, path: str) -> Column:
    return at(value, path, "string")


def unfence(text: Column) -> Column:
    """Strip a Markdown code fence around the reply."""
    body = strip(text)
    opened = strip(F.regexp_replace(body, "^(```json)?(```)?", ""))
    closed = strip(F.regexp_replace(opened, "```$", ""))
    return F.when(body.startswith("```"), closed).otherwise(body)


def message_of(reply: Column) -> Column:
    return F.try_variant_get(reply, "$.choices[0].message", "variant")


def _joined_parts(content: Column) -> Column:
    parts = F.try_variant_get(content, "$", "array<variant>")
    texts = F.transform(
        parts,
        lambda part: F.when(
            type_of(F.try_variant_get(part, "$.text", "variant")) == "STRING",
            F.try_variant_get(part, "$.text", "string"),
        ),
    )
    return F.array_join(F.array_compact(texts), "\n")


def parsed_text(body: Column) -> Column:
    """The parsed member of a raw reply as minified text in its own key order."""
    text = F.get_json_object(body, "$.choices[0].message.parsed")
    return F.when(text.startswith("{"), text)


def reply_text(reply: Column, body: Column) -> Column:
    """Text of a chat reply (its VARIANT and its raw text): the content string, its
    text parts, the parsed object, else ''."""
    message = message_of(reply)
    kind = type_of(at(message, "content"))
    return (
        F.when(kind == "STRING", text_at(message, "content"))
        .when(kind == "ARRAY", _joined_parts(at(message, "content")))
        .otherwise(F.coalesce(F.when(type_of(at(message, "parsed")) == "OBJECT", parsed_text(body)), F.lit("")))
    )


def refusal_text(reply: Column) -> Column:
    """Why the model refused, NULL when it did not."""
    return F.nullif(text_at(message_of(reply), "refusal"), F.lit(""))


# All that moves the scanner.
_TOKEN = re.compile(r'[{}"\\]')


def _merged(one: dict[int, list[int]], level: int, other: dict[int, list[int]], other_level: int):
    """Open starts of two scanners that go on alike, the smaller told at the larger's level."""
    if len(one) < len(other):
        one, level, other, other_level = other, other_level, one, level
    for target, starts in other.items():
        one.setdefault(target + level - other_level, []).extend(starts)
    return one, level


def _balanced_object(text: str | None) -> str | None:
    """First {...} whose braces balance outside strings; the text when none does.

    One pass for all starts: starts whose scanners are in the same state (outside or
    inside a string) share one brace level and are filed by the level at which they
    balance, so the time is linear in the text.
    """
    if text is None:
        return None
    outside: dict[int, list[int]] = {}
    inside: dict[int, list[int]] = {}
    level = inside_level = 0
    escaped = -1
    first, end = len(text), 0
    for token in _TOKEN.finditer(text):
        at = token.start()
        kind = text[at]
        if kind == "{":
            outside.setdefault(level, []).append(at)
            level += 1
        elif kind == "}":
            level -= 1
            done = outside.pop(level, None)
            if done:
                start = min(done)
                if start < first:
                    first, end = start, at + 1
        elif kind == '"':
            if at == escaped:
                inside, inside_level = _merged(inside, inside_level, outside, level)
                outside, level = {}, 0
            else:
                outside, inside, level, inside_level = inside, outside, inside_level, level
        elif at != escaped:
            escaped = at + 1
    return text[first:end] if end else text


@once_per_row(T.StringType())
def first_json_object(values: pa.Array) -> pa.Array:
    return pa.array([_balanced_object(text) for text in values.to_pylist()], pa.string())


def tolerant_body(text: Column) -> Column:
    """Reply text without its fence, ready for the balanced scan."""
    body = strip(text)
    opened = F.regexp_replace(body, r"^```(?:json)?(?U)\s*", "")
    closed = F.regexp_replace(opened, r"(?U)\s*```$", "")
    return F.when(body.startswith("```"), closed).otherwise(body)


# --- templates: nested dicts whose leaves are None (text or null) or a constant ---


def template_struct(template: Template) -> str:
    """Struct of texts with the template's shape, as a schema text."""
    parts = [
        f"`{key}`: {template_struct(item) if isinstance(item, dict) else 'string'}" for key, item in template.items()
    ]
    return f"struct<{', '.join(parts)}>"


def texts(values: list[str]) -> Column:
    """Constant array of texts, built in one call."""
    spelled = [value.replace("\\", "\\\\").replace("'", "\\'") for value in values]
    items = ", ".join(f"'{value}'" for value in spelled)
    return F.expr(f"cast(array({items}) AS array<string>)")


class Level(NamedTuple):
    """One object of a template: its path and its keys by what they hold."""

    path: str
    free: list[str]
    constants: dict[str, str]
    objects: list[str]

    @property
    def keys(self) -> list[str]:
        return sorted([*self.free, *self.constants, *self.objects])

    def child(self, key: str) -> str:
        return f"{self.path}.{key}" if self.path else key


def levels(template: Template, path: str = "") -> list[Level]:
    """The objects of a template, outer ones first."""
    here = Level(
        path,
        [key for key, item in template.items() if item is None],
        {key: item for key, item in template.items() if isinstance(item, str)},
        [key for key, item in template.items() if isinstance(item, dict)],
    )
    return [here] + [inner for key in here.objects for inner in levels(template[key], here.child(key))]


def leaf_paths(template: Template) -> list[str]:
    """Dotted paths of the free leaves (constants are checked, not scored)."""
    return [level.child(key) for level in levels(template) for key in level.free]


def missing_keys(expected: Column, actual: Column) -> Column:
    return F.sort_array(F.array_except(expected, actual))


def level_types(value: Column, template: Template) -> Column:
    """Member types at every object of the template (NULL where there is no object)."""
    return F.array(*[member_types(at(value, level.path)) for level in levels(template)])


def _level_errors(value: Column, types: Column, level: Level) -> Column:
    """Deviations at one object of the template. The rules run over key lists, so the
    expression does not grow with the number of fields."""
    found = F.map_keys(types)
    prefix = f"{level.path}." if level.path else ""

    def named(keys: Column, suffix: str) -> Column:
        return F.transform(keys, lambda key: F.concat(F.lit(prefix), key, F.lit(suffix)))

    pieces = [
        named(missing_keys(texts(level.keys), found), " is missing"),
        named(missing_keys(found, texts(level.keys)), " is not allowed"),
    ]
    if level.free:
        wrong = F.filter(texts(level.free), lambda key: ~F.try_element_at(types, key).isin("STRING", "VOID"))
        pieces.append(named(wrong, " must be string or null"))
    for key, constant in level.constants.items():
        kind = F.try_element_at(types, F.lit(key))
        same = (kind == "STRING") & (text_at(value, level.child(key)) == constant)
        message = texts([f"{level.child(key)} must equal {constant!r}"])
        pieces.append(F.when(kind.isNotNull() & ~same, message).otherwise(texts([])))
    # An absent object is reported by the level above.
    present = at(value, level.path).isNotNull()
    not_object = F.when(present, texts([f"{level.path or '$'} must be an object"])).otherwise(texts([]))
    return F.when(types.isNotNull(), F.concat(*pieces)).otherwise(not_object)


def schema_errors(value: Column, types: Column, template: Template) -> Column:
    """Every deviation of a payload from its template, sorted; types as level_types()
    gives them."""
    found = [_level_errors(value, F.get(types, F.lit(i)), level) for i, level in enumerate(levels(template))]
    return F.sort_array(F.concat(*found))


def per_side(side: Column, templates: dict[str, Template], build) -> Column:
    """build(template) for the template of the row's side."""
    result = None
    for name, template in templates.items():
        branch = build(template)
        result = F.when(side == name, branch) if result is None else result.when(side == name, branch)
    return result
