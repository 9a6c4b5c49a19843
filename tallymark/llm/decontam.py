"""Benchmark decontamination by template canonicalisation.

Words lose outer punctuation; numbers, names (capitalised words) and units become typed
placeholders, all else is lower-cased. Windows of such tokens are hashed, and windows of
documents meet those of benchmark items in a hash join. Matching windows that lie on one
diagonal (same distance between document and item) form a run, and what its
placeholders stand for is compared: a re-parameterised question maps each value of the
item to one value of the document, so the share of slots that keep to such a mapping
must reach `min_agreement`. Item windows with more placeholders than words are matched by
their exact lower-cased words instead, in runs like the others. A document leaks an item if consistent runs cover
`min_words` of its words (or the whole of a shorter item).

The side of the items is an index of at most `index_words` words, broadcast; a larger
benchmark is cut into blocks of items by id, each joined with all documents in turn.
Documents are never moved.

Defined results: NULL, blank and wordless texts leak nothing; items of fewer than
`min_item` words, NULL items among them, are never leaked; windows with more
placeholders than words are evidence only where they are copied word by word; of equally long runs the first counts;
repeated rows give rows each; NULL ids stay NULL; empty tables give no rows. Other
columns pass through `mark` and are not read by `leaks`.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import ship_by_value
from tallymark.llm.common import mix64, spans, windows, word_batch

ship_by_value(__name__)

WINDOW = 8
MIN_WORDS = 13
MIN_ITEM = 4
MIN_AGREEMENT = 0.8
INDEX_WORDS = 1 << 20
#: Words whose canonical form a task remembers before it starts afresh.
REMEMBERED = 200_000
FILTER_BITS = 22

#: Fixed word lists.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "billion half twice dozen".split()
)
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces "
    "pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours "
    "day days week weeks month months year years cent cents dollar dollars euro euros usd eur gbp percent % "
    "degree degrees celsius fahrenheit kelvin meter meters metre metres kilometer kilometers kilometre kilometres "
    "centimeter centimeters kmh kph mph volt volts watt watts joule joules newton newtons hz khz mhz ghz".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:[a-z%°]{0,3})")
WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3


def canonical(word: str) -> tuple[str, int, str]:
    """Canonical token, its kind, and the value that a placeholder stands for. An empty
    token means that the word does not count."""
    core = word.strip("\"'`.,;:!?()[]{}<>«»“”‘’„…*_#|~-–—")
    if not core:
        return "", WORD, ""
    low = core.lower()
    if _NUMBER.fullmatch(low) or low in NUMBER_WORDS:
        return "\x00n", NUMBER, low
    if low in UNITS:
        return "\x00u", UNIT, low
    if core[0].isupper() and core[1:] == low[1:]:
        return "\x00p", NAME, low
    return low, WORD, low


class Canon:
    """Canonical forms of words, remembered."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int, str, int]] = {}

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Hash and kind of each token, text offsets, values by code, the codes, and the
        hash of each token's value."""
        batch = word_batch(texts, lower=False)
        words = batch.words.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = [word for word in words if word not in self.known]
        forms = [canonical(word) for word in new]
        hashes = mix64(pd.util.hash_array(np.array([f for f, _, _ in forms], dtype=object), categorize=False))
        exact = mix64(pd.util.hash_array(np.array([v for _, _, v in forms], dtype=object), categorize=False))
        both = zip(hashes.tolist(), exact.tolist(), strict=True) if new else []
        for word, form, (one, own) in zip(new, forms, both, strict=True):
            self.known[word] = (one, form[1] if form[0] else -1, form[2], own)
        found = [self.known[word] for word in words]
        hashed = np.array([one for one, _, _, _ in found], np.uint64)
        kinds = np.array([kind for _, kind, _, _ in found], np.int8)
        values = np.array([own for _, _, _, own in found], np.uint64)
        real = (kinds >= 0)[batch.codes] if len(words) else np.zeros(0, bool)
        offsets = np.concatenate([[0], np.cumsum(real)])[batch.offsets]
        codes = batch.codes[real]
        return (
            hashed[codes] if len(words) else np.zeros(0, np.uint64),
            kinds[codes] if len(words) else np.zeros(0, np.int8),
            offsets,
            [value for _, _, value, _ in found],
            codes,
            values[codes] if len(words) else np.zeros(0, np.uint64),
        )


@dataclass
class Index:
    """Windows of a block of items, sorted by hash, for each window length in use, by
    canonical forms or (True) by exact words."""

    items: list
    sizes: np.ndarray
    offsets: np.ndarray
    kinds: np.ndarray
    values: list[str]
    by_length: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def build_index(items: list, texts: list[str | None], window: int = WINDOW, min_item: int = MIN_ITEM) -> Index:
    hashes, kinds, offsets, words, codes, exact = Canon().tokens(pa.array(texts, pa.large_string()))
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(items)), sizes)
    by_length = {}
    lengths = np.minimum(sizes, window)
    for length in sorted({int(n) for n in lengths if n >= min_item}):
        for dense in (False, True):
            value, start = windows(exact if dense else hashes, offsets, length)
            item = owner[start]
            words_in = np.concatenate([[0], np.cumsum(kinds == WORD)])
            plain = words_in[start + length] - words_in[start]
            good = (lengths[item] == length) & ((2 * plain < length) == dense)
            value, start, item = value[good], start[good], item[good]
            if dense and not len(value):
                continue
            rank = np.argsort(value, kind="stable")
            hit = np.zeros(1 << FILTER_BITS, bool)
            hit[(value & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
            by_length[length, dense] = (value[rank], item[rank], (start - offsets[item])[rank], hit)
    return Index(items, sizes, offsets, kinds, [words[c] for c in codes], by_length)


Leak = tuple[int, int, int, int, str, float]


def find(index: Index, canon: Canon, texts: pa.Array, min_words: int, min_agreement: float) -> Iterator[Leak]:
    """(text, item, first word, words, kind, agreement) of each leaked item."""
    hashes, kinds, offsets, words, codes, exact = canon.tokens(texts)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    runs: dict[tuple[int, int, int], set[int]] = defaultdict(set)
    for (length, dense), (keys, item, place, hit) in index.by_length.items():
        value, start = windows(exact if dense else hashes, offsets, length)
        near = hit[(value & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)]
        value, start = value[near], start[near]
        low, high = np.searchsorted(keys, value, "left"), np.searchsorted(keys, value, "right")
        for a, b, at in zip(low.tolist(), high.tolist(), start.tolist(), strict=True):
            for k in range(a, b):
                position = int(place[k])
                runs[int(owner[at]), int(item[k]), at - position].update(range(position, position + length))
    best: dict[tuple[int, int], Leak] = {}
    for (text, item, shift), covered in sorted(runs.items()):
        if len(covered) < min(min_words, int(index.sizes[item])):
            continue
        base = int(index.offsets[item])
        slots: dict[tuple[int, str], dict[str, int]] = defaultdict(lambda: defaultdict(int))
        equal = True
        for position in covered:
            if index.kinds[base + position] != WORD:
                mine, theirs = words[codes[shift + position]], index.values[base + position]
                slots[int(index.kinds[base + position]), theirs][mine] += 1
                equal = equal and mine == theirs
        total = sum(sum(said.values()) for said in slots.values())
        agreement = sum(max(said.values()) for said in slots.values()) / total if total else 1.0
        if agreement < min_agreement:
            continue
        first = shift + min(covered) - int(offsets[text])
        leak = (text, item, first, len(covered), "exact" if equal else "template", agreement)
        if (text, item) not in best or best[text, item][3] < len(covered):
            best[text, item] = leak
    yield from (best[key] for key in sorted(best))


def _indexes(benchmark: DataFrame, item_id: str, text: str, index_words: int) -> Iterator[Index]:
    """Blocks of items of about `index_words` words, one after another."""
    items = benchmark.select(F.col(item_id).alias("item"), F.col(text).alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    parts = max(1, -(-total // index_words))
    for part in range(parts):
        block = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).toArrow()
        yield build_index(block["item"].to_pylist(), block["text"].to_pylist())


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = MIN_WORDS,
    min_agreement: float = MIN_AGREEMENT,
    index_words: int = INDEX_WORDS,
) -> DataFrame:
    """One row for each document and item it leaks."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "item_id", "first_word", "n_words", "item_words", "kind", "agreement"]

    def against(index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            canon, index = Canon(), shared.value
            for frame in frames:
                for low, high in spans(frame.column(1)):
                    ids = frame.column(0).slice(low, high - low)
                    found = list(find(index, canon, frame.column(1).slice(low, high - low), min_words, min_agreement))
                    if not found:
                        continue
                    text, item, first, n, kind, agreement = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(text)),
                            pa.array([index.items[i] for i in item], pa.int64()),
                            pa.array(first, pa.int64()),
                            pa.array(n, pa.int64()),
                            pa.array(index.sizes[list(item)].astype(np.int64)),
                            pa.array(kind),
                            pa.array(agreement),
                        ],
                        names,
                    )

        return source.mapInArrow(
            read,
            "doc_id long, item_id long, first_word long, n_words long, item_words long, kind string, agreement double",
        )

    parts = [against(index) for index in _indexes(benchmark, item_id, item_text, index_words)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = MIN_WORDS,
    min_agreement: float = MIN_AGREEMENT,
    index_words: int = INDEX_WORDS,
    into: str = "n_leaks",
) -> DataFrame:
    """docs with a column `into`, the number of items a document leaks."""
    out = docs.drop(into).withColumn(into, F.lit(0).cast("bigint"))
    for index in _indexes(benchmark, item_id, item_text, index_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        place = out.columns.index(text)

        def read(frames: Iterator[pa.RecordBatch], shared=shared, place=place) -> Iterator[pa.RecordBatch]:
            canon, index = Canon(), shared.value
            for frame in frames:
                more = np.zeros(frame.num_rows, np.int64)
                for low, high in spans(frame.column(place)):
                    part = frame.column(place).slice(low, high - low)
                    for leak in find(index, canon, part, min_words, min_agreement):
                        more[low + leak[0]] += 1
                count = pa.array(frame.column(frame.num_columns - 1).to_numpy() + more)
                yield pa.RecordBatch.from_arrays([*frame.columns[:-1], count], frame.schema.names)

        out = out.mapInArrow(read, T.StructType(out.schema.fields))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Query: all leaks of the benchmark."""
    return leaks(docs, benchmark)
