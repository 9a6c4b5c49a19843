"""Language identification by bit-sliced Bloom filters over character 3-grams.

Training counts every 3-gram (letters lower-cased, everything else one blank) per
language over all training texts. A language's filter holds the 3-grams that make up at
least `min_share` of its 3-grams and are not `rival` times as frequent in another
language, so a filter holds at most 1 / min_share entries whatever the corpus size. The
filters are bit-sliced: position p of the table holds one bit per language, and the
bitwise AND of the rows at a 3-gram's positions names all languages that contain it.

A text's votes are popcounts per language. A filter with fill f answers wrongly with
probability f^k, so a count h over n 3-grams becomes (h - n f^k) / (1 - f^k). The
largest corrected count decides; its share of n is the score.

Defined results: NULL texts and texts without a letter are `und` with score 0; with
letters but no known 3-gram the first learned language with score 0; ties go to the
first language in order; without training rows everything is `und`. Repeated rows are
judged alike; an empty table gives no rows; further columns pass through unless they
bear the name of a result column, which then replaces them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import ship_by_value
from tallymark.llm.common import fold, give_back, mix64, spans, written

ship_by_value(__name__)

UND = "und"
MIN_SHARE = 2.0**-14
RIVAL = 4.0
POSITIONS = 1 << 18
HASHES = 3
#: One signed 64-bit number holds the bits of so many languages.
PER_WORD = 63
#: Counts that a task holds before it sums them up, and passes them on if they stay many.
HELD_ENTRIES = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """3-grams of all texts as 63-bit numbers (three code points, so exact), where each
    text's begin (one more entry than texts), and whether a text has a letter."""
    lowered = [(text or "").lower() for text in texts]
    sizes = np.fromiter((len(text) for text in lowered), np.int64, len(lowered))
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    letter = _letters()[points]
    points = np.where(letter, points, 32)
    keep = letter | np.concatenate([[True], letter[:-1]])
    keep[starts[:-1]] = True
    position = np.concatenate([[0], np.cumsum(keep)])[starts]
    kept = points[keep]
    # A blank stands before the first letter of the batch; each text ends in a blank.
    line = np.concatenate([[32], kept, [32]])
    grams = (line[:-2] << 42) | (line[1:-1] << 21) | line[2:]
    real = line[1:-1] != 32
    begin = np.concatenate([[0], np.cumsum(real)])[position]
    counts = np.concatenate([[0], np.cumsum(letter)])
    has_letter = counts[starts[1:]] > counts[starts[:-1]]
    return grams[real], begin, has_letter


def _positions(grams: np.ndarray, positions: int, hashes: int) -> list[np.ndarray]:
    mixed = mix64(grams.astype(np.uint64))
    low, high = mixed & np.uint64(0xFFFFFFFF), mixed >> np.uint64(32) | np.uint64(1)
    return [((low + np.uint64(i) * high) & np.uint64(positions - 1)).astype(np.int64) for i in range(hashes)]


@dataclass
class Model:
    """Languages in order and the table of language bits: positions x words."""

    languages: list[str]
    rows: np.ndarray
    hashes: int


def gram_counts(training: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, gram, n over all training texts; tasks sum up before anything moves."""

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        entries = 0

        def summed() -> dict[str, list]:
            total = {}
            for name, parts in held.items():
                value, where = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
                n = np.bincount(where, np.concatenate([n for _, n in parts]), len(value)).astype(np.int64)
                total[name] = [(value, n)]
            return total

        def rows() -> Iterator[pa.RecordBatch]:
            for name, [(value, n)] in held.items():
                columns = [pa.array([name] * len(value), pa.string()), pa.array(value), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])

        for frame in frames:
            for low, high in spans(frame.column(1)):
                langs = frame.column(0).slice(low, high - low).to_pylist()
                grams, begin, _ = trigrams(frame.column(1).slice(low, high - low).to_pylist())
                names = sorted(set(langs))
                owner = np.repeat([names.index(x) for x in langs], np.diff(begin))
                for i, name in enumerate(names):
                    part = np.unique(grams[owner == i], return_counts=True)
                    held.setdefault(name, []).append(part)
                    entries += len(part[0])
                if entries > HELD_ENTRIES:
                    held = summed()
                    entries = sum(len(value) for [(value, _)] in held.values())
                    if entries > HELD_ENTRIES // 2:
                        yield from rows()
                        held, entries = {}, 0
        held = summed()
        yield from rows()
        held = {}
        give_back()

    rows = training.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    )
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(
    training: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_share: float = MIN_SHARE,
    rival: float = RIVAL,
    positions: int = POSITIONS,
    hashes: int = HASHES,
) -> Model:
    """The filters. Only the finished table (at most `positions` rows) reaches the driver."""
    counts = written(gram_counts(training, text, lang), "gram-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    # One row per language: as small as the list of languages.
    languages = sorted(row["lang"] for row in totals.select("lang").collect())
    words = max(1, -(-len(languages) // PER_WORD))
    if not languages:
        return Model([], np.zeros((positions, words), np.int64), hashes)
    shares = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    shares = shares.filter(F.col("share") >= min_share)
    best = shares.groupBy("gram").agg(F.max("share").alias("best"))
    number = F.create_map(*[F.lit(x) for i, name in enumerate(languages) for x in (name, i)])[F.col("lang")]
    members = (
        shares.join(best, "gram").filter(F.col("share") * rival >= F.col("best")).select("gram", number.alias("bit"))
    )

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            at = _positions(frame.column(0).to_numpy(), positions, hashes)
            bit = np.tile(frame.column(1).to_numpy(), len(at))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), pa.array(bit)], ["position", "bit"])

    slices = (
        members.mapInArrow(place, "position long, bit int")
        .groupBy("position", F.floor(F.col("bit") / PER_WORD).cast("int").alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, bit % {PER_WORD})")).alias("mask"))
    )
    rows = np.zeros((positions, words), np.int64)
    filled = slices.toArrow()
    rows[filled["position"].to_numpy(), filled["word"].to_numpy()] = filled["mask"].to_numpy()
    return Model(languages, rows, hashes)


def judge(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    grams, begin, has_letter = trigrams(texts)
    n = np.diff(begin)
    best = np.full(len(texts), -1.0)
    choice = np.zeros(len(texts), np.int64)
    if not model.languages:
        return [UND] * len(texts), np.zeros(len(texts))
    positions = len(model.rows)
    at = _positions(grams, positions, model.hashes)
    for word in range(model.rows.shape[1]):
        column = np.ascontiguousarray(model.rows[:, word])
        found = column[at[0]]
        for other in at[1:]:
            found = found & column[other]
        for bit in range(min(PER_WORD, len(model.languages) - word * PER_WORD)):
            fill = np.count_nonzero(column >> bit & 1) / positions
            wrong = min(fill**model.hashes, 0.999)
            running = np.concatenate([[0], np.cumsum(found >> bit & 1)])
            votes = running[begin[1:]] - running[begin[:-1]]
            corrected = np.maximum(votes - n * wrong, 0) / (1 - wrong)
            better = corrected > best
            choice[better], best[better] = word * PER_WORD + bit, corrected[better]
    names = [model.languages[c] if ok else UND for c, ok in zip(choice, has_letter, strict=True)]
    score = np.where(has_letter, np.minimum(best / np.maximum(n, 1), 1.0), 0.0)
    return names, np.maximum(score, 0.0)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score. The text alone decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("__text"))

    def label(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = frame.column(frame.num_columns - 1)
            parts = [judge(shared.value, texts.slice(i, j - i).to_pylist()) for i, j in spans(texts)]
            names = [name for part, _ in parts for name in part]
            score = np.concatenate([np.zeros(0), *[part for _, part in parts]])
            columns = frame.columns[:-1] + [pa.array(names, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*frame.schema.names[:-1], "lang_pred", "score"])
        give_back()

    schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in kept]).schema])
    schema = schema.add("lang_pred", T.StringType(), False).add("score", T.DoubleType(), False)
    return source.mapInArrow(label, schema)


def language_id(docs: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Query: predictions of all documents from filters learned outside fold `held`."""
    fold_of = fold("doc_id", folds)
    model = train(docs.filter(F.coalesce(fold_of != held, F.lit(True))).select("text", "lang"))
    judged = docs.select("doc_id", "text", F.coalesce(fold_of == held, F.lit(False)).alias("held_out"))
    return predict(judged, model).select("doc_id", "held_out", "lang_pred", "score")
