"""Repeated passages by sparse suffix arrays.

Suffixes are kept only where a word k-gram is the smallest of its `window` k-grams in
hash order (minimisers): the choice depends on the words around alone, so two equal
passages of at least window + gram - 1 words keep a suffix at the same place. A kept
suffix carries its next `min_words` words and the `window` words before it, as 16-bit
word hashes. All suffixes are sorted by what follows, then by what precedes from near
to far, over range partitions that also split equal suffixes; each is compared with its
`reach` nearest neighbours on either side, and the match extended to the right and left. Matches of `min_words`
words and more count; those that overlap in a document make up one passage, so passages
of any length come out whole though each suffix carries a bounded piece. The suffixes at
the ends of partitions are sorted and compared once more.

Where more than `reach` suffixes in a row begin with the same words (as many as any match
has after its suffix, min_words - window), partners can lie farther apart. Such suffixes,
and those at the ends of partitions, also give a hash of each `min_words`-word window that
has its minimiser there (one suffix a window, about ten windows a suffix). Hashes are
counted, and windows not matched yet whose hash occurs again are pieces as well: what is
found does not depend on the order.

Boundaries rest on 16-bit hashes: a passage may come out a word too long with
probability 2^-16 a side; false passages would need 50 such words in a row.

Defined results: NULL, blank and short texts have no passages; repeats within one
document count; repeated rows are copies, and give the passage of their id and text once;
ties in the order go by text, id and place; NULL ids stay NULL; an empty table gives no
rows. Texts of any length are taken whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions import ship_by_value
from tallymark.llm.common import mix64, spans, windows, word_batch, written

ship_by_value(__name__)

MIN_WORDS = 50
GRAM = 8
WINDOW = 40
#: Neighbours on each side that a suffix is compared with.
REACH = 8
#: Parts that the windows of a hash are spread over when they are looked up.
SALT = 16
NAMES = ["after", "before", "n_after", "n_before", "doc_id", "row", "place", "near", "far"]
#: near, far: words before the suffix in the windows of which it is the minimiser.
SUFFIX = "after binary, before binary, n_after int, n_before int, doc_id long, row long, place long, near int, far int"
FOUND = SUFFIX + ", start long, stop long, windows binary"
TYPES = [pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def minimisers(hashes: np.ndarray, offsets: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the smallest k-gram (the first of equals) of every full window, and how
    far before it the last and the first of its windows begin."""
    value, start = windows(hashes, offsets, gram)
    if len(value) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(value, window)
    # All k-grams of a window lie in one text if its first and last are that far apart.
    ends = np.repeat(offsets[1:], np.diff(offsets))
    whole = np.flatnonzero((start[window - 1 :] - start[: len(view)] == window - 1) & (ends[start[: len(view)]] >= start[window - 1 :] + gram))
    chosen = [view[whole[i : i + 65536]].argmin(axis=1) + whole[i : i + 65536] for i in range(0, len(whole), 65536)]
    # The windows of a place follow each other.
    places, first, n = np.unique(np.concatenate([np.zeros(0, np.int64), *chosen]), return_index=True, return_counts=True)
    far = start[places] - start[whole[first]]
    return start[places], far - n + 1, far


def suffixes(docs: DataFrame, doc_id: str, text: str, min_words: int, gram: int, window: int) -> DataFrame:
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for low, high in spans(frame.column(2)):
                batch = word_batch(frame.column(2).slice(low, high - low))
                hashes, offsets = batch.hashes(), batch.offsets
                places, near, far = minimisers(hashes, offsets, gram, window)
                short = (hashes >> np.uint64(48)).astype(">u2")
                owner = batch.owner[places] if len(places) else places
                after = np.minimum(offsets[owner + 1] - places, min_words)
                before = np.minimum(places - offsets[owner], window)

                def around(step: np.ndarray, count: np.ndarray, places=places, short=short) -> pa.Array:
                    at = np.clip(places[:, None] + step, 0, max(len(short) - 1, 0))
                    words = np.where(np.arange(len(step)) < count[:, None], short[at], 0).astype(">u2")
                    ends = np.arange(len(places) + 1, dtype=np.int32) * (2 * len(step))
                    return pa.Array.from_buffers(
                        pa.binary(), len(places), [None, pa.py_buffer(ends), pa.py_buffer(words.tobytes())]
                    )

                if len(places):
                    yield pa.RecordBatch.from_arrays(
                        [
                            around(np.arange(min_words), after),
                            around(-1 - np.arange(window), before),
                            pa.array(after.astype(np.int32)),
                            pa.array(before.astype(np.int32)),
                            frame.column(0).slice(low, high - low).take(pa.array(owner)),
                            frame.column(1).slice(low, high - low).take(pa.array(owner)),
                            pa.array(places - offsets[owner]),
                            pa.array(near.astype(np.int32)),
                            pa.array(far.astype(np.int32)),
                        ],
                        NAMES,
                    )

    return source.mapInArrow(cut, SUFFIX)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(len(column), width)


def _common(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words that each row shares with the row before it, from the first on."""
    differ = words[1:] != words[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1])
    return np.minimum(first, np.minimum(counts[1:], counts[:-1]))


def _window_hashes(frame: pa.RecordBatch, min_words: int, window: int) -> pa.Array:
    """For each row the 64-bit hashes of its windows, the farthest first."""
    n_after, near, far = (frame.column(i).to_numpy().astype(np.int64) for i in (2, 7, 8))
    around = np.concatenate([_matrix(frame.column(1), window)[:, ::-1], _matrix(frame.column(0), min_words)], axis=1)
    step = np.uint64(0x9E3779B97F4A7C15)
    power = np.cumprod(np.full(around.shape[1], step, np.uint64))
    back = np.cumprod(np.full(around.shape[1], pow(int(step), -1, 1 << 64), np.uint64))
    mixed = mix64(around.astype(np.uint64) + np.uint64(1)) * power
    sums = np.concatenate([np.zeros((len(mixed), 1), np.uint64), np.cumsum(mixed, axis=1, dtype=np.uint64)], axis=1)
    hashed = mix64((sums[:, min_words:] - sums[:, : window + 1]) * back[: window + 1])
    before = window - np.arange(window + 1)
    # A window ends within its text.
    valid = (before <= far[:, None]) & (before >= np.maximum(near, min_words - n_after)[:, None])
    ends = np.concatenate([[0], 8 * np.cumsum(valid.sum(axis=1))]).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(hashed[valid].astype("<u8").tobytes())]
    )


def matched(ordered: DataFrame, min_words: int, window: int, reach: int, ends: bool) -> DataFrame:
    """Rows of sorted partitions that match one of their `reach` neighbours on either
    side: start and stop of the match. With `ends` also the first and last `reach` rows
    of each partition, with start -1. Rows with many like them around, and without `ends`
all rows, come with the hashes of their windows (those with start -1 do without)."""

    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        held_r = held_l = np.zeros(0, np.int64)
        held_hot = np.zeros(0, bool)
        heads = done = 0

        def rows(
            batch: pa.RecordBatch,
            pick: np.ndarray,
            start: np.ndarray,
            stop: np.ndarray,
            words: bool = False,
            hot: np.ndarray | None = None,
        ) -> pa.RecordBatch:
            """Matches go on without the words around them."""
            rest = pa.RecordBatch.from_arrays(batch.columns[2:], NAMES[2:]).take(pa.array(pick))
            around = [c.take(pa.array(pick)) if words else pa.nulls(len(pick), pa.binary()) for c in batch.columns[:2]]
            listed = pa.nulls(len(pick), pa.binary())
            if hot is not None and hot.any():
                hashed = _window_hashes(batch.take(pa.array(np.flatnonzero(hot))), min_words, window)
                at = np.cumsum(hot) - 1
                listed = hashed.take(pa.array(at[pick], mask=~hot[pick]))
            return pa.RecordBatch.from_arrays(
                [*around, *rest.columns, pa.array(start, pa.int64()), pa.array(stop, pa.int64()), listed],
                [*NAMES, "start", "stop", "windows"],
            )

        def finished(batch: pa.RecordBatch, r: np.ndarray, l: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
            pick = np.flatnonzero((r + l > 0) | hot)
            place = batch.column(6).to_numpy()[pick]
            return rows(batch, pick, place - l[pick], place + r[pick], hot=hot)

        def edge(batch: pa.RecordBatch) -> pa.RecordBatch:
            none = np.full(batch.num_rows, -1)
            return rows(batch, np.arange(batch.num_rows), none, none, words=True)

        for frame in frames:
            if ends and heads < reach and frame.num_rows:
                yield edge(frame.slice(0, reach - heads))
                heads += frame.num_rows
            old = len(held_r)
            if held is not None:
                frame = pa.Table.from_batches([held, frame.cast(held.schema)]).combine_chunks().to_batches()[0]
            n = frame.num_rows
            n_after, n_before = frame.column(2).to_numpy(), frame.column(3).to_numpy()
            left = _matrix(frame.column(1), window)
            most_r = np.append(held_r, np.zeros(n - old, np.int64))
            most_l = np.append(held_l, np.zeros(n - old, np.int64))
            hot = np.append(held_hot, np.zeros(n - old, bool))
            next_to = _common(_matrix(frame.column(0), min_words), n_after)
            shared = next_to
            for far in range(1, min(reach, n - 1) + 1):
                # What a row shares with a farther one is the least on the way.
                shared = shared if far == 1 else np.minimum(shared[:-1], next_to[far - 1 :])
                i = np.arange(max(0, old - far), n - far)
                if far == reach:
                    run = i[shared[i] >= min_words - window]
                    for step in range(reach + 1):
                        hot[run + step] = True
                lacking = (most_r < n_after) | (most_l < n_before)
                i = i[(shared[i] >= min_words - window) & (lacking[i] | lacking[i + far])]
                differ = left[i] != left[i + far]
                first = np.where(differ.any(axis=1), differ.argmax(axis=1), window)
                l = np.minimum(first, np.minimum(n_before[i], n_before[i + far]))
                good = shared[i] + l >= min_words
                i, l = i[good], l[good]
                for side in (i, i + far):
                    most_r[side] = np.maximum(most_r[side], shared[i])
                    most_l[side] = np.maximum(most_l[side], l)
            keep = max(0, n - reach)
            # Rows at the ends come with the others of `edges`.
            listed = hot[:keep] & (np.arange(done, done + keep) >= reach) if ends else np.ones(keep, bool)
            yield finished(frame.slice(0, keep), most_r[:keep], most_l[:keep], listed)
            done += keep
            held, held_r, held_l, held_hot = frame.slice(keep), most_r[keep:], most_l[keep:], hot[keep:]
        if held is not None:
            yield finished(held, held_r, held_l, np.full(held.num_rows, not ends))
            if ends:
                yield edge(held)

    return ordered.mapInArrow(compare, FOUND)


def repeated_windows(found: DataFrame, min_words: int) -> DataFrame:
    """row, doc_id, start, stop of windows that no neighbour matched but whose hash comes
    again. Every window of a text has one suffix, so equal hashes are two places."""

    def unpack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for low in range(0, frame.num_rows, 8192):
                part = frame.slice(low, 8192)
                lists = part.column(6).to_pylist()
                n = np.fromiter((len(one) // 8 for one in lists), np.int64, len(lists))
                doc, row, place, far, start, stop = (part.column(i) for i in range(6))
                owner = np.repeat(np.arange(len(n)), n)
                begin = (place.to_numpy() - far.to_numpy())[owner] + np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
                lacks = (begin < start.to_numpy()[owner]) | (begin + min_words > stop.to_numpy()[owner])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(b"".join(lists), "<i8")),
                        row.take(pa.array(owner)),
                        doc.take(pa.array(owner)),
                        pa.array(begin),
                        pa.array(lacks),
                    ],
                    ["hash", "row", "doc_id", "start", "lacks"],
                )

    listed = found.filter("windows is not null").select("doc_id", "row", "place", "far", "start", "stop", "windows")
    each = listed.mapInArrow(unpack, "hash long, row long, doc_id long, start long, lacks boolean")
    counted = each.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("lacks").alias("lacks"))
    # Written, so that a small table is known to be small.
    again = written(counted.filter("n > 1 and lacks").select("hash"), "windows")
    parts = again.select("hash", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part"))
    salted = each.filter("lacks").withColumn("part", F.pmod(F.xxhash64("row", "doc_id", "start"), F.lit(SALT)).cast("int"))
    return salted.join(parts, ["hash", "part"]).select("row", "doc_id", "start", (F.col("start") + min_words).alias("stop"))


ORDER = ["after", "before", "row", "doc_id", "place"]


def repeated_passages(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_words: int = MIN_WORDS,
    gram: int = GRAM,
    window: int = WINDOW,
    reach: int = REACH,
) -> DataFrame:
    """doc_id, row (xxhash64 of the text), first_word, stop_word, n_words of every
    passage that stands elsewhere as well."""
    if window + gram - 1 > min_words:
        raise ValueError("a passage of min_words must hold a whole window of k-grams")
    cut = suffixes(docs, doc_id, text, min_words, gram, window)
    ordered = cut.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    found = written(matched(ordered, min_words, window, reach, True), "matches")
    # 2 * reach rows for each partition; those of tiny partitions are there twice.
    edges = found.filter("start < 0").select(*NAMES).distinct().repartition(1).sortWithinPartitions(*ORDER)
    seams = written(matched(edges, min_words, window, reach, False), "seams")
    all_found = found.filter("start >= 0").unionByName(seams)
    pieces = (
        all_found.filter("stop > start")
        .select("row", "doc_id", "start", "stop")
        .unionByName(repeated_windows(all_found, min_words))
        .groupBy("row", "doc_id", "start")
        .agg(F.max("stop").alias("stop"))
    )
    # Overlapping pieces of a text are one passage.
    text_order = Window.partitionBy("row", "doc_id").orderBy("start")
    reached = F.max("stop").over(text_order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") <= reached, 0).otherwise(1)
    numbered = pieces.withColumn("_fresh", fresh).withColumn("_passage", F.sum("_fresh").over(text_order))
    return (
        numbered.groupBy("row", "doc_id", "_passage")
        .agg(F.min("start").alias("first_word"), F.max("stop").alias("stop_word"))
        .select("doc_id", "row", "first_word", "stop_word", (F.col("stop_word") - F.col("first_word")).alias("n_words"))
    )


def repeats(docs: DataFrame) -> DataFrame:
    """Query: repeated passages of 50 words and more."""
    return repeated_passages(docs).drop("row")
