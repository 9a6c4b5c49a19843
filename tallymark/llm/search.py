"""Ranked lexical search, reversed: documents stream through an index of the items.

Few items are asked of many documents, so the index is built over the items' terms and
broadcast, and the documents pass by it once scored:

* items are taken in blocks of about `index_terms` terms (counted before anything is
  fetched), so what reaches the driver and what is broadcast are bounded however many items
  there are, but for a single longer item;
* documents are split into terms once, for all blocks: a written table of blocks of
  documents holds their term counts against the block's own distinct terms (only those of
  the items where they are one block);
* N, L and the items' document frequencies are exact sums over that table;
* each task streams its documents' counts through the inverted index (term -> items with
  repeats) and updates a heap of `k` places per item. A document enters a heap only when it
  beats the heap's last place. Heaps are merged twice, over slices of tasks and then per
  item, by (score, doc_id).

All but a term's weight is integer arithmetic in 64 bits: a document's m, its terms'
saturated counts and the sums. Scores of a chunk of documents are gathered per document
and item, never as pairs over the corpus.

Defined results: NULL and blank texts have no terms and neither count nor rank; nor do items
without terms. Every row is a document, repeated ids and texts rank apart; among equal
scores NULL ids come last. Repeated items with one id and text are one item; one id with
two texts is two items, ranked apart. Fewer rows than `k` come out where fewer documents
score above 0, none for empty tables. Texts of any length are whole. Other columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions import ship_by_value
from tallymark.llm.common import WordBatch, packed_ints, spans, unpacked_ints, word_batch, written

ship_by_value(__name__)

PLACES = 10
INDEX_TERMS = 1 << 20
#: Entries of the score table of a chunk of documents.
CHUNK_SCORES = 1 << 19
#: A document's m is 100 - 75 + 75 n N div L (fixed by the tables' contract).
BASE, SLOPE = 25, 75

#: What each byte of a text becomes: ASCII letters in lower case and digits stay, other
#: ASCII separates terms, bytes of larger code points stay.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 0x20
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def term_batch(texts: pa.Array) -> WordBatch:
    """Terms of every text; NULL texts have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    folded = pa.LargeStringArray.from_buffers(
        len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(_FOLD[raw].tobytes())
    )
    return word_batch(folded, lower=False)


@dataclass
class Counts:
    """Terms of a block of documents: document `owner` holds term `code` `tf` times."""

    owner: np.ndarray
    code: np.ndarray
    tf: np.ndarray
    sizes: np.ndarray


def count_terms(batch: WordBatch) -> Counts:
    key, tf = np.unique(batch.owner * np.int64(max(1, len(batch.words))) + batch.codes, return_counts=True)
    owner, code = np.divmod(key, np.int64(max(1, len(batch.words))))
    return Counts(owner, code, tf, batch.sizes)


def count_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: pa.Array | None = None
) -> DataFrame:
    """Written blocks of documents: how many have a term, and how many terms those have;
    of documents with a term (of the vocabulary, if given) ids and numbers n of all terms;
    distinct terms with their document frequencies in the block; and the counts packed:
    terms per document, code and tf of each."""
    wanted = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(vocabulary.to_pylist())

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else pa.array(wanted.value, pa.large_string())
        for frame in frames:
            for low, high in spans(frame.column(1)):
                batch = term_batch(frame.column(1).slice(low, high - low))
                counts = count_terms(batch)
                if not len(counts.code):
                    continue
                owner, code, tf = counts.owner, counts.code, counts.tf
                if known is not None:
                    here = pc.is_in(batch.words, known).to_numpy(zero_copy_only=False)[code]
                    owner, code, tf = owner[here], code[here], tf[here]
                used = np.bincount(code, minlength=len(batch.words))
                real = np.flatnonzero(used)
                each = np.bincount(owner, minlength=len(batch))
                held = np.flatnonzero(each)
                ids = frame.column(0).slice(low, high - low).take(pa.array(held))
                packed = [each[held], (np.cumsum(used > 0) - 1)[code], tf]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int((counts.sizes > 0).sum())], pa.int64()),
                        pa.array([int(counts.sizes.sum())], pa.int64()),
                        pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                        pa.array([counts.sizes[held].tolist()], pa.list_(pa.int64())),
                        pa.array([batch.words.take(pa.array(real)).to_pylist()], pa.list_(pa.string())),
                        pa.array([used[real].tolist()], pa.list_(pa.int64())),
                        *[pa.array([packed_ints(p)], pa.binary()) for p in packed],
                    ],
                    ["documents", "length", "ids", "sizes", "terms", "df", "each", "code", "tf"],
                )

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = (
        "documents long, length long, ids array<long>, sizes array<long>, terms array<string>, df array<long>,"
        " each binary, code binary, tf binary"
    )
    return written(source.mapInArrow(read, schema), "counts")


@dataclass
class Index:
    """Inverted index of a block of items: term t is held by items[starts[t]:starts[t + 1]],
    repeats[...] times."""

    ids: list
    terms: pa.Array
    starts: np.ndarray
    items: np.ndarray
    repeats: np.ndarray


def build_index(ids: list, texts: list) -> Index:
    batch = term_batch(pa.array(texts, pa.large_string()))
    counts = count_terms(batch)
    order = np.argsort(counts.code, kind="stable")
    starts = np.searchsorted(counts.code[order], np.arange(len(batch.words) + 1))
    return Index(ids, batch.words, starts, counts.owner[order], counts.tf[order])


def item_blocks(items: DataFrame, item_id: str, text: str, index_terms: int) -> tuple[int, Iterator[Index]]:
    """Number of blocks of whole items of about `index_terms` terms, and these one after
    another."""
    wanted = (
        items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
        .filter("text is not null")
        .distinct()
    )
    # A term has a character and a separator at least.
    total = wanted.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-(total // 2) // index_terms))

    def fetched() -> Iterator[Index]:
        for part in range(parts):
            block = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).toArrow()
            yield build_index(block["item_id"].to_pylist(), block["text"].to_pylist())

    return parts, fetched()


class Heaps:
    """The best k documents of each item: rows hold scores in falling order, ids and
    whether there is an id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = np.zeros((items, k), np.int64)
        self.id = np.zeros((items, k), np.int64)
        self.missing = np.zeros((items, k), bool)

    def update(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """scores: one row per document, a column per item."""
        last = self.score[:, -1]
        # Equal scores may still win by their id.
        places, rivals = np.nonzero((scores >= np.maximum(last, 1)).T)
        if not len(places):
            return
        value = scores[rivals, places]
        filled, slot = np.nonzero(self.score)
        item = np.concatenate([filled, places])
        score = np.concatenate([self.score[filled, slot], value])
        name = np.concatenate([self.id[filled, slot], ids[rivals]])
        gone = np.concatenate([self.missing[filled, slot], missing[rivals]])
        order = np.lexsort([name, gone, -score, item])
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order, item, rank = order[rank < self.k], item[rank < self.k], rank[rank < self.k]
        self.score[item, rank], self.id[item, rank], self.missing[item, rank] = score[order], name[order], gone[order]


def weights(n: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) in doubles."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def _search_block(counted: DataFrame, index: Index, documents: int, length: int, k: int) -> DataFrame:
    spark = counted.sparkSession
    # Only the items' terms come back with their document frequencies.
    terms = spark.createDataFrame(pa.table({"term": index.terms.cast(pa.string())}))
    frequencies = (
        counted.select(F.explode(F.arrays_zip("terms", "df")).alias("t"))
        .select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
        .join(F.broadcast(terms), "term", "left_semi")
        .groupBy("term")
        .agg(F.sum("df").alias("df"))
        .toArrow()
    )
    found = pc.index_in(index.terms.cast(pa.string()), frequencies["term"].combine_chunks())
    df = pc.fill_null(frequencies["df"].combine_chunks().take(found), 0).to_numpy(zero_copy_only=False)
    shared = spark.sparkContext.broadcast(
        (index.terms.to_pylist(), index.starts, index.items, index.repeats, weights(documents, df), len(index.ids))
    )

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, starts, items, repeats, weight, n_items = shared.value
        names = pa.array(names, pa.string())
        heaps = Heaps(n_items, k)
        for frame in frames:
            for row in range(frame.num_rows):
                ids = frame["ids"][row].values
                if not len(ids):
                    continue
                n = frame["sizes"][row].values.to_numpy().astype(np.int64)
                # Products of 64 bits; Python's own integers where they would not fit.
                if int(n.max()) * SLOPE * documents < 2**63:
                    m = BASE + (SLOPE * n * np.int64(documents)) // np.int64(length)
                else:
                    m = np.array([BASE + SLOPE * x * documents // length for x in n.tolist()], np.int64)
                term = pc.fill_null(pc.index_in(frame["terms"][row].values, names), -1).to_numpy().astype(np.int64)
                each, code, tf = (unpacked_ints(frame[c][row].as_py()).astype(np.int64) for c in ("each", "code", "tf"))
                owner, term = np.repeat(np.arange(len(n)), each), term[code]
                known = (term >= 0) & (weight[term] > 0)
                owner, tf, term = owner[known], tf[known], term[known]
                gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
                missing = ids.is_null().to_numpy(zero_copy_only=False)
                name = pc.fill_null(ids, 0).to_numpy().astype(np.int64)
                for low, high in _chunks(owner, starts[term + 1] - starts[term], len(name), n_items):
                    a, b = np.searchsorted(owner, [low, high])
                    scores = _scores(owner[a:b] - low, term[a:b], gain[a:b], starts, items, repeats, high - low, n_items)
                    heaps.update(scores, name[low:high], missing[low:high])
        item, slot = np.nonzero(heaps.score)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(item.astype(np.int64)),
                pa.array(heaps.id[item, slot], mask=heaps.missing[item, slot]),
                pa.array(heaps.score[item, slot]),
            ],
            ["item", "doc_id", "score"],
        )

    best = counted.mapInArrow(read, "item long, doc_id long, score long")
    # Heaps of the tasks of a slice meet first, then those of the slices.
    width = max(1, math.isqrt(counted.rdd.getNumPartitions()))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    sliced = best.withColumn("slice", (F.spark_partition_id() / width).cast("int"))
    local = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("item", "slice").orderBy(*order)))
    whole = Window.partitionBy("item").orderBy(*order)
    merged = local.filter(F.col("rank") <= k).withColumn("rank", F.row_number().over(whole))
    numbered = spark.createDataFrame(
        pa.table({"item": pa.array(range(len(index.ids)), pa.int64()), "item_id": pa.array(index.ids, pa.int64())})
    )
    # The block's own items, as many as its index holds.
    return merged.filter(F.col("rank") <= k).join(F.broadcast(numbered), "item").select(
        "item_id", F.col("rank").cast("int"), "doc_id", "score"
    )


def _chunks(owner: np.ndarray, postings: np.ndarray, documents: int, items: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about CHUNK_SCORES scores and postings each."""
    work = items + np.bincount(owner, postings, documents)
    part = np.cumsum(work) // CHUNK_SCORES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), documents]
    yield from zip(edges, edges[1:], strict=False)


def _scores(owner, term, gain, starts, items, repeats, documents: int, n_items: int) -> np.ndarray:
    """Sum of gain times repeats for each document and item."""
    count = starts[term + 1] - starts[term]
    first = np.repeat(starts[term] - (np.cumsum(count) - count), count)
    at = first + np.arange(int(count.sum()))
    cell = np.repeat(owner * n_items, count) + items[at]
    value = np.repeat(gain, count) * repeats[at]
    if int(value.max(initial=0)) * max(1, len(value)) < 2**53:
        # Sums of doubles are exact below that.
        flat = np.bincount(cell, value, documents * n_items).astype(np.int64)
    else:
        flat = np.zeros(documents * n_items, np.int64)
        np.add.at(flat, cell, value)
    return flat.reshape(documents, n_items)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = PLACES,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    index_terms: int = INDEX_TERMS,
) -> DataFrame:
    """The k best documents of every item: item_id, rank, doc_id, score."""
    parts, indexes = item_blocks(items, item_id, item_text, index_terms)
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    counted = totals = None
    for index in indexes:
        if counted is None:
            # A single block needs the counts of its own terms alone.
            counted = count_documents(docs, doc_id, text, index.terms if parts == 1 else None)
            totals = counted.agg(F.sum("documents").alias("documents"), F.sum("length").alias("length")).first()
        if totals["documents"] and len(index.terms):
            out = out.unionByName(_search_block(counted, index, totals["documents"], totals["length"], k))
    return out


def ranked_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Query: the ten best documents of each benchmark item."""
    return search(docs, items)


#: The same ranking by joins over exploded terms.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
t AS (SELECT r, doc_id, unnest(terms) AS term FROM d),
c AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY r, doc_id, term),
s AS (SELECT r, sum(tf)::BIGINT AS n FROM c GROUP BY r),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM s),
f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
b AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL),
q AS (
  SELECT item_id, text,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM b),
i AS (SELECT item_id, text, term, count(*) AS repeats FROM q GROUP BY item_id, text, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM f, g),
p AS (
  SELECT i.item_id, i.text, c.doc_id, c.r,
         (sum(i.repeats * w.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (25 + (75 * s.n * g.docs) // g.total)))))::BIGINT AS score
  FROM i JOIN w ON i.term = w.term JOIN c ON c.term = i.term JOIN s ON s.r = c.r, g
  GROUP BY i.item_id, i.text, c.doc_id, c.r),
o AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM p WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 10
"""
