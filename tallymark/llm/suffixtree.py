"""Language-model scoring with a probabilistic suffix tree over words.

Tokens are lower-cased words and one end per document. The tree is learned from counts
over all training documents:

* the root has the count of every training word;
* a context of up to `depth` words is a candidate if it occurs `min_count` times or more
  in the training tokens, and so does each of its next symbols. That number is the same
  for every size of the corpus;
* a candidate is retained if the likelihood gained over its longest retained suffix,
  sum of c(s, w) ln(P(w | s) / P(w | suffix)), exceeds 1/2 ln N for each next symbol.

P(w | s) = (c(s, w) + k P(w | suffix)) / (c(s) + k) for the symbols of s; what is left
over goes to all other words in proportion to P(w | suffix), so each distribution sums
to one. At the root P(w) = (c(w) + 1) / (N + V + 1), one share for all unknown words.
A token is scored in the longest retained suffix of what precedes it in its document.

Corpus work is done on blocks: a table whose rows hold some megabytes of text as codes
into the block's own distinct words. It and the answers below are written once, in the
same buckets by block number, so that no join moves them again. A block asks and is
answered, an order at a time: first about its words, then about its contexts of k words
and the symbols after them. Questions go by key to parts; a part sums what all blocks say
of a gram, tests its contexts, and answers each block in the order in which it asked, so
that answers need no keys. Both ways travel as compressed columns of integers, one value
for each block and part, and each distinct gram of a block once. Frequent contexts are
dealt out over several parts; their sums (some 16 a part in all) are united in the driver.
Grams and contexts are told apart by 64-bit keys, as words are; frequent words have numbers
below 2^31. `grow` and `learn` make the same tree as tables and in one place, to look at.

Defined results: NULL and blank texts are the end alone; NULL ids are training documents
and not held out; repeated rows are scored and counted each; texts of any length are
whole; an empty table gives no rows; without training tokens every probability is 1 / 1.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions import ship_by_value
from tallymark.llm.common import fold, give_back, mix64, packed_ints, unpacked_ints, word_batch, written
from tallymark.session import new_shared_path

ship_by_value(__name__)

DEPTH = 2
#: Occurrences that a context and a next symbol need, in a corpus of any size.
MIN_COUNT = 2
#: Of a corpus of N tokens, counts from sqrt(N) / ROOT on: a size for which tests bound slots.
ROOT = 300.0
SMOOTHING = 16.0
BLOCK_BYTES = 4 << 20
#: Bits of a table of keys: so many for each, in chunks.
SLOTS_PER_ENTRY = 4
MOST_SLOTS = 1 << 28
CHUNK = 1 << 16
#: Packed words of the corpus that a part has a share of, and how many parts at least.
PART_BYTES = 6 << 20
LEAST_PARTS = 16
#: In a gathered tree: bits of a word's number in a key; the rest is the gram before it.
SHIFT = 32
#: No word hashes to it but by chance, as with any two words.
END_HASH = np.uint64(0x5EEDF00D0E4D0F11)
_STEP = np.uint64(0x9E3779B97F4A7C15)
QUESTION = "block long, part int, data binary"
ANSWER = "block long, part int, data binary, rest binary"
BLOCK_COLUMNS = ["block", "vocab", "codes", "ids", "sizes", "training"]
BLOCK = "block long, vocab binary, codes binary, ids array<long>, sizes binary, training binary"


def blocks(docs: DataFrame, doc_id: str, text: str, block_bytes: int) -> DataFrame:
    """docs must have a boolean column `held_out`. Block numbers are fixed once written."""
    source = docs.select(
        F.shiftleft(F.spark_partition_id().cast("long"), 32).alias("part"),
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        "held_out",
    )

    def block(number: int, ids: list, texts: list, held: list) -> pa.RecordBatch:
        words = word_batch(pa.array(texts, pa.large_string()))
        hashes = words.hashes()
        vocab, codes, n = np.unique(np.append(hashes, END_HASH), return_inverse=True, return_counts=True)
        # Frequent words get small codes, which pack well.
        rank = np.argsort(-n, kind="stable")
        vocab, codes = vocab[rank], np.argsort(rank, kind="stable")[codes]
        sizes = words.sizes + 1
        full = np.full(int(sizes.sum()), codes[-1], np.int32)
        last = np.zeros(len(full), bool)
        last[np.cumsum(sizes) - 1] = True
        full[~last] = codes[:-1]
        values = (
            [number],
            [vocab.tobytes()],
            [packed_ints(full)],
            [ids],
            [sizes.astype(np.int64).tobytes()],
            [(~np.array(held, bool)).tobytes()],
        )
        types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(values, types, strict=True)],
            ["block", "vocab", "codes", "ids", "sizes", "training"],
        )

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, size, number, made = [], [], [], 0, 0, 0
        for frame in frames:
            for part, doc, one, out in zip(*[c.to_pylist() for c in frame.columns], strict=True):
                number = part
                ids.append(doc)
                texts.append(one)
                held.append(out)
                size += len(one or "")
                if size >= block_bytes:
                    yield block(number + made, ids, texts, held)
                    ids, texts, held, size, made = [], [], [], 0, made + 1
        if ids:
            yield block(number + made, ids, texts, held)

    return source.mapInArrow(read, BLOCK)


@dataclass
class Block:
    vocab: np.ndarray
    codes: np.ndarray
    ids: list
    sizes: np.ndarray
    training: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Whether a token begins a document."""
        first = np.zeros(len(self.codes), bool)
        first[np.cumsum(self.sizes) - self.sizes] = True
        return first


def opened(frame: pa.RecordBatch) -> Iterator[tuple[int, Block]]:
    # One block at a time leaves the batch.
    for i in range(frame.num_rows):
        number, vocab, codes, ids, sizes, training = (column[i].as_py() for column in frame.columns[:6])
        yield (
            number,
            Block(
                np.frombuffer(vocab, np.uint64),
                unpacked_ints(codes),
                ids,
                np.frombuffer(sizes, np.int64),
                np.frombuffer(training, bool),
            ),
        )


def block_words(table: DataFrame) -> DataFrame:
    """block, place, word, n: every distinct word of a block with its training count."""

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for number, block in opened(frame):
                weight = np.repeat(block.training, block.sizes)
                n = np.bincount(block.codes[weight], minlength=len(block.vocab))
                size = len(block.vocab)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(size, number, np.int64)),
                        pa.array(np.arange(size, dtype=np.int32)),
                        pa.array(block.vocab.view(np.int64)),
                        pa.array(n.astype(np.int64)),
                    ],
                    ["block", "place", "word", "n"],
                )

    return table.mapInArrow(read, "block long, place int, word long, n long")


@dataclass
class Order:
    """Grams of one length in one place, sorted by key: number of the gram without its last
    word, shifted, plus number of the last word."""

    key: np.ndarray
    n: np.ndarray
    suffix: np.ndarray
    #: As contexts: whether retained, and log10 of the factor for other words.
    kept: np.ndarray | None = None
    rest: np.ndarray | None = None
    #: As entries of the context they begin with: log10 P(last word | context).
    score: np.ndarray | None = None
    #: The same word's log10 probability in the longest retained suffix of the context.
    likely: np.ndarray | None = None


@dataclass
class Tree:
    total: int
    distinct: int
    words: np.ndarray
    orders: list[Order] = field(default_factory=list)

    def root(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1.0) / (self.total + self.distinct + 1.0))


@dataclass
class Grown:
    """The tree as written tables, which are only ever joined by key.

    counts: word, n of every training word. told[k - 1]: key, owner, suffix, n, below, share
    of the frequent grams of k + 1 words. grams[k]: key, n, likely and (but for words)
    in_context of the same, the longest only those of retained contexts. contexts[k]: key,
    rest of the retained contexts of k + 1 words.
    """

    total: int
    distinct: int
    counts: DataFrame
    told: list[DataFrame] = field(default_factory=list)
    grams: list[DataFrame] = field(default_factory=list)
    contexts: list[DataFrame] = field(default_factory=list)


def _joined(owner: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Key of the gram that begins with one gram and ends with the other."""
    return mix64(mix64(owner) * _STEP + suffix)


def _gram_keys(block: Block, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each length the key of the gram that ends at each token, and the token's place
    in its document: a gram of k + 1 words needs place k at least."""
    starts = np.cumsum(block.sizes) - block.sizes
    place = np.arange(len(block.codes)) - np.repeat(starts, block.sizes)
    keys = [block.vocab[block.codes]]
    for _ in range(depth):
        before = np.concatenate([[np.uint64(0)], keys[-1][:-1]])
        keys.append(_joined(before, keys[-1]))
    return keys, place


def slots_for(total: int, least: float) -> int:
    """A power of two."""
    wanted = max(CHUNK, int(SLOTS_PER_ENTRY * total / least))
    return min(MOST_SLOTS, 1 << (wanted - 1).bit_length())


def _slot(keys: np.ndarray, slots: int) -> np.ndarray:
    return (mix64(keys.astype(np.uint64)) & np.uint64(slots - 1)).astype(np.int64)


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a key's bit is set; it is for every key of the table, and by chance."""
    at = _slot(keys, len(bits) * 8)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def key_bits(keys: DataFrame, slots: int) -> np.ndarray:
    """One bit for each slot that a key falls into. Tasks send chunks with a set bit, tasks
    that get a chunk unite them; the bits alone reach the driver. What is looked up there is
    joined with the table later, so chance hits cost rows and change nothing."""

    def marked(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            at = np.unique(_slot(frame.column(0).to_numpy(), slots))
            chunk, first = np.unique(at // CHUNK, return_index=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(chunk.astype(np.int32)),
                    pa.array([(part % CHUNK).astype("<u2").tobytes() for part in np.split(at, first[1:])] if len(at) else [], pa.binary()),
                ],
                ["chunk", "places"],
            )

    def united(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for chunk, places in zip(frame.column(0).to_pylist(), frame.column(1), strict=True):
                bits = np.zeros(CHUNK, bool)
                bits[np.frombuffer(places.as_py(), "<u2")] = True
                packed = np.packbits(bits)
                sums[chunk] = sums[chunk] | packed if chunk in sums else packed
        for chunk, bits in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["chunk", "bits"]
            )

    pieces = keys.select("key").mapInArrow(marked, "chunk int, places binary").repartition("chunk")
    found = pieces.mapInArrow(united, "chunk int, bits binary").toArrow()
    bits = np.zeros(slots // 8, np.uint8)
    for chunk, part in zip(found["chunk"].to_pylist(), found["bits"].to_pylist(), strict=True):
        bits[chunk * CHUNK // 8 : (chunk + 1) * CHUNK // 8] = np.frombuffer(part, np.uint8)
    return bits


def _bits_of(keys: DataFrame) -> Broadcast:
    """Sized by the number of keys, MOST_SLOTS at most."""
    bits = key_bits(keys, slots_for(2 * keys.count(), 1))
    return keys.sparkSession.sparkContext.broadcast(bits)


def _next_grams(table: DataFrame, shorter: DataFrame, order: int, min_count: int) -> DataFrame:
    """key, owner, suffix, n of the grams of order + 1 words that occur often enough: then
    the grams they begin and end with do as well."""
    shared = _bits_of(shorter)

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for _, block in opened(frame):
                keys, place = _gram_keys(block, order)
                often = _has(shared.value, keys[order - 1])
                ok = (place >= order) & np.repeat(block.training, block.sizes) & often
                ok[1:] &= often[:-1]
                at = np.flatnonzero(ok)
                _, first, n = np.unique(keys[order][at], return_index=True, return_counts=True)
                at = at[first]
                # A gram is what it begins with and what it ends with.
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[order - 1][at - 1].view(np.int64)),
                        pa.array(keys[order - 1][at].view(np.int64)),
                        pa.array(n.astype(np.int32)),
                    ],
                    ["owner", "suffix", "n"],
                )

    def keyed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            owner, suffix = (frame.column(i).to_numpy().view(np.uint64) for i in range(2))
            key = pa.array(_joined(owner, suffix).view(np.int64))
            yield pa.RecordBatch.from_arrays([key, *frame.columns], ["key", "owner", "suffix", "n"])

    pairs = table.select(*BLOCK_COLUMNS).mapInArrow(read, "owner long, suffix long, n int")
    often = pairs.groupBy("owner", "suffix").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    return often.mapInArrow(keyed, "key long, owner long, suffix long, n long")


def grow(table: DataFrame, words: DataFrame, depth: int, smoothing: float, min_count: int) -> Grown:
    """Counts, divergence tests and smoothed distributions, shorter contexts first. A gram
    needs `min_count` occurrences whatever the size of the corpus."""
    counts = written(words.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"), "words")
    size = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("words")).first()
    tree = Grown(size["total"] or 0, size["words"], counts)
    likely = F.log10((F.col("n") + 1.0) / F.lit(tree.total + tree.distinct + 1.0))
    tree.grams.append(
        counts.filter(F.col("n") >= min_count).select(F.col("word").alias("key"), "n", likely.alias("likely"))
    )
    n, below, share = F.col("n"), F.col("below"), F.col("share")
    for order in range(1, depth + 1):
        shorter = tree.grams[-1]
        # The same word after the longest retained suffix of the context.
        ends = shorter.select(F.col("key").alias("suffix"), F.pow(F.lit(10.0), "likely").alias("below"))
        begins = shorter.select(F.col("key").alias("owner"), F.col("n").alias("_all"))
        found = _next_grams(table, shorter, order, min_count).join(ends, "suffix").join(begins, "owner")
        part = (n + smoothing * below) / (F.col("_all") + smoothing)
        told = written(found.select("key", "owner", "suffix", "n", "below", part.alias("share")), "told")
        cost = 0.5 * math.log(max(tree.total, 2))
        left, other = (F.greatest(1 - F.sum(column), F.lit(1e-12)) for column in (share, below))
        tested = told.groupBy("owner").agg(
            F.sum(n * F.log(share / below)).alias("_gain"),
            (F.count(F.lit(1)) * F.lit(cost)).alias("_cost"),
            F.log10(left / other).alias("rest"),
        )
        contexts = written(tested.filter("_gain > _cost").select(F.col("owner").alias("key"), "rest"), "contexts")
        tree.contexts.append(contexts)
        own = contexts.select(F.col("key").alias("owner"), F.lit(True).alias("_kept"))
        kept = F.coalesce("_kept", F.lit(False))
        retained = told.join(own, "owner", "left" if order < depth else "inner").select(
            "key", "n", F.log10(F.when(kept, share).otherwise(below)).alias("likely"), kept.alias("in_context")
        )
        tree.told.append(told)
        tree.grams.append(written(retained, "grams"))
    return tree


def learn(
    table: DataFrame, words: DataFrame, depth: int, smoothing: float, min_count: int = MIN_COUNT
) -> tuple[Tree, DataFrame]:
    """The tree of a small table gathered in one place, to look at, and the written table of
    all word counts. Scoring joins the tables instead."""
    grown = grow(table, words, depth, smoothing, min_count)
    tree, number = Tree(grown.total, grown.distinct, np.zeros(0, np.uint64)), {}
    for k in range(depth + 1):
        table = grown.told[k - 1] if k else grown.grams[0]
        rows = {name: column.to_numpy() for name, column in zip(table.columns, table.toArrow().columns, strict=True)}
        own = rows["key"]
        if k == 0:
            rank = np.argsort(own.view(np.uint64))
            tree.words = own.view(np.uint64)[rank]
            order = Order(np.arange(len(own)), rows["n"][rank], np.zeros(len(own), np.int64))
            order.likely = rows["likely"][rank]
        else:
            longer, shorter = tree.orders[-1].key, number
            owner = np.array([shorter[key] for key in rows["owner"].tolist()], np.int64)
            suffix = np.array([shorter[key] for key in rows["suffix"].tolist()], np.int64)
            key = owner << SHIFT | (longer[suffix] & ((1 << SHIFT) - 1))
            rank = np.argsort(key)
            order = Order(key[rank], rows["n"][rank], suffix[rank], score=np.log10(rows["share"][rank]))
            kept = tree.orders[-1].kept[owner[rank]]
            order.likely = np.where(kept, order.score, np.log10(rows["below"][rank]))
        number = {key: i for i, key in enumerate(own[rank].tolist())}
        order.kept, order.rest = np.zeros(len(own), bool), np.zeros(len(own))
        if k < depth:
            for row in grown.contexts[k].toLocalIterator():
                order.kept[number[row["key"]]], order.rest[number[row["key"]]] = True, row["rest"]
        tree.orders.append(order)
    return tree, grown.counts


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of integers as one compressed value; those beyond 32 bits as two halves."""
    head, parts = [len(columns)], []
    for column in columns:
        column = column.astype(np.int64)
        wide = len(column) > 0 and (column.max() >= 1 << 31 or column.min() < -(1 << 31))
        head.append(2 * len(column) + wide)
        parts.append((column & 0xFFFFFFFF).astype(np.uint32).view(np.int32))
        if wide:
            parts.append((column >> 32).astype(np.int32))
    return packed_ints(np.concatenate([np.array(head, np.int32), *parts]))


def _unpacked(data: bytes) -> list[np.ndarray]:
    values = unpacked_ints(data)
    columns, at = [], 1 + int(values[0])
    for size in values[1:at].tolist():
        size, wide = size >> 1, size & 1
        column = values[at : at + size].astype(np.int64)
        at += size
        if wide:
            column = (column & 0xFFFFFFFF) | values[at : at + size].astype(np.int64) << 32
            at += size
        columns.append(column)
    return columns


def _grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, sorted; where each is found; which of them each value is."""
    rank = np.argsort(values)
    values = values[rank]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    which = np.empty(len(values), np.int64)
    which[rank] = np.cumsum(new) - 1
    return values[new], rank[new], which


def _runs(numbers: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.diff(numbers, prepend=numbers[0] - 1)) if len(numbers) else np.zeros(0, np.int64)


@dataclass
class Model:
    """What all tasks share. A frequent word's number is its place by falling count among
    the words of its part, times the number of parts, plus the part; a word with n < min_count
    training occurrences has the number -1 - n. `steps` has where a part's counts change: at
    most sqrt(2 N) places a part, so counts of all words follow from little."""

    parts: int
    smoothing: float
    min_count: int
    total: int = 0
    distinct: int = 0
    steps: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    step_counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: By order: keys of the retained ones of the frequent contexts that are dealt out over
    #: several parts, and their rest.
    spread: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def count(self, ids: np.ndarray) -> np.ndarray:
        n = -1 - ids
        often = np.flatnonzero(ids >= 0)
        at = (ids[often] % self.parts << 40) + ids[often] // self.parts
        n[often] = self.step_counts[np.searchsorted(self.steps, at, "right") - 1]
        return n

    def root(self, n: np.ndarray) -> np.ndarray:
        return (n + 1.0) / (self.total + self.distinct + 1.0)

    def pieces(self, n: np.ndarray) -> np.ndarray:
        """Over how many parts the next symbols of a context with n occurrences are dealt:
        some 8 contexts a part, at most, have more than one."""
        return n // max(self.min_count, self.total // (8 * self.parts)) + 1

    def retained(self, gain: np.ndarray, entries: np.ndarray) -> np.ndarray:
        return gain > entries * (0.5 * math.log(max(self.total, 2)))


def _rest(share: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(1 - share, 1e-12) / np.maximum(1 - below, 1e-12))


def _context_keys(ids: list[np.ndarray]) -> np.ndarray:
    key = mix64(ids[0].astype(np.uint64))
    for column in ids[1:]:
        key = _joined(key, column.astype(np.uint64))
    return key


@dataclass
class Asked:
    """What a block asks about one order, sorted by context and next symbol: entries are
    pairs of them, or contexts alone (next symbol -1) that have no possible entry here."""

    #: Tokens with a possible context, and the context of each.
    tokens: np.ndarray
    owner: np.ndarray
    #: By context: key, count, a token after it.
    keys: np.ndarray
    sizes: np.ndarray
    after: np.ndarray
    #: Tokens that stand for an entry, and the entry of each.
    used: np.ndarray
    entry: np.ndarray
    #: By entry: context, next symbol, such a token, and part.
    owners: np.ndarray
    symbols: np.ndarray
    at: np.ndarray
    part: np.ndarray
    #: Entries by part.
    order: np.ndarray

    def chunks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Part, its entries, where contexts begin among them."""
        part = self.part[self.order].astype(np.int64)
        if not len(part):
            return
        first = _runs(part)
        for begin, end in zip(first, np.append(first[1:], len(part)), strict=True):
            entries = self.order[begin:end]
            yield int(part[begin]), entries, _runs(self.owners[entries])


class View:
    """A block with the answers so far. By token: n[k] counts the k + 1 words that end there
    (0 if too rare to matter, but for words), context[k] the k words before if they are a
    retained context (else 0), rest[k] is the share left to other words there. number[k] is
    the number of these k + 1 words among the grams[k] of the block, by the words' numbers."""

    def __init__(self, block: Block, answers: list[list], model: Model) -> None:
        self.block, self.model = block, model
        starts = np.cumsum(block.sizes) - block.sizes
        self.place = np.arange(len(block.codes)) - np.repeat(starts, block.sizes)
        answers = [sorted(pieces, key=lambda p: p["part"]) for pieces in answers]
        ids = np.empty(len(block.vocab), np.int64)
        ids[np.argsort(block.vocab)] = np.concatenate([_unpacked(piece["data"])[0] for piece in answers[0]])
        rank = np.argsort(ids, kind="stable")
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        self.ids, self.symbols = ids[block.codes], ids[rank]
        self.number, self.grams = [place[block.codes]], [len(rank)]
        self.n, self.context, self.rest = [model.count(ids)[block.codes]], [np.zeros(0)], [np.zeros(0)]
        for k in range(1, len(answers)):
            self.learn(k, answers[k])

    def asked(self, k: int) -> Asked:
        model = self.model
        tokens = np.flatnonzero(self.place >= k)
        tokens = tokens[self.n[k - 1][tokens - 1] >= model.min_count]
        owner = self.number[k - 1][tokens - 1]
        real = self.n[k - 1][tokens] >= model.min_count
        answered = np.zeros(self.grams[k - 1], bool)
        answered[owner[real]] = True
        use = real | ~answered[owner]
        used, words = tokens[use], self.grams[0] + 1
        pairs, at, entry = _grouped(owner[use] * words + np.where(real, self.number[0][tokens] + 1, 0)[use])
        at, first = used[at], _runs(pairs // words)
        after = at[first]
        owners = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pairs))))
        symbols = np.append(np.int64(-1), self.symbols)[pairs % words]
        place = np.zeros(self.grams[k - 1], np.int64)
        place[pairs[first] // words] = np.arange(len(first))
        keys = _context_keys([self.ids[after - j] for j in range(k, 0, -1)])
        sizes = self.n[k - 1][after - 1]
        pieces = model.pieces(sizes)
        part = keys[owners]
        many = np.flatnonzero(pieces[owners] > 1)
        part[many] += mix64(symbols[many].astype(np.uint64)) % pieces[owners[many]].astype(np.uint64)
        part = (part % np.uint64(model.parts)).astype(np.uint16 if model.parts < 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        return Asked(tokens, place[owner], keys, sizes, after, used, entry, owners, symbols, at, part, order)

    def questions(self, k: int) -> Iterator[tuple[int, bytes]]:
        """By part: of each context its words, count, retained suffixes and number of entries,
        of each entry the next symbol, training count and counts after retained suffixes. The
        words' numbers tell their counts, so the suffix of one word is a flag."""
        asked = self.asked(k)
        training = np.repeat(self.block.training, self.block.sizes)
        n = np.bincount(asked.entry[training[asked.used]], minlength=len(asked.symbols))
        for part, entries, begin in asked.chunks():
            own = asked.owners[entries][begin]
            after, at = asked.after[own], asked.at[entries]
            yield part, _packed(
                np.diff(self.ids[after - k], prepend=0),
                *(self.ids[after - j] for j in range(k - 1, 0, -1)),
                asked.sizes[own],
                *(self.context[j][after] if j > 1 else self.context[j][after] > 0 for j in range(1, k)),
                np.diff(np.append(begin, len(entries))),
                asked.symbols[entries],
                n[entries],
                *(self.n[j][at] * (self.context[j][at] > 0) for j in range(1, k)),
            )

    def learn(self, k: int, pieces: list) -> None:
        asked = self.asked(k)
        n, kept, rest = np.zeros(len(asked.symbols), np.int64), np.zeros(len(asked.keys), bool), np.zeros(len(asked.keys))
        for piece, (_, entries, begin) in zip(pieces, asked.chunks(), strict=True):
            n[entries], hit = _unpacked(piece["data"])
            own = asked.owners[entries][begin][hit == 1]
            kept[own], rest[own] = True, np.frombuffer(piece["rest"], np.float64)
        keys, values = self.model.spread[k]
        many = np.flatnonzero(self.model.pieces(asked.sizes) > 1)
        if len(keys) and len(many):
            found = np.minimum(np.searchsorted(keys, asked.keys[many]), len(keys) - 1)
            same = keys[found] == asked.keys[many]
            kept[many[same]], rest[many[same]] = True, values[found[same]]
        size = len(self.ids)
        for name, tokens, values in (
            ("n", asked.used, n[asked.entry]),
            ("context", asked.tokens, (asked.sizes * kept)[asked.owner]),
            ("rest", asked.tokens, rest[asked.owner]),
        ):
            column = np.zeros(size, values.dtype)
            column[tokens] = values
            getattr(self, name).append(column)
        number = np.zeros(size, np.int64)
        number[asked.used] = asked.entry
        self.number.append(number)
        self.grams.append(len(asked.symbols))

    def scores(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which tokens training has, their log10 probabilities at the root and in the tree."""
        root = self.model.root(self.n[0])
        value, smoothing = root, self.model.smoothing
        for k in range(1, depth + 1):
            context, n = self.context[k], self.n[k]
            entry = (n + smoothing * value) / (context + smoothing)
            value = np.where(context == 0, value, np.where(n > 0, entry, 10.0 ** self.rest[k] * value))
        return self.n[0] > 0, np.log10(root), np.log10(value)


def _bucketed(table: DataFrame, buckets: int, label: str) -> DataFrame:
    """Written once in buckets by block number: later joins leave it where it is."""
    spark = table.sparkSession
    path = new_shared_path(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    table.write.format("parquet").bucketBy(buckets, "block").option("path", path).saveAsTable(name)
    return spark.table(name)


def _answers(asked: DataFrame, answer, buckets: int) -> DataFrame:
    """A group of questions at a time; rows without a block are sums over the part."""
    return _bucketed(asked.groupBy("part").applyInArrow(answer, ANSWER).repartition(buckets, "block"), buckets, "answers")


def _answer_rows(part: int, blocks: list, data: list, rest: list) -> pa.Table:
    columns = [pa.array(blocks, pa.int64()), pa.array([part] * len(blocks), pa.int32())]
    return pa.table([*columns, pa.array(data, pa.binary()), pa.array(rest, pa.binary())], ["block", "part", "data", "rest"])


def _question_rows(number: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    columns = [pa.array([number] * len(rows), pa.int64()), pa.array([p for p, _ in rows], pa.int32())]
    return pa.RecordBatch.from_arrays([*columns, pa.array([data for _, data in rows], pa.binary())], ["block", "part", "data"])


def number_words(table: DataFrame, model: Model, buckets: int) -> DataFrame:
    """Answers with the numbers of each block's words, by hash; completes the model."""
    parts, min_count = model.parts, model.min_count

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for number, block in opened(frame):
                weight = np.repeat(block.training, block.sizes)
                rank = np.argsort(block.vocab)
                n = np.bincount(block.codes[weight], minlength=len(rank))[rank]
                keys = block.vocab[rank]
                part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                first = _runs(part)
                rows = []
                for begin, end in zip(first, np.append(first[1:], len(part)), strict=True):
                    steps = np.diff(keys[begin:end], prepend=np.uint64(0)).view(np.int64)
                    rows.append((int(part[begin]), _packed(steps, n[begin:end])))
                yield _question_rows(number, rows)

    def answer(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        asked = [_unpacked(data.as_py()) for data in group["data"]]
        keys = np.concatenate([np.cumsum(steps.view(np.uint64), dtype=np.uint64) for steps, _ in asked])
        words, _, which = _grouped(keys)
        n = np.bincount(which, np.concatenate([n for _, n in asked]), len(words)).astype(np.int64)
        ids = -1 - n
        often = np.flatnonzero(n >= min_count)
        often = often[np.argsort(-n[often], kind="stable")]
        ids[often] = np.arange(len(often)) * parts + part
        change = _runs(n[often])
        sums = np.concatenate([[n.sum(), (n > 0).sum()], (part << 40) + change, n[often][change]])
        cuts = np.cumsum([len(n) for _, n in asked])[:-1]
        data = [_packed(own) for own in np.split(ids[which], cuts)]
        return _answer_rows(part, [*group["block"].to_pylist(), None], [*data, sums.astype(np.int64).tobytes()], [b""] * (len(data) + 1))

    answers = _answers(table.select(*BLOCK_COLUMNS).mapInArrow(read, QUESTION), answer, buckets)
    sums = [np.frombuffer(row["data"], np.int64) for row in answers.filter("block IS NULL").orderBy("part").select("data").toLocalIterator()]
    halves = [np.split(one[2:], 2) for one in sums]
    model.total, model.distinct = (sum(int(one[i]) for one in sums) for i in range(2))
    model.steps, model.step_counts = (np.concatenate([np.zeros(0, np.int64), *(h[i] for h in halves)]) for i in range(2))
    return answers


def count_order(told: DataFrame, model: Model, k: int, buckets: int) -> DataFrame:
    """Answers with the counts of each block's grams of k + 1 words and the retained contexts
    of k words; told: blocks with the answers of shorter orders."""
    shared = told.sparkSession.sparkContext.broadcast(model)

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for i, (number, block) in enumerate(opened(frame)):
                rows = list(View(block, _known(frame, i), shared.value).questions(k))
                yield _question_rows(number, rows)
                del block, rows
        give_back()

    def answer(group: pa.Table) -> pa.Table:
        model = shared.value
        asked = [_unpacked(data.as_py()) for data in group["data"]]
        for columns in asked:
            columns[0] = np.cumsum(columns[0])
        contexts, entries = [len(columns[0]) for columns in asked], [len(columns[-1]) for columns in asked]
        columns = [np.concatenate(parts) for parts in zip(*asked, strict=True)]
        del asked
        size, suffixes, lengths = columns[k], columns[k + 1 : 2 * k], columns[2 * k]
        symbol, n, shorter = columns[2 * k + 1], columns[2 * k + 2], columns[2 * k + 3 :]
        if k > 1:
            suffixes[0] = suffixes[0] * model.count(columns[k - 1])
        keys, first, owner = _grouped(_context_keys(columns[:k]))
        row = np.repeat(np.arange(len(lengths)), lengths)
        _, at, gram = _grouped(_joined(keys[owner[row]], symbol.astype(np.uint64)))
        n = np.bincount(gram, n, len(at)).astype(np.int64)
        often = (n >= model.min_count) & (symbol[at] >= 0)
        n[~often] = 0
        at, some = at[often], n[often]
        row = row[at]
        below = model.root(model.count(symbol[at]))
        for context, counts in zip(suffixes, shorter, strict=True):
            entry = (counts[at] + model.smoothing * below) / (context[row] + model.smoothing)
            below = np.where(context[row] > 0, entry, below)
        share = (some + model.smoothing * below) / (size[row] + model.smoothing)
        weights = (some * np.log(share / below), np.ones(len(at)), share, below)
        sums = [np.bincount(owner[row], weight, len(keys)) for weight in weights]
        many = model.pieces(size[first]) > 1
        kept = model.retained(sums[0], sums[1]) & ~many
        rest = _rest(sums[2], sums[3])
        data, left = [], []
        for own, some in zip(np.split(owner, np.cumsum(contexts)[:-1]), np.split(n[gram], np.cumsum(entries)[:-1]), strict=True):
            data.append(_packed(some, kept[own]))
            left.append(rest[own][kept[own]].tobytes())
        spread = np.concatenate([keys[many].view(np.float64), *(one[many] for one in sums)])
        del columns, size, suffixes, lengths, symbol, shorter, row, at, gram, below, share, weights
        give_back()
        return _answer_rows(group["part"][0].as_py(), [*group["block"].to_pylist(), None], [*data, b""], [*left, spread.tobytes()])

    answers = _answers(told.mapInArrow(read, QUESTION), answer, buckets)
    rows = [np.frombuffer(r["rest"], np.float64).reshape(5, -1) for r in answers.filter("block IS NULL").orderBy("part").select("rest").toLocalIterator()]
    found = np.concatenate([np.zeros((5, 0)), *rows], axis=1)
    keys, which = np.unique(np.ascontiguousarray(found[0]).view(np.uint64), return_inverse=True)
    gain, entries, share, below = (np.bincount(which, column, len(keys)) for column in found[1:])
    kept = model.retained(gain, entries)
    model.spread[k] = keys[kept], _rest(share, below)[kept]
    return answers


def _told(table: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """The blocks with a list of answers for each order; all lie in the same buckets."""
    told = table.select(*BLOCK_COLUMNS)
    for k, one in enumerate(answers):
        pieces = F.collect_list(F.struct("part", "data", "rest")).alias(f"known_{k}")
        told = told.join(one.filter("block IS NOT NULL").groupBy("block").agg(pieces), "block", "left")
    return told


def _known(frame: pa.RecordBatch, i: int) -> list[list]:
    return [column[i].as_py() or [] for column in frame.columns[len(BLOCK_COLUMNS) :]]


def score(table: DataFrame, depth: int, smoothing: float, min_count: int, buckets: int) -> tuple[DataFrame, Model]:
    """doc_id, training, n_tokens, n_known, base_score, score of every document, and the
    model. table: blocks in so many buckets."""
    size = table.select(F.sum(F.length("codes"))).first()[0] or 0
    model = Model(max(LEAST_PARTS, -(-size // PART_BYTES)), smoothing, min_count)
    answers = [number_words(table, model, buckets)]
    for k in range(1, depth + 1):
        answers.append(count_order(_told(table, answers), model, k, buckets))
    shared = table.sparkSession.sparkContext.broadcast(model)

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for i, (_, block) in enumerate(opened(frame)):
                seen, root, value = View(block, _known(frame, i), shared.value).scores(depth)
                begin = np.cumsum(block.sizes) - block.sizes
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block.ids, pa.int64()),
                        pa.array(block.training),
                        pa.array(block.sizes),
                        pa.array(np.add.reduceat(seen.astype(np.int64), begin)),
                        pa.array(np.add.reduceat(root, begin)),
                        pa.array(np.add.reduceat(value, begin)),
                    ],
                    ["doc_id", "training", "n_tokens", "n_known", "base_score", "score"],
                )
                del block, seen, root, value
        give_back()

    schema = "doc_id long, training boolean, n_tokens long, n_known long, base_score double, score double"
    return _told(table, answers).mapInArrow(read, schema), model


def model_scores(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    depth: int = DEPTH,
    min_count: int = MIN_COUNT,
    smoothing: float = SMOOTHING,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Learn from the rows that are not `held_out` and score all rows."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = _bucketed(blocks(docs, doc_id, text, block_bytes), buckets, "blocks")
    scored, model = score(table, depth, smoothing, min_count, buckets)
    return scored.withColumn("train_tokens", F.lit(model.total).cast("bigint"))


def lm_scores(docs: DataFrame) -> DataFrame:
    """Query: learn outside fold 2 of 7, score all documents."""
    marked = docs.select("doc_id", "text", F.coalesce(fold("doc_id", 7) == 2, F.lit(False)).alias("held_out"))
    return model_scores(marked).select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
