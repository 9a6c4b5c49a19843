"""Exact Jaccard self-join of documents on word shingles, by signature trees.

1. Every document becomes the set of its distinct shingles (64-bit hashes); documents
   with equal sets form one class, so copies cost nothing further.
2. A set that is similar enough to another one shares at least ceil(t n) of its n tokens.
   How many of its tokens another class holds as well is counted exactly: tokens travel
   once, as packed 40-bit fingerprints in buckets of bounded size, and counts per class
   return (an equal fingerprint of other tokens can only add candidates). Most documents
   leave here.
3. Of the others, tokens are ordered by the number of sets that hold them; two similar
   sets share a token among the first n - ceil(t n) + 1 of each. Classes joined by such
   tokens form areas.
4. In an area a signature tree (`sigtree`) is traversed against itself. An area with more
   tokens than a task should hold is cut into tiles: first each tile by itself, then one
   member per tile and label, and only if labels still differ pairs of tiles, again by
   dual traversal, one task per pair.
5. Links form components; the class of a document gives its component.

Only connecting links are made (at most one per class and traversal), never all pairs of
a group, and no link between different components is missed.

Defined results: NULL or blank texts have no shingles and are components of their own;
fewer words than a shingle give the whole sequence as one. Repeated rows fall into one
class; NULL ids are never chosen as component ids, unless all are NULL. Texts of any
length are taken whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions import ship_by_value
from tallymark.llm import sigtree
from tallymark.llm.common import mix64, spans, windows, word_batch, written
from tallymark.llm.graph import components
from tallymark.operators.skew import lookup_join

ship_by_value(__name__)

#: Tokens of one bucket, which one task holds at a time, and of one flush of a task.
BUCKET_TOKENS = 1 << 21
FLUSH_TOKENS = 1 << 20
FINGERPRINT = 5
#: Classes whose counts one task sums up at a time, and the least number of such groups.
GROUP_CLASSES = 1 << 20
LEAST_GROUPS = 16
#: Tokens that one task holds as one tile.
TILE_TOKENS = 1 << 21
#: Document ids that may be broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for low, high in spans(texts):
        batch = word_batch(texts.slice(low, high - low))
        hashes, offsets = batch.hashes(), batch.offsets
        value, start = windows(hashes, offsets, width)
        begin = np.searchsorted(start, offsets)
        for i in range(high - low):
            first, last = offsets[i], offsets[i + 1]
            if 0 < last - first < width:
                whole = np.uint64(last - first)
                for one in hashes[first:last]:
                    whole = mix64(np.array([whole ^ one]))[0]
                yield low + i, np.array([whole], np.uint64)
            else:
                yield low + i, np.unique(value[begin[i] : begin[i + 1]])


def class_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _classes(docs: DataFrame, width: int) -> DataFrame:
    """Class and size of every document."""

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            found = [(class_of(t) if len(t) else None, len(t)) for _, t in shingle_sets(frame.column(2), width)]
            yield pa.RecordBatch.from_arrays(
                [
                    frame.column(0),
                    frame.column(1),
                    pa.array([c for c, _ in found], pa.binary()),
                    pa.array([None if c is None else _short(c) for c, _ in found], pa.int64()),
                    pa.array([n for _, n in found], pa.int64()),
                ],
                ["row", "doc_id", "class", "short", "n"],
            )

    return docs.mapInArrow(read, "row long, doc_id long, class binary, short long, n long")


def _shared_counts(docs: DataFrame, width: int, buckets: int, groups: int) -> DataFrame:
    """(short, shared): for each class the number of its tokens that another class holds.

    Buckets send their counts packed, one row for each group of classes."""

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate([np.zeros(0, np.uint64), *held.values()])
            owner = np.repeat(np.arange(len(held)), [len(t) for t in held.values()])
            names = np.fromiter(held, np.int64, len(held))
            bucket = (flat % np.uint64(buckets)).astype(np.int64)
            rank = np.argsort(bucket, kind="stable")
            flat, owner, bucket = flat[rank], owner[rank], bucket[rank]
            prints = mix64(flat).view(np.uint8).reshape(-1, 8)[:, :FINGERPRINT]
            # One run for each bucket and class: tokens of a class lie together.
            new = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])]))
            counts = np.diff(np.append(new, len(flat))).astype(np.int32)
            used, first = np.unique(bucket, return_index=True)
            last = np.append(first[1:], len(flat))
            runs = np.searchsorted(new, first), np.searchsorted(new, last)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(used),
                    pa.array([prints[i:j].tobytes() for i, j in zip(first, last, strict=True)], pa.binary()),
                    pa.array([names[owner[new[i:j]]].tobytes() for i, j in zip(*runs, strict=True)], pa.binary()),
                    pa.array([counts[i:j].tobytes() for i, j in zip(*runs, strict=True)], pa.binary()),
                ],
                ["bucket", "prints", "classes", "counts"],
            )

        for frame in frames:
            for _, tokens in shingle_sets(frame.column(2), width):
                if len(tokens):
                    name = _short(class_of(tokens))
                    size += 0 if name in held else len(tokens)
                    held[name] = tokens
                if size >= FLUSH_TOKENS:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def shared() -> pa.RecordBatch:
            raw = np.frombuffer(b"".join(row[0] for row in held), np.uint8).reshape(-1, FINGERPRINT)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :FINGERPRINT] = raw
            prints = wide.view(np.uint64).ravel()
            classes = np.frombuffer(b"".join(row[1] for row in held), np.int64)
            owner = np.repeat(classes, np.frombuffer(b"".join(row[2] for row in held), np.int32))
            rank = np.argsort(prints, kind="stable")
            prints, owner = prints[rank], owner[rank]
            first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
            several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
            both = np.repeat(several, np.diff(np.append(first, len(prints))))
            # A class that several tasks or flushes sent counts a token once.
            prints, owner = prints[both], owner[both]
            rank = np.lexsort((owner, prints))
            prints, owner = prints[rank], owner[rank]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (prints[1:] != prints[:-1])
            name, n = np.unique(owner[new], return_counts=True)
            group = (mix64(name.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
            rank = np.argsort(group, kind="stable")
            used, first = np.unique(group[rank], return_index=True)
            parts = np.split(rank, first[1:])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(used),
                    pa.array([name[part].tobytes() for part in parts] if len(used) else [], pa.binary()),
                    pa.array([n[part].astype(np.int64).tobytes() for part in parts] if len(used) else [], pa.binary()),
                ],
                ["part", "classes", "counts"],
            )

        for frame in frames:
            for row in zip(*[column.to_pylist() for column in frame.columns], strict=True):
                if row[0] != bucket:
                    if held:
                        yield shared()
                    bucket, held = row[0], []
                held.append(row[1:])
        if held:
            yield shared()

    def total(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def summed(names: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            name, where = np.unique(np.concatenate(names), return_inverse=True)
            return name, np.bincount(where, np.concatenate(counts), len(name)).astype(np.int64)

        for frame in frames:
            for row in zip(*[column.to_pylist() for column in frame.columns], strict=True):
                if row[0] != part:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["short", "shared"])
                    part, held = row[0], (np.zeros(0, np.int64), np.zeros(0, np.int64))
                more = [np.frombuffer(one, np.int64) for one in row[1:]]
                held = summed([held[0], more[0]], [held[1], more[1]])
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["short", "shared"])

    packed = docs.mapInArrow(pack, "bucket long, prints binary, classes binary, counts binary")
    dealt = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    counts = dealt.mapInArrow(count, "part long, classes binary, counts binary")
    grouped = counts.repartition(groups, "part").sortWithinPartitions("part")
    return grouped.mapInArrow(total, "short long, shared long")


def _payload(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """(class, short, n, tokens): the sets of the chosen classes, computed again from the
    text of one document each."""
    ids = chosen.select(F.col("doc_id").alias("_id")).distinct()
    ids = F.broadcast(ids) if chosen.count() <= BROADCAST_ROWS else ids
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(F.col("_id")), "left_semi").select("text")

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for low, high in spans(frame.column(0)):
                sets = [tokens for _, tokens in shingle_sets(frame.column(0).slice(low, high - low), width)]
                sets = [tokens for tokens in sets if len(tokens)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([class_of(tokens) for tokens in sets], pa.binary()),
                        pa.array([tokens.tobytes() for tokens in sets], pa.binary()),
                    ],
                    ["class", "tokens"],
                )

    sets = texts.mapInArrow(read, "class binary, tokens binary")
    return sets.join(chosen.select("class", "short", "n"), "class").dropDuplicates(["class"])


def _areas(sets: DataFrame, percent: int) -> DataFrame:
    """(short, area): classes that share prefix tokens, directly or through others."""

    def explode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for low, high in spans(frame.column(2)):
                tokens = [np.frombuffer(t, np.int64) for t in frame.column(2).slice(low, high - low).to_pylist()]
                sizes = [len(t) for t in tokens]
                short, n = (frame.column(i).slice(low, high - low).to_numpy() for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(short, sizes)), pa.array(np.repeat(n, sizes)), pa.array(np.concatenate(tokens))],
                    ["short", "n", "token"],
                )

    tokens = sets.select("short", "n", "tokens").mapInArrow(explode, "short long, n long, token long")
    several = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("docs")).filter("docs > 1")
    own = Window.partitionBy("short")
    # Tokens that no other set holds come first: they take prefix places and no part.
    place = F.row_number().over(own.orderBy("docs", "token")) + F.col("n") - F.count(F.lit(1)).over(own)
    prefix = F.expr(f"n - (({percent} * n + 99) div 100) + 1")
    ranked = tokens.join(several, "token").withColumn("place", place).filter(F.col("place") <= prefix)
    keys = written(ranked.select("token", "short"), "prefixes")
    centre = keys.groupBy("token").agg(F.min("short").alias("a"))
    edges = keys.join(centre, "token").select("a", F.col("short").alias("b")).filter("a <> b").distinct()
    return components(written(edges, "shared")).select(F.col("node").alias("short"), F.col("label").alias("area"))


def _grouped(
    df: DataFrame, keys: list[str], handle: Callable[[list[tuple]], list[tuple[bytes, bytes]]]
) -> DataFrame:
    """Rows of equal keys meet in one task and one call, many groups in a row."""
    width = len(keys)
    dealt = df.repartition(*keys).sortWithinPartitions(*keys)

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links() -> pa.RecordBatch:
            pairs = handle(held) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], ["a", "b"]
            )

        for frame in frames:
            for row in zip(*[column.to_pylist() for column in frame.columns], strict=True):
                if row[:width] != key:
                    yield links()
                    key, held = row[:width], []
                held.append(row[width:])
        yield links()

    return dealt.mapInArrow(read, "a binary, b binary")


def _inside(percent: int) -> Callable:
    def handle(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        names = [row[0] for row in rows]
        sets = _sets([row[1] for row in rows])
        order = sigtree.near_order(sets)
        pairs = sigtree.connect(sets.take(order), np.arange(len(rows)), percent)
        return [(names[order[a]], names[order[b]]) for a, b in pairs]

    return handle


def _across(percent: int) -> Callable:
    def handle(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        sides = [[row for row in rows if row[3] == side] for side in (0, 1)]
        if not sides[0] or not sides[1]:
            return []
        names, parts = [], []
        for side in sides:
            sets = _sets([row[1] for row in side])
            order = sigtree.near_order(sets)
            names += [side[i] for i in order]
            parts.append(sets.take(order))
        sets = sigtree.Sets(
            np.concatenate([p.flat for p in parts]),
            np.concatenate([parts[0].offsets, parts[0].offsets[-1] + parts[1].offsets[1:]]),
        )
        known = {label: i for i, label in enumerate(sorted({row[2] for row in names}))}
        labels = np.array([known[row[2]] for row in names])
        pairs = sigtree.connect(sets, labels, percent, split=len(sides[0]))
        return [(names[a][0], names[b][0]) for a, b in pairs]

    return handle


def _sets(tokens: list[bytes]) -> sigtree.Sets:
    parts = [np.frombuffer(one, np.uint64) for one in tokens]
    return sigtree.Sets(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Connecting links (a, b) between classes of the same area."""
    one = written(_grouped(sets.select("area", "part", "class", "tokens"), ["area", "part"], _inside(percent)), "links")
    large = sets.filter("parts > 1")
    if large.isEmpty():
        return one

    def labelled(links: DataFrame) -> DataFrame:
        found = components(links).withColumnRenamed("node", "class")
        return large.join(found, "class", "left").withColumn("label", F.coalesce("label", "class"))

    # One member for each tile and label, dealt anew, joins what the tiles have found.
    first = labelled(one)
    heads = first.groupBy("area", "part", "label").agg(F.min("class").alias("class"))
    heads = sets.join(heads.select("class"), "class", "left_semi")
    some = heads.groupBy("area").agg(F.ceil(F.sum(F.length("tokens")) / (8 * TILE_TOKENS)).cast("int").alias("_n"))
    heads = heads.join(some, "area").withColumn("part", F.pmod(F.xxhash64("class"), F.col("_n")).cast("int"))
    two = written(
        one.unionByName(_grouped(heads.select("area", "part", "class", "tokens"), ["area", "part"], _inside(percent))),
        "links",
    )
    # Areas whose members are still in several components: every pair of tiles.
    marked = written(labelled(two), "labelled")
    open_areas = marked.groupBy("area").agg(F.min("label").alias("_x"), F.max("label").alias("_y")).filter("_x <> _y")
    pairs = (
        marked.join(open_areas.select("area"), "area")
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .filter("_other <> part")
        .select(
            "area",
            F.least("part", "_other").alias("i"),
            F.greatest("part", "_other").alias("j"),
            "class",
            "tokens",
            "label",
            (F.col("part") > F.col("_other")).cast("int").alias("side"),
        )
    )
    return two.unionByName(written(_grouped(pairs, ["area", "i", "j"], _across(percent)), "links"))


def similar_documents(
    docs: DataFrame, width: int, percent: int, doc_id: str = "doc_id", text: str = "text", tile_tokens: int = TILE_TOKENS
) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, label) for every row; `row` is xxhash64(text),
    `label` names the component whatever its ids are (NULL: no words, alone).

    Two documents link when 100 |A & B| >= percent |A | B| for their shingle sets.
    """
    source = docs.select(F.xxhash64(text).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = written(_classes(source, width), "classes")
    classes = rows.filter("class is not null").groupBy("class", "short", "n").agg(F.min("doc_id").alias("doc_id"))
    size = rows.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows")).first()
    buckets = max(1, -(-(size["tokens"] or 0) // BUCKET_TOKENS))
    groups = max(LEAST_GROUPS, -(-size["rows"] // GROUP_CLASSES))
    shared = _shared_counts(source, width, buckets, groups)
    near = written(classes.join(shared.filter("shared > 0"), "short").filter(F.col("shared") * 100 >= F.col("n") * percent), "near")
    found = written(_payload(source, near, width), "found")
    placed = written(found.select("class", "short", "n").join(_areas(found, percent), "short"), "placed")
    areas = placed.groupBy("area").agg(F.ceil(F.sum("n") / tile_tokens).cast("int").alias("parts"))
    chosen = lookup_join(placed, areas, ["area"], ["class"], "inner").withColumn(
        "part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    )
    sets = written(found.select("class", "tokens").join(chosen.select("class", "area", "part", "parts"), "class"), "sets")
    linked = components(_links(sets, percent))

    # Smallest id of every component, then of every class.
    named = classes.join(linked.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "label", F.coalesce("label", "class")
    )
    named = written(named.select("class", "label", "doc_id"), "named")
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_class = lookup_join(named.select("class", "label"), smallest, ["label"], ["class"], "inner")
    out = lookup_join(rows, by_class.select("class", "component_id", "label"), ["class"], ["doc_id", "row"], "left")
    return out.select(
        "row",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        "label",
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Query: 3-word shingles, similarity 0.9."""
    return similar_documents(docs, 3, 90).select("doc_id", "n_shingles", "component_id")
