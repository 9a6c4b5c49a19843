"""Packing of documents into fixed-length token sequences by bounded-space best fit.

Documents are tokenised, an end token is added, and those longer than a sequence are cut
into full pieces, the remainder first. Full pieces are sequences of their own. The
others are packed online: a fixed number of bins is open, filed by free space; a bit set
keyed by free space finds the tightest bin that takes a piece (the lowest set bit from
the piece's length on); when all bins are open and none fits, the fullest one closes.

Pieces arrive in hash order of row and piece, so that long and short ones meet while bins
are open, however many pieces a task has. They are dealt over as many tasks as their
number asks for (`pieces_per_task`), so a task holds a bounded number of pieces. Tokens
are not moved: packing needs lengths only, and `assemble` brings tokens and places together.

Token ids of a text are those of its parts. A part begins at a blank or line break, but
for those that lie inside a run of white space: the tokeniser's own splitting parts a text
where white space begins and before its last character, so parts that such a run holds
together are chained to one. The distinct parts of a batch are merged as one text, since
the splitting parts them again, and their ids are told apart by the bytes that they stand
for; parts that have white space at an end or twice in a row are merged one by one. Texts
with special tokens are tokenised whole: these have their own ids, as the vocabulary file
says. Runs of RUN or more white-space characters are merged without the splitting pattern,
whose search would need a stack as deep as the run is long.

Defined results: NULL and empty texts are one piece, the end token alone; NULL ids and
repeated rows are packed like others (`row` tells them apart); ties of the hash go by row
and piece; an empty table gives no rows. Runs of any one character may be as long as a text
can be. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions import ship_by_value
from tallymark.llm.common import give_back, spans, written

ship_by_value(__name__)

#: Fixed splitting pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern sees it, but for the line break.
BLANKS = r"\x09\x0b-\x0d \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Words that leave white space or the end of a text after their lead, or before what follows.
BLANK_START = rf"^\n?(?:$|[{BLANKS}])"
BLANK_END = rf"(?:^|[{BLANKS}\n])$"
BLANK_RUN = rf"[{BLANKS}\n]{{2}}"
#: White-space runs that the splitting pattern does not see.
RUN = 1000
_LONG_RUN = re.compile(
    r"[\x09-\x0d \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN
)
SEQUENCE = 1024
END = 2
OPEN_BINS = 1024
PIECES_PER_TASK = 1 << 16
#: Bytes of text whose parts are told apart at a time.
BATCH = 2 << 20
#: Bytes of distinct parts merged at a time, and parts whose ids are brought together.
MERGED = 1 << 20
GATHERED = 1 << 18


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand
    for themselves, the others for 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PartTokens:
    """Token ids of texts by way of their distinct parts.

    `path` is a byte-level BPE vocabulary of the `tokenizers` library. Its merges are
    applied by tiktoken, which gives the same ids (tested) at a fourth of the time.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.special = {token["content"]: token["id"] for token in content["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        letters = _byte_letters()
        ranks = {
            bytes(letters[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in self.special
        }
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes[list(ranks.values())] = list(map(len, ranks))

    def whole(self, text: str) -> list[int]:
        """Ids of any text."""
        ids: list[int] = []
        for i, segment in enumerate(self.at_special.split(text) if self.at_special else [text]):
            if i % 2:
                ids.append(self.special[segment])
                continue
            begin = 0
            for run in _LONG_RUN.finditer(segment):
                # The last character of a run belongs to what follows it.
                end = run.end() - (run.end() < len(segment))
                ids += self.encoding.encode_ordinary(segment[begin : run.start()])
                ids += self.encoding._encode_single_piece(segment[run.start() : end])
                begin = end
            ids += self.encoding.encode_ordinary(segment[begin:])
        return ids

    def _merged(self, text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text and how many each of its parts has; `sizes` are the parts' bytes."""
        ids = np.array(self.encoding.encode_ordinary(text), np.uint32)
        ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(sizes)) + 1
        return ids, np.diff(ends, prepend=0)

    def _parts(
        self, words: pa.Array, chains: list[np.ndarray], used: np.ndarray, apart: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the parts `used`, and for every part where its ids begin and how many they
        are. Part i is word i after a blank (a line break is its own lead), part
        len(words) + i is word i at the beginning of a text; then come the chains. Words
        marked in `apart`, and chains, are merged one by one."""
        n = len(words)
        values = words.to_numpy(zero_copy_only=False)
        breaks = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
        size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.concatenate([size + ~breaks, size + 1])
        first, count = np.zeros(2 * n + len(chains), np.int64), np.zeros(2 * n + len(chains), np.int64)
        ids: list[np.ndarray] = []
        total = 0
        single = (used >= 2 * n) | apart[used % n]
        for code in used[single].tolist():
            members = chains[code - 2 * n].tolist() if code >= 2 * n else [code]
            text = "".join(values[i - n] if i >= n else values[i] if breaks[i] else " " + values[i] for i in members)
            ids.append(np.array(self.whole(text), np.uint32))
            first[code], count[code] = total, len(ids[-1])
            total += len(ids[-1])
        used = used[~single]
        # Parts at a beginning are merged after a line break, whose id is left out.
        for head, codes in enumerate((used[used < n], used[used >= n])):
            ends = np.cumsum(size[codes])
            cuts = np.flatnonzero(np.diff(ends // MERGED, prepend=0)).tolist()
            for low, high in zip([0, *cuts], [*cuts, len(codes)], strict=True):
                block = codes[low:high]
                if not len(block):
                    continue
                lead = "\n" if head else " "
                text = lead + lead.join(values[block % n])
                merged, counts = self._merged(text if head else text.replace(" \n", "\n"), size[block])
                first[block] = total + np.cumsum(counts) - counts + head
                count[block] = counts - head
                ids.append(merged)
                total += len(merged)
        return np.concatenate([np.zeros(0, np.uint32), *ids]), first, count

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text in turn."""
        if not texts:
            return
        parted = pa.array(texts, pa.large_string())
        marked = np.zeros(len(texts), bool)
        for mark in self.special:
            marked |= pc.match_substring(parted, mark).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.replace_substring(parted, "\n", " \n"), " ")
        flat = lists.flatten().dictionary_encode()
        words, codes = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        n = len(words)
        start, end, run = (
            pc.match_substring_regex(words, blank).to_numpy(zero_copy_only=False) for blank in (BLANK_START, BLANK_END, BLANK_RUN)
        )
        # The first part of a text has no blank before it: it is kept apart.
        heads = offsets[:-1]
        chained = np.zeros(len(codes), bool)
        chained[1:] = end[codes[:-1]] & start[codes[1:]]
        # Nothing comes before the lead of a second part whose first is empty.
        second = heads[np.diff(offsets) > 1] + 1
        chained[second] &= ~pc.equal(words, "").to_numpy(zero_copy_only=False)[codes[second - 1]]
        chained[heads] = False
        codes[heads] += n
        codes, offsets, chains = _joined(codes, offsets, chained, 2 * n)
        seen = np.zeros(2 * n + len(chains), bool)
        seen[codes[np.repeat(~marked, np.diff(offsets))]] = True
        ids, first, count = self._parts(words, chains, np.flatnonzero(seen), start | end | run)
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + GATHERED, "right")) - 1)
            mine = codes[offsets[low] : offsets[high]]
            ends = np.cumsum(count[mine])
            begins = np.repeat(first[mine] - ends + count[mine], count[mine])
            together = ids[np.arange(len(begins)) + begins]
            cuts = [0, *ends[offsets[low + 1 : high + 1] - offsets[low] - 1].tolist()]
            for i in range(low, high):
                if marked[i]:
                    yield np.array(self.whole(texts[i]), np.uint32)
                else:
                    yield together[cuts[i - low] : cuts[i - low + 1]]
            low = high


def _joined(
    codes: np.ndarray, offsets: np.ndarray, chained: np.ndarray, unused: int
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """codes and offsets with one code, from `unused` on, for each run of codes in which all
    but the first are `chained`; and the runs that these codes stand for."""
    keep = ~chained
    begins = np.flatnonzero(keep[:-1] & chained[1:])
    ends = np.flatnonzero(chained & np.append(keep[1:], True)) + 1
    number: dict[bytes, int] = {}
    named = [number.setdefault(codes[a:b].tobytes(), unused + len(number)) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
    codes[begins] = named
    offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return codes[keep], offsets, [np.frombuffer(run, np.int64) for run in number]


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    sequence: int = SEQUENCE,
    end: int = END,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """row, doc_id, piece, start, length, ids_crc32 (and ids) of every piece.

    `row` counts rows, so that repeated ids stay apart; it is fixed once written."""
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")
    )
    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for frame in frames:
            tokens = tokens or PartTokens(tokenizer)
            for low, high in spans(frame.column(2), BATCH):
                rows = frame.column(0).slice(low, high - low).to_pylist()
                named = frame.column(1).slice(low, high - low).to_pylist()
                texts = [one or "" for one in frame.column(2).slice(low, high - low).to_pylist()]
                out: list[list] = [[] for _ in names]
                held = []
                for row, name, ids in zip(rows, named, tokens.encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    first = len(ids) % sequence or sequence
                    cuts = [0, *range(first, len(ids) + 1, sequence)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        crc = zlib.crc32(ids[a:b].tobytes())
                        for column, value in zip(out, (row, name, piece, a, b - a, crc), strict=True):
                            column.append(value)
                        if with_ids:
                            held.append(pa.array(ids[a:b].astype(np.int32)))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(v, t) for v, t in zip(out, types, strict=True)]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum([len(one) for one in held])]).astype(np.int32)
                    flat = pa.concat_arrays([pa.array([], pa.int32()), *held])
                    arrays.append(pa.ListArray.from_arrays(ends, flat))
                yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)
        tokens = None
        give_back()

    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return source.mapInArrow(read, schema)


class OpenBins:
    """Open bins by free space; at most `most` of them."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most, self.open, self.made = capacity, most, 0, 0
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _file(self, bin_id: int, free: int) -> None:
        if free:
            self.by_free[free].append(bin_id)
            self.bits |= 1 << free
            self.open += 1

    def _take(self, free: int) -> int:
        bin_id = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """Bin and place for a piece: in the fullest bin that takes it, or a new one."""
        fitting = self.bits >> length
        if fitting:
            free = (fitting & -fitting).bit_length() - 1 + length
            bin_id = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_id, free = self.made, self.capacity
            self.made += 1
        self._file(bin_id, free - length)
        return bin_id, self.capacity - free


def pack(
    pieces: DataFrame,
    sequence: int = SEQUENCE,
    open_bins: int = OPEN_BINS,
    pieces_per_task: int = PIECES_PER_TASK,
) -> DataFrame:
    """pieces (a written table) with sequence_id and offset."""
    short = pieces.filter(F.col("length") < sequence)
    tasks = max(1, -(-short.count() // pieces_per_task))
    # Another hash than that of the dealing; it says nothing about the length.
    mixed = F.xxhash64("row", "piece")
    dealt = short.repartition(tasks, "row", "piece").sortWithinPartitions(mixed, "row", "piece")

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(sequence, open_bins)
        base = TaskContext.get().partitionId() << 33
        for frame in frames:
            lengths = frame.column(frame.schema.get_field_index("length")).to_pylist()
            placed = [bins.place(length) for length in lengths]
            columns = [
                *frame.columns,
                pa.array([2 * (base + bin_id) for bin_id, _ in placed], pa.int64()),
                pa.array([offset for _, offset in placed], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*frame.schema.names, "sequence_id", "offset"])

    packed = dealt.mapInArrow(read, f"{_ddl(short)}, sequence_id long, offset long")
    # Full pieces get odd numbers, bins even ones.
    full = pieces.filter(F.col("length") >= sequence).select(
        "*",
        (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )
    return packed.unionByName(full)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def assemble(packed: DataFrame, pieces: DataFrame) -> DataFrame:
    """sequence_id and its token ids in order; a sequence has at most `sequence` tokens."""
    joined = packed.select("row", "piece", "sequence_id", "offset").join(pieces.select("row", "piece", "ids"), ["row", "piece"])
    ordered = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_all"))
    return ordered.select("sequence_id", F.flatten("_all.ids").alias("ids"))


def best_fit(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Query: the place of every piece of every document."""
    pieces = written(token_pieces(docs, tokenizer), "pieces")
    return pack(pieces).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
