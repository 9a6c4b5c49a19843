"""Helpers of the training-data operators: shared folders, crc folds and word batches.

The Arrow functions of this package get batches of whole rows. `word_batch` splits all
texts of a batch at once and keeps each distinct word once; windows of words are then
arrays of 64-bit hashes. Nothing here depends on how rows fall into batches or tasks.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import ship_by_value
from tallymark.session import new_shared_path

ship_by_value(__name__)

#: A word: what ASCII white space separates (fixed by the tables' contract).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and there for every
    later task when an executor is lost. Also cuts the lineage."""
    path = new_shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def neutral(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1, ..., and the new names by the old ones: what an
    operator adds meanwhile cannot clash with them."""
    names = {name: f"c{i}" for i, name in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def restored(names: dict[str, str], results: tuple[str, ...] | list[str] = ()) -> list[Column]:
    """The columns under their own names, but for those that results are named like."""
    return [F.col(new).alias(old) for old, new in names.items() if old not in results]


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; NULL ids have no fold."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(folds)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


@dataclass
class WordBatch:
    """Words of a batch of texts. `codes` index `words`; text i has the codes
    offsets[i]:offsets[i + 1]."""

    codes: np.ndarray
    offsets: np.ndarray
    words: pa.Array

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def owner(self) -> np.ndarray:
        """Text number of every word."""
        return np.repeat(np.arange(len(self)), self.sizes)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word; equal words have equal hashes everywhere."""
        if not len(self.words):
            return np.zeros(0, np.uint64)
        values = np.array(self.words.to_pylist(), dtype=object)
        return mix64(pd.util.hash_array(values, categorize=False))[self.codes]


def word_batch(texts: pa.Array, lower: bool = True) -> WordBatch:
    """NULL texts have no words."""
    # Copied: lower-casing a slice in place of its own array reads beyond the slice.
    texts = pa.array([text or "" for text in texts.to_pylist()], pa.large_string())
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    words = coded.dictionary
    blank = pc.index(words, pa.scalar("", words.type)).as_py()
    if blank >= 0:
        real = codes != blank
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    return WordBatch(codes, offsets, words)


def windows(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of n words that lies in one text, and where it starts."""
    total = len(hashes)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rolled = np.zeros(total - n + 1, np.uint64)
    for j in range(n):
        rolled = rolled * _STEP + hashes[j : total - n + 1 + j]
    inside = np.zeros(total + 1, bool)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.arange(total, dtype=np.int64)
    inside = starts[: total - n + 1] + n <= ends[: total - n + 1]
    return mix64(rolled[inside]), starts[: total - n + 1][inside]


def packed_ints(values: np.ndarray) -> bytes:
    """Integers of 32 bits by byte, low bytes first, compressed."""
    import zstandard

    planes = values.astype("<i4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked_ints(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def give_back() -> None:
    """Freed memory goes back to the system. Workers outlive a task, and what an earlier
    stage has used would count against the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        # Another C library keeps its memory.
        pass


def spans(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text, or of one longer text: what a task
    holds as arrays at a time does not grow with the batch."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)
