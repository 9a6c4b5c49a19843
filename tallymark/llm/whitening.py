"""Embedding whitening by Chebyshev-filtered subspace iteration.

A vector's entries become integers x = floor(64 c) + 1000000. The fit list is every
distinct x vector once; V is its covariance (divisor n). V is never formed: all that is
asked of it are products V Q = (X - mean)' ((X - mean) Q) / n with a thin block Q, each a
pass over the written fit list whose tasks return their own sums, which Spark adds up by
entry. Only such d x block sums reach the driver, whatever the number of rows.

* A cycle applies a Chebyshev polynomial of V to the block by its three-term recurrence,
  one pass a degree. The interval from 0 to the smallest Ritz value is damped, directions
  above it grow. QR, one more pass and Rayleigh-Ritz give the next block.
* A pair is certified by its residual |V q - e q|, known from the Rayleigh-Ritz pass
  without another one. Certified leading pairs are locked and taken out of the rows of
  later passes, so small eigenvalues beside huge ones keep their own precision.
* Passes go on until the `components` leading pairs are certified (or the rest of V is
  zero); a block that makes no progress for `patience` cycles at rounding level counts as
  certified with the residual that it reports, anything else is an error.

Centring is exact: x - S div n is an integer, and only (S mod n) / n is subtracted as a
double. Sums S, n and the deviation are integers without overflow.

Defined results: rows whose vector is NULL, is empty, holds NULL, NaN or infinite entries,
or has another length than the commonest one (ties: the longest) have no result. Scaled
entries beyond +-2^50 count as that. NULL and repeated ids come out, a row each. Fewer
components come out where V has a smaller rank than asked for (none for an empty table or
for a single distinct vector): those with e at most 1e-24 of the trace count as zero.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import ship_by_value
from tallymark.llm.common import written

ship_by_value(__name__)

#: Fixed by the tables' contract.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Scaled entries are held within this bound, so sums over a block fit in 64 bits.
BOUND = 2.0**50
BLOCK_ROWS = 2048
#: Residual, relative to the largest open eigenvalue, that certifies a pair.
TOLERANCE = 1e-14
#: Rounding level: residuals that no longer fall are accepted below it.
STALLED = 1e-11
#: Pairs below this share of the largest open one wait until that is locked.
DECADE = 1e-6
ZERO = 1e-24
MAX_CYCLES = 200


def integer_vector(vector: Column) -> Column:
    """x of a vector, NULL for what is no finite vector."""
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(math.inf)))

    def entry(c: Column) -> Column:
        scaled = F.lit(float(SCALE)) * c.cast("double")
        held = F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), scaled))
        return F.floor(held) + F.lit(SHIFT)

    return F.when(finite & (F.size(vector) > 0), F.transform(vector, entry))


@dataclass
class Centre:
    """n distinct vectors and the integer sums of their entries."""

    n: int
    sums: list[int]

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole part of the mean, and the rest as a double."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return whole, np.array([(s % self.n) / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.parts()
        return (x - whole).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sum over dimensions of (n x - S)^2 for each row."""
        whole, _ = self.parts()
        off = x - whole
        rest = [s % self.n for s in self.sums]
        largest = int(np.abs(off).max(initial=0)) * self.n + self.n
        if largest * largest * max(1, len(rest)) < 2**62:
            scaled = off * np.int64(self.n) - np.array(rest, np.int64)
            return (scaled * scaled).sum(axis=1).tolist()
        return [sum((a * self.n - r) ** 2 for a, r in zip(row, rest, strict=True)) for row in off.tolist()]


@dataclass
class Basis:
    """Leading eigenvectors (columns) and eigenvalues of V, its trace, the certified
    residuals and the number of passes that were made."""

    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimension)


def fit_blocks(vectors: DataFrame, dimension: int) -> DataFrame:
    """Distinct rows of `x`, packed: blocks of up to BLOCK_ROWS vectors, with the sums of
    their entries."""

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for low in range(0, frame.num_rows, BLOCK_ROWS):
                x = _matrix(frame.column(0).slice(low, BLOCK_ROWS), dimension)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([len(x)], pa.int64()),
                        pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64())),
                        pa.array([x.astype("<i8").tobytes()], pa.binary()),
                    ],
                    ["n", "sums", "block"],
                )

    # A vector held by many rows is merged before anything moves.
    distinct = vectors.groupBy("x").agg(F.lit(1).alias("one")).select("x")
    return written(distinct.mapInArrow(pack, "n long, sums array<long>, block binary"), "vectors")


def centre_of(blocks: DataFrame) -> Centre:
    """Exact sums; one row per dimension reaches the driver."""
    rows = (
        blocks.select("n", F.posexplode("sums").alias("at", "value"))
        .groupBy("at")
        .agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))
        .orderBy("at")
        .collect()
    )
    return Centre(int(rows[0].n) if rows else 0, [int(r.total) for r in rows])


Kernel = Callable[[np.ndarray], np.ndarray]


def gather(blocks: DataFrame, centre: Centre, kernel: Kernel, shape: tuple[int, int]) -> np.ndarray:
    """Sum of kernel(centred block) over the fit list. Tasks add up their own blocks and
    return one row per matrix entry; those are added by Spark before they reach the driver."""
    height, width = shape
    dimension = centre.dimension

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for frame in frames:
            for block in frame.column(0):
                x = np.frombuffer(block.as_py(), "<i8").reshape(-1, dimension)
                total += kernel(centre.centred(x))
        at = pa.array(np.arange(height * width, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([at, pa.array(total.ravel())], ["at", "value"])

    parts = blocks.select("block").mapInArrow(read, "at int, value double")
    sums = parts.groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(height * width)
    out[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    return out.reshape(shape)


def _degree(top: float, cut: float) -> int:
    """Polynomial degree: the largest direction may outgrow the smallest by some 1e8."""
    if cut <= 0 or top <= cut:
        return 8
    x = 2 * top / cut - 1
    return int(min(12, max(2, 18.4 / math.log(x + math.sqrt(x * x - 1)))))


def leading_pairs(blocks: DataFrame, centre: Centre, components: int = COMPONENTS, patience: int = 3) -> Basis:
    """The leading certified eigenpairs of the fit list's covariance."""
    d, n = centre.dimension, centre.n
    passes = 1
    variances = gather(blocks, centre, lambda c: (c * c).sum(axis=0, keepdims=True), (1, d))[0] / n
    trace = float(variances.sum())
    locked, values, residuals = np.zeros((d, 0)), [], []
    rng = np.random.default_rng(0)
    floor = ZERO * trace
    block, history, cycles = None, [], 0

    def times(q: np.ndarray) -> np.ndarray:
        """Open part of V times q: rows lose what lies along locked vectors first."""
        nonlocal passes
        passes += 1
        base = locked

        def kernel(c: np.ndarray) -> np.ndarray:
            if base.shape[1]:
                c = c - (c @ base) @ base.T
            return c.T @ (c @ q)

        out = gather(blocks, centre, kernel, (d, q.shape[1])) / n
        return out - base @ (base.T @ out)

    def orthonormal(q: np.ndarray) -> np.ndarray:
        for _ in range(2):
            q = np.linalg.qr(q - locked @ (locked.T @ q))[0]
        return q

    while trace > 0 and len(values) < min(components, d):
        rest = d - len(values)
        width = min(rest, 3 * components) if block is None else block.shape[1]
        if block is None or width < min(rest, 2 * (components - len(values))):
            width = min(rest, 3 * components)
            more = width - (0 if block is None else block.shape[1])
            fresh = rng.standard_normal((d, more))
            block = orthonormal(fresh if block is None else np.hstack([block, fresh]))
        product = times(block)
        ritz, turn = np.linalg.eigh((block.T @ product + product.T @ block) / 2)
        turn, ritz = turn[:, ::-1], ritz[::-1]
        block, product = block @ turn, product @ turn
        error = np.linalg.norm(product - block * ritz, axis=0)
        top = float(ritz[0])
        if top <= floor:
            break
        wanted = min(components - len(values), width)
        close = int((ritz[:wanted] > DECADE * top).sum())
        worst = float(error[:close].max()) / top
        history.append(worst)
        stalled = len(history) > patience and worst > 0.5 * min(history[:-patience]) and worst <= STALLED
        sure = close if stalled else int(np.argmax(np.append(error[:close] > TOLERANCE * top, True)))
        if sure:
            locked = np.hstack([locked, block[:, :sure]])
            values += ritz[:sure].tolist()
            residuals += error[:sure].tolist()
            block, product, ritz = block[:, sure:], product[:, sure:], ritz[sure:]
            if not block.shape[1]:
                block = None
            if block is None or len(values) >= min(components, d) or sure == close:
                history = []
                continue
            width, rest, top = width - sure, rest - sure, float(ritz[0])
        cycles += 1
        if cycles > MAX_CYCLES:
            raise ArithmeticError(f"no certified eigenpairs: residual {worst:.1e} after {passes} passes")
        if width == rest:
            # The block spans all that is open; only rounding is left to settle.
            block = orthonormal(block)
            continue
        # Chebyshev recurrence, scaled by its value at the largest Ritz value. The first
        # product is the one that Rayleigh-Ritz has made.
        half = max(float(ritz[-1]), floor) / 2
        sigma = first = half / (top - half)
        before, now = block, (product - half * block) * (sigma / half)
        for _ in range(_degree(top, 2 * half) - 1):
            following = 1 / (2 / first - sigma)
            before, now = now, (times(now) - half * now) * (2 * following / half) - sigma * following * before
            sigma = following
        block = orthonormal(now)
    order = np.argsort(-np.array(values), kind="stable")[:components]
    return Basis(centre, locked[:, order], np.array(values)[order], trace, np.array(residuals)[order], passes)


def identity_error(blocks: DataFrame, basis: Basis) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(basis.values)
    if not k:
        return 0.0
    project = basis.vectors / np.sqrt(basis.values)

    def kernel(c: np.ndarray) -> np.ndarray:
        w = c @ project
        return np.vstack([w.T @ w, w.sum(axis=0)])

    sums = gather(blocks, basis.centre, kernel, (k + 1, k)) / basis.centre.n
    mean = sums[k]
    return float(np.abs(sums[:k] - np.outer(mean, mean) - np.eye(k)).max())


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Basis, float]:
    """Basis and identity error of integer vectors (column x)."""
    sizes = vectors.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return Basis(Centre(0, []), np.zeros((0, 0)), np.zeros(0), 0.0, np.zeros(0), 0), 0.0
    blocks = fit_blocks(vectors.filter(F.size("x") == sizes["size"]), sizes["size"])
    basis = leading_pairs(blocks, centre_of(blocks), components)
    return basis, identity_error(blocks, basis)


def project(rows: DataFrame, basis: Basis, error: float) -> DataFrame:
    """One row for each of `rows` (vec_id, x) and component."""
    d, k = basis.centre.dimension, len(basis.values)
    schema = (
        "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double,"
        " identity_error double"
    )
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    scaled = basis.vectors / np.sqrt(basis.values)
    explained = basis.values / basis.trace
    centre = basis.centre

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for low in range(0, frame.num_rows, BLOCK_ROWS):
                ids, x = frame.column(0).slice(low, BLOCK_ROWS), _matrix(frame.column(1).slice(low, BLOCK_ROWS), d)
                m = len(x)
                whitened = centre.centred(x) @ scaled
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, centre.n)),
                        pa.array(centre.deviations(x), pa.decimal128(38, 0)).take(each),
                        pa.array(whitened.ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.filter(F.size("x") == d).mapInArrow(read, schema)


def whiten(
    embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """Whitened coordinates of every finite vector; deviation as decimal(38,0)."""
    rows = embeddings.select(
        F.col(vec_id).cast("long").alias("vec_id"), integer_vector(F.col(embedding)).alias("x")
    ).filter("x is not null")
    basis, error = fit(rows.select("x"), components)
    return project(rows, basis, error)


def embedding_whitening(embeddings: DataFrame) -> DataFrame:
    """Query: 16 components. A deviation that 64 bits don't hold is NULL."""
    return whiten(embeddings).withColumn("deviation", F.expr("try_cast(deviation as long)"))
