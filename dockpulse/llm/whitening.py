"""Whitening of embeddings by their leading principal components, found by Chebyshev-filtered subspace iteration over Spark passes."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockpulse.llm.workspace import ship, stored

COMPONENTS = 16
# Vectors that the iteration carries beside the wanted ones.
GUARD = 16
# Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
# Passes of one filter, and of the Lanczos run that finds where the spectrum ends below.
DEGREE, LANCZOS = 12, 8
# Certified once every wanted residual is this small against the largest eigenvalue; eigenvalues below the second are zero.
RESIDUAL, ZERO = 1e-12, 1e-12
# Filters at most; without a certificate after that the fit is an error.
MOST_FILTERS = 60
SEED = 11
# Tasks whose partial sums go straight to the driver; those of more are summed in groups first.
DIRECT_TASKS = 64
# Entries from here on have no exact whole number in a double and count as not finite.
LARGEST = float(1 << 46)


def whole_vectors(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, int]:
    """`id, x` of the rows that remain, stored, and the length of their vectors. `x` has the whole numbers, without SHIFT, as 8-byte little-endian integers.

    Dropped are null and empty vectors, vectors with a null, infinite, NaN or too large entry (2 ** 46 and more), and vectors that
    are not of the length that most vectors have (of several such lengths, the greatest).
    """
    ship(__name__)
    sizes = rows.select(F.size(vector).alias("size")).where("size > 0").groupBy("size").count()
    usual = sizes.orderBy(F.col("count").desc(), F.col("size").desc()).first()
    length = usual["size"] if usual else 0

    def run(batches):
        for batch in batches:
            lists = batch.column("vector")
            values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(batch), length)
            fine = (np.abs(values) < LARGEST).all(axis=1)  # false for NaN, which nulls have become
            x = np.floor(SCALE * values[fine]).astype("<i8")
            ids = batch.column("id").filter(pa.array(fine))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in x], pa.binary())], ["id", "x"])

    vectors = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    return stored(vectors.where(F.size("vector") == length).mapInArrow(run, "id bigint, x binary"), "whole-vectors"), length


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), length)


def _sums(x: np.ndarray) -> tuple[list[int], int]:
    """Exact sums of whole numbers by column, and of all squares."""
    largest = int(np.abs(x).max(initial=0))
    if largest**2 * x.size >= 1 << 63:
        x = x.astype(object)
    return [int(v) for v in x.sum(axis=0)], int((x * x).sum())


def _total(partial: DataFrame, tasks: int, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of arrays `part, block` (one row per task). Many are summed in groups first, so the driver gets about the root of their number."""

    def added(table):
        order = np.argsort(table.column("part").to_numpy(), kind="stable")
        blocks = table.column("block").to_pylist()
        total = sum((np.frombuffer(blocks[i]) for i in order), np.zeros(math.prod(shape)))
        first = int(table.column("part").to_numpy().min())
        return pa.table({"part": pa.array([first], pa.int64()), "block": pa.array([total.tobytes()], pa.binary())})

    if tasks > DIRECT_TASKS:
        group = (F.col("part") % math.isqrt(tasks)).alias("group")
        partial = partial.groupBy(group).applyInArrow(added, "part bigint, block binary")
    blocks = dict(partial.collect())
    total = sum((np.frombuffer(blocks[p]) for p in sorted(blocks)), np.zeros(math.prod(shape)))
    return total.reshape(shape)


@dataclass
class Covariance:
    """The covariance of the distinct vectors, as what it does to a block of columns: one pass over the rows each."""

    fit: DataFrame
    length: int
    n: int
    sums: list[int]  # of the numbers without SHIFT
    trace: float
    tasks: int
    passes: int = 0

    @classmethod
    def of(cls, fit: DataFrame, length: int) -> Covariance:
        ship(__name__)

        def run(batches):
            n, total, squares = 0, [0] * length, 0
            for batch in batches:
                x = _matrix(batch.column("x"), length)
                own, more = _sums(x)
                n, total, squares = n + len(x), [a + b for a, b in zip(total, own)], squares + more
            yield pa.RecordBatch.from_pydict({"sums": [json.dumps([n, squares, *total])]})

        parts = [json.loads(r["sums"]) for r in fit.select("x").mapInArrow(run, "sums string").collect()]
        n, squares, *sums = (sum(column) for column in zip([0] * (length + 2), *parts))
        spread = n * squares - sum(s * s for s in sums)
        return cls(fit, length, n, sums, spread / n**2 if n else 0.0, fit.rdd.getNumPartitions())

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def times(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block of columns: the sum over all centred rows y of y (y'block), over n."""
        ship(__name__)
        mean, length, shape = self.mean, self.length, block.shape
        self.passes += 1

        def run(batches):
            from pyspark import TaskContext

            total = np.zeros(shape)
            for batch in batches:
                y = _matrix(batch.column("x"), length) - mean
                total += y.T @ (y @ block)
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "block": [total.tobytes()]})

        partial = self.fit.select("x").mapInArrow(run, "part bigint, block binary")
        return _total(partial, self.tasks, shape) / self.n


@dataclass
class Components:
    """Leading eigenvectors (columns) of a covariance with their eigenvalues, falling, and what certifies them."""

    vectors: np.ndarray
    values: np.ndarray
    residual: float
    filters: int


def lowest(covariance: Covariance, start: np.ndarray, steps: int = LANCZOS) -> float:
    """About where the spectrum ends below: the least Ritz value of a few Lanczos steps less what they left over, 0 at least."""
    basis, alphas, betas = [start / np.linalg.norm(start)], [], []
    for _ in range(min(steps, len(start))):
        w = covariance.times(basis[-1][:, None])[:, 0]
        alphas.append(float(w @ basis[-1]))
        for _ in range(2):
            w -= np.array(basis).T @ (np.array(basis) @ w)
        betas.append(float(np.linalg.norm(w)))
        if betas[-1] <= ZERO * covariance.trace:
            break
        basis.append(w / betas[-1])
    ritz = np.linalg.eigvalsh(np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1) + np.diag(betas[: len(alphas) - 1], -1))
    return max(0.0, float(ritz[0]) - betas[-1])


def filtered(covariance: Covariance, block: np.ndarray, once: np.ndarray, low: float, high: float, top: float, degree: int = DEGREE) -> np.ndarray:
    """A Chebyshev polynomial of the covariance times a block, small on [low, high] and one at `top`; `once` is the covariance times the block."""
    centre, half = (low + high) / 2, (high - low) / 2
    first = sigma = half / (top - centre)
    before, now = block, (once - centre * block) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (covariance.times(now) - centre * now) * (2 * after / half) - before * (sigma * after)
        sigma = after
    return now


def leading(covariance: Covariance, wanted: int = COMPONENTS, guard: int = GUARD, seed: int = SEED) -> Components:
    """The leading eigenvectors: a block is filtered, made orthonormal and turned by Rayleigh-Ritz until every wanted residual is certified.

    The residual of a unit vector bounds how far its value is from an eigenvalue. Equal eigenvalues do no harm: any vectors of their space pass. Left out
    are eigenvalues of (about) zero, by which nothing can be divided. A fit that gets no certificate is an error.
    """
    size = min(covariance.length, wanted + guard)
    if covariance.trace <= 0:
        return Components(np.zeros((covariance.length, 0)), np.zeros(0), 0.0, 0)
    rng = np.random.Generator(np.random.PCG64(seed))
    block = rng.standard_normal((covariance.length, size))
    low = lowest(covariance, rng.standard_normal(covariance.length)) if size < covariance.length else 0.0
    for filters in range(MOST_FILTERS + 1):
        block, _ = np.linalg.qr(block)
        once = covariance.times(block)
        inner = block.T @ once
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, once = block @ turn, once @ turn
        left = np.linalg.norm(once - block * values, axis=0)[:wanted]
        residual = float(left.max() / values[0])
        if residual <= RESIDUAL:
            there = values[:wanted] > ZERO * covariance.trace
            return Components(block[:, :wanted][:, there], values[:wanted][there], residual, filters)
        high = max(float(values[-1]), 1e-6 * float(values[0]))
        block = filtered(covariance, block, once, min(low, 0.9 * high), high, float(values[0]))
    raise ArithmeticError(f"residual {residual:.1e} after {MOST_FILTERS} filters")


@dataclass
class Whitening:
    """What whitens a vector: (x - mean) times the columns of `turn`."""

    n: int
    length: int
    sums: list[int]
    mean: np.ndarray
    turn: np.ndarray
    explained: np.ndarray
    identity_error: float


def whitening(fit: DataFrame, length: int, components: int = COMPONENTS) -> Whitening:
    """Fitted on vectors `x`, each of which counts once."""
    covariance = Covariance.of(fit, length)
    if not covariance.n:
        return Whitening(0, length, [], np.zeros(length), np.zeros((length, 0)), np.zeros(0), 0.0)
    found = leading(covariance, components)
    turn = found.vectors / np.sqrt(found.values)
    return Whitening(
        covariance.n,
        length,
        covariance.sums,
        covariance.mean,
        turn,
        found.values / covariance.trace if len(found.values) else np.zeros(0),
        identity_error(covariance, turn),
    )


def identity_error(covariance: Covariance, turn: np.ndarray) -> float:
    """The largest entry of the whitened vectors' own covariance less the identity, measured in a pass of its own."""
    ship(__name__)
    k, n, mean, length = turn.shape[1], covariance.n, covariance.mean, covariance.length
    if not k:
        return 0.0

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros((k + 1, k))
        for batch in batches:
            w = (_matrix(batch.column("x"), length) - mean) @ turn
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "block": [total.tobytes()]})

    total = _total(covariance.fit.select("x").mapInArrow(run, "part bigint, block binary"), covariance.tasks, (k + 1, k)) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over the columns of (n * x - sums) ** 2; null where that does not fit a long."""
    about = ((n * x.astype(np.float64) - np.array(sums, np.float64)) ** 2).sum(axis=1)
    widest = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if widest**2 * x.shape[1] < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    found: list[int | None] = []
    for row, size in zip(x, about):
        exact = sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) if size < 2.0**64 else None
        found.append(exact if exact is not None and exact < 1 << 63 else None)
    return found


_WHITENED = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """`vec_id, component, n, deviation, whitened, explained, identity_error`: a row per remaining vector and component, from the greatest variance on.

    The fit counts equal vectors once; rows that repeat are whitened each. What is dropped is told at `whole_vectors`. There are as many components as
    have a variance, `components` at most: none, and so no rows, for an empty table or a single distinct vector. `deviation` is null where
    it exceeds a long. A null id stays null; other columns are not looked at.
    """
    ship(__name__)
    kept, length = whole_vectors(rows, vector, key)
    fitted = whitening(stored(kept.select("x").distinct(), "distinct-vectors"), length, components)
    k = fitted.turn.shape[1]
    names = [c.split()[0] for c in _WHITENED.split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch) if k else 0, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column("x"), length)
                m = len(x)
                repeat = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(repeat),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, fitted.n, np.int64)),
                        pa.array(deviations(x, fitted.n, fitted.sums), pa.int64()).take(repeat),
                        pa.array(((x - fitted.mean) @ fitted.turn).ravel()),
                        pa.array(np.tile(fitted.explained, m)),
                        pa.array(np.full(m * k, fitted.identity_error)),
                    ],
                    names,
                )

    return kept.mapInArrow(run, _WHITENED)
