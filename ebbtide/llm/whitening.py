"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Entries become integers (``floor(SCALE * c) + SHIFT``), so counts, sums and centred rows ``n * x - S`` are exact.
The centred rows X are written once in blocks. Every step is one distributed pass with two products: u = X v, with
its parts along all earlier left vectors, and the transpose of X times u; u is made orthogonal to all earlier left
vectors (in another pass too, where they took a noticeable part of it) and the next v to all earlier right ones.
Left vectors are as long as the corpus; none is stored, each is kept by its coefficients on the columns of X, and
tasks recompute what they need of it from their rows, so a lost executor loses nothing. A task reads many blocks
and sends one vector of sums, about twice the dimension long; there are ``WAVES`` tasks per core at most. The bidiagonal matrix, as small as the dimension, is decomposed on the driver: its right vectors give the
components, its singular values the deviations.

The steps end when the wanted components have converged and all the variance that no step has seen is smaller
than theirs, so that a repeated deviation cannot be missed; at the latest after as many steps as dimensions. When
the space is exhausted a new start outside it goes on.

Defined results: rows whose vector is null, empty or holds null, NaN or infinite entries leave, and so do vectors of
another length than the most frequent one; entries beyond ``LARGEST`` in absolute value count as ``LARGEST``;
repeated rows and ids are rows of their own, null ids stay; components without variance (below ``FLAT`` of the
largest deviation) are not returned, so a table without rows or of equal rows gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.vectors import usable
from ebbtide.session import materialize

SCALE, SHIFT = 1024, 100_000
LARGEST = 1 << 20
COMPONENTS = 8
BLOCK_BYTES = 1 << 20
FLAT = 1e-9
TINY = 1e-13
LEAN = 1e-3
WAVES = 4
SEED = 42


@dataclass(frozen=True)
class Whitening:
    """A fitted transformation: ``components`` has one unit row per deviation, largest deviation first."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    steps: int
    identity_error: float = math.nan


def integer_rows(rows: DataFrame, vector: str, row_id: str) -> tuple[DataFrame, int]:
    """``id, x`` (integers of the entries) of the usable rows, written once; and the dimension."""
    kept, length = usable(rows, vector)
    entry = lambda c: F.floor(F.lit(SCALE) * F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c.cast("double")))) + SHIFT
    return materialize(kept.select(F.col(row_id).alias("id"), F.transform(vector, entry).alias("x"))), length


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def column_sums(rows: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Number of rows and exact sum of each place of ``x``."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += _matrix(batch.column(0), width).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], names=["place", "total"])

    found = rows.select("x").mapInArrow(summed, "place long, total long").groupBy("place").agg(F.sum("total").alias("total"))
    sums = np.zeros(width, np.int64)
    for row in found.collect():
        sums[row.place] = row.total
    return rows.count(), sums


def centred_blocks(rows: DataFrame, n: int, sums: np.ndarray) -> DataFrame:
    """``ids, block``: rows ``n * x - S`` as 64-bit integers, many to a block, written once."""
    width, kind = len(sums), dict(rows.dtypes)["id"]
    most = max(1, BLOCK_BYTES // (8 * width))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                piece = batch.slice(at, most)
                data = n * _matrix(piece.column(1), width) - sums
                ids = pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([data.tobytes()], pa.binary())], names=["ids", "block"])

    return materialize(rows.select("id", "x").mapInArrow(blocks, f"ids array<{kind}>, block binary"))


def _integers(block: pa.Scalar, width: int) -> np.ndarray:
    return np.frombuffer(block.as_buffer(), np.int64).reshape(-1, width)


def block_total(blocks: DataFrame, n: int, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``part(centred rows)``, a vector, over all blocks, task by task in order; one vector leaves a task."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in batch.column(0):
                found = part(_integers(block, width) / n)
                total = found if total is None else total + found
        if total is not None:
            task = pa.array([TaskContext.get().partitionId()], pa.int32())
            yield pa.RecordBatch.from_arrays([task, pa.array([total.tolist()], pa.list_(pa.float64()))], names=["task", "total"])

    tasks = WAVES * blocks.sparkSession.sparkContext.defaultParallelism
    partial = blocks.select("block").coalesce(tasks).mapInArrow(summed, "task int, total array<double>").collect()
    return np.array([row.total for row in sorted(partial)]).sum(0)


def _outside(basis: list[np.ndarray], v: np.ndarray) -> np.ndarray:
    """``v`` without its parts along ``basis``; twice, so that rounding leaves nothing of them."""
    if basis:
        held = np.array(basis)
        for _ in range(2):
            v = v - held.T @ (held @ v)
    return v


def bidiagonalise(
    product: Callable[[Callable[[np.ndarray], np.ndarray]], np.ndarray], width: int, wanted: int, seed: int = SEED
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``sigma, right vectors (rows), steps`` of X, of which only ``product`` (sums over its rows) is known.

    ``P`` holds the left vectors by their coefficients (u = X p), ``Z`` their images under the transpose.
    """
    total = float(product(lambda y: np.array([(y * y).sum()]))[0])
    tiny = TINY * math.sqrt(total)
    rng = np.random.default_rng(seed)
    start = rng.standard_normal(width)
    v = start / np.linalg.norm(start)
    right: list[np.ndarray] = []
    P, Z = np.zeros((width, 0)), np.zeros((width, 0))
    alphas: list[float] = []
    betas: list[float] = []
    while total > 0:
        j = len(alphas)
        q = v - betas[-1] * P[:, -1] if j else v
        while True:

            def both(y: np.ndarray, q=q, P=P) -> np.ndarray:
                u = y @ q
                return np.concatenate([[u @ u], (y @ P).T @ u, y.T @ u])

            found = product(both)
            along = found[1 : 1 + j]  # parts along the earlier left vectors, taken off u, and off its image through Z
            alpha = math.sqrt(max(0.0, found[0] - along @ along))
            q, z = q - P @ along, found[1 + j :] - Z @ along
            if alpha <= tiny or np.linalg.norm(along) <= LEAN * alpha:
                break
        if alpha <= tiny:
            alpha, q, z = 0.0, np.zeros(width), np.zeros(width)
        else:
            q, z = q / alpha, z / alpha
        right.append(v)
        alphas.append(alpha)
        P, Z = np.column_stack([P, q]), np.column_stack([Z, z])
        if len(right) == width:
            break
        w = _outside(right, z - alpha * v)
        beta = float(np.linalg.norm(w))
        if beta <= tiny:
            w, beta = _outside(right, rng.standard_normal(width)), 0.0
        unseen = total - sum(a * a for a in alphas) - sum(b * b for b in betas)
        left, sigma, _ = np.linalg.svd(_bidiagonal(alphas, betas))
        kept = min(wanted, width)
        if len(sigma) >= kept and unseen < 0.5 * sigma[kept - 1] ** 2 and (beta * np.abs(left[-1, :kept]) <= tiny).all():
            break
        betas.append(beta)
        v = w / np.linalg.norm(w)
    if not alphas:
        return np.zeros(0), np.zeros((0, width)), 0
    _, sigma, turned = np.linalg.svd(_bidiagonal(alphas, betas[: len(alphas) - 1]))
    return sigma, turned @ np.array(right), len(alphas)


def _bidiagonal(alphas: list[float], betas: list[float]) -> np.ndarray:
    return np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1) if len(alphas) > 1 else np.diag(alphas)


def fit(blocks: DataFrame, n: int, sums: np.ndarray, components: int = COMPONENTS, seed: int = SEED) -> Whitening:
    """The whitening of all rows of ``blocks``, and how far their whitened covariance is from the identity."""
    width = len(sums)
    sigma, right, steps = bidiagonalise(lambda part: block_total(blocks, n, width, part), width, components, seed)
    keep = min(components, int((sigma > FLAT * sigma[0]).sum()) if len(sigma) else 0)
    held = right[:keep] / np.linalg.norm(right[:keep], axis=1, keepdims=True)
    total = float(block_total(blocks, n, width, lambda y: np.array([(y * y).sum()]))[0])
    if not keep:
        return Whitening(n, sums, held, np.zeros(0), np.zeros(0), steps)
    deviations = sigma[:keep] / math.sqrt(n)
    turn = (held / deviations[:, None]).T

    def moments(y: np.ndarray) -> np.ndarray:
        w = y @ turn
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    found = block_total(blocks, n, width, moments) / n
    mean, square = found[:keep], found[keep:].reshape(keep, keep)
    error = float(np.abs(square - np.outer(mean, mean) - np.eye(keep)).max())
    return Whitening(n, sums, held, deviations, sigma[:keep] ** 2 / total, steps, error)


def squared_deviation(rows: np.ndarray) -> list[int]:
    """Exact sum of squares of each row of integers; beyond 64 bits by Python integers."""
    largest = int(np.abs(rows).max(initial=0))
    if largest * largest * rows.shape[1] < 1 << 63:
        return (rows * rows).sum(1).tolist()
    return [sum(int(v) ** 2 for v in row) for row in rows]


def transform(blocks: DataFrame, model: Whitening) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: one row per vector and component."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    count, width, n = len(model.deviations), len(model.sums), model.n
    schema = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not count:
        return blocks.sparkSession.createDataFrame([], schema)
    turn = (model.components / model.deviations[:, None]).T

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, block in zip(batch.column(0), batch.column(1), strict=True):
                exact = _integers(block, width)
                m = len(exact)
                each = np.repeat(np.arange(m), count)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values.take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * count, n)),
                        pa.array(squared_deviation(exact), pa.decimal128(38, 0)).take(pa.array(each)),
                        pa.array(((exact / n) @ turn).ravel()),
                        pa.array(np.tile(model.explained, m)),
                        pa.array(np.full(m * count, model.identity_error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return blocks.mapInArrow(rows, schema)


def whiten(rows: DataFrame, vector: str = "embedding", row_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Fit on all usable rows and transform them; see ``transform`` for the columns."""
    clean, width = integer_rows(rows, vector, row_id)
    n, sums = column_sums(clean, width) if width else (0, np.zeros(0, np.int64))
    blocks = centred_blocks(clean, n, sums) if n else clean.select(F.array("id").alias("ids"), F.lit(b"").alias("block")).limit(0)
    model = fit(blocks, n, sums, components) if n else Whitening(0, sums, np.zeros((0, width)), np.zeros(0), np.zeros(0), 0)
    return transform(blocks, model).withColumnRenamed("id", row_id)
