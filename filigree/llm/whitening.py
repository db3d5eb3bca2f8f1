"""Whitening of embeddings by the principal components of all rows.

Components come from Golub-Kahan-Lanczos bidiagonalisation of the centred rows X. A step sends one vector c
through the rows: each task multiplies its rows by c and the products back by its rows, and Spark adds up the
tasks' sums, so that the driver sees as many numbers as a vector has entries. Left vectors have an entry for
each row and are never held: each is X times a short vector, so what full reorthogonalisation needs of them
is found from the sums of the same step. The singular vectors and values of the small bidiagonal matrix give
components and deviations.

With no tolerance the steps go on until their vectors fill the space (as many steps as a vector has entries),
which also finds components that share one eigenvalue; where the process ends early, it goes on from a new
direction. With a tolerance it stops once the wanted singular triplets have smaller relative residuals; then
one of several equal eigenvalues may stand for all of them.

Rows whose vector is null or holds a null, NaN or infinity take no part. A vector shorter than the longest is
filled up with zeros. Scaled entries are held between -2**31 and 2**31 - 1. Null and repeated ids are rows
like others, other columns are dropped. Directions without any spread have no component, so equal rows, a
single row and an empty table give none. A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, saved

LOW, HIGH = -(2**31), 2**31 - 1
#: Eigenvalues below this share of the largest count as none.
NOTHING = 1e-18

BLOCK = "ids array<bigint>, x binary"
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """What the fit leaves: components by falling eigenvalue, as rows, of vectors centred at ``sums / n``."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def pivot(self) -> np.ndarray:
        """The whole part of each mean: subtracting it from a row is exact."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.pivot).astype(float) - self.rest


def usable(vector: str | Column) -> Column:
    """The vector, if it has only finite entries, else null."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(v.isNotNull() & fine, v)


def scaled_blocks(rows: DataFrame, vector: str, scale: int, offset: int = 0) -> tuple[DataFrame, int]:
    """The usable rows (vec_id and a vector) as blocks of whole numbers, floor(scale * entry) + offset, and the vectors' length."""
    bounded_batches(rows.sparkSession)
    kept = rows.select("vec_id", usable(vector).alias("v")).filter(F.col("v").isNotNull())
    width = kept.agg(F.max(F.size("v"))).first()[0] or 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy())
            x = np.zeros((len(ends), width))
            x[np.arange(width) < ends[:, None]] = flat
            x = np.clip(np.floor(x * scale) + offset, LOW, HIGH).astype("<i4")
            ids = batch.column("vec_id").cast(pa.int64())
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], ["ids", "x"])

    return saved(kept.select("vec_id", F.col("v").cast("array<double>").alias("v")).mapInArrow(pack, BLOCK)), width


def matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The ids and the whole-number rows of each block."""
    for batch in batches:
        for ids, x in zip(batch.column("ids"), batch.column("x"), strict=True):
            yield ids.values, np.frombuffer(x.as_buffer(), "<i4").reshape(-1, width).astype(np.int64)


def _totals(blocks: DataFrame, of_task, count: int) -> np.ndarray:
    """The sums over all tasks of the numbers that ``of_task`` makes of its batches: ``count`` doubles."""

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array(range(count), pa.int32()), pa.array(of_task(batches), pa.float64())], ["at", "value"])

    found = blocks.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(count)
    for row in found:
        out[row["at"]] = row["value"]
    return out


def whole_sums(blocks: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each entry."""

    def run(batches):
        n, sums = 0, [0] * width
        for _, x in matrices(batches, width):
            n += len(x)
            sums = [a + b for a, b in zip(sums, x.sum(0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array([str(s) for s in [*sums, n]])], ["at", "value"])

    found = blocks.mapInArrow(run, "at int, value string").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    sums = [0] * (width + 1)
    for row in found:
        sums[row["at"]] = int(row["value"])
    return sums[-1], sums[:-1]


def _apart(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """``v`` without its parts along the others, taken off twice."""
    if others:
        basis = np.array(others)
        for _ in range(2):
            v = v - basis.T @ (basis @ v)
    return v


def bidiagonalise(product, width: int, wanted: int, norm: float, tolerance: float | None = None, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (rows) and values of a matrix X, by falling value.

    ``product(c)`` gives Xᵀ(Xc). ``norm`` is the square root of the sum of the squares of X. A left vector u
    is kept as the short vector c with u = Xc, and Xᵀu beside it.
    """
    rng = np.random.default_rng(seed)
    right, left, back = [], [], []  # v, c with u = Xc, Xᵀu
    alphas, betas = [], []
    v, beta = None, 0.0
    while len(right) < width:
        if v is None:  # a new direction: the first, or one after the process has ended in a part of the space
            beta = 0.0
            v = _apart(rng.standard_normal(width), right)
            v /= np.linalg.norm(v)
        right.append(v)
        c = v - beta * left[-1] if beta else v
        w = product(c)
        # Taken off twice too: the products with earlier left vectors are u·Xc = c'·(Xᵀ X c).
        for again in (False, True):
            if left:
                if again and np.abs(part).max(initial=0) <= 1e-9 * np.sqrt(max(c @ w, 0)):
                    break
                part = np.array([u @ w for u in left])
                c, w = c - np.array(left).T @ part, w - np.array(back).T @ part
        alpha = float(np.sqrt(max(c @ w, 0.0)))
        betas.append(beta)
        alphas.append(alpha)
        if alpha <= 1e-13 * norm:  # X sends v into what is there already
            alphas[-1] = 0.0
            left.append(np.zeros(width))
            back.append(np.zeros(width))
            v = None
            continue
        left.append(c / alpha)
        back.append(w / alpha)
        v = _apart(back[-1] - alpha * right[-1], right)
        beta = float(np.linalg.norm(v))
        v = v / beta if beta > 1e-13 * norm else None
        if tolerance is not None and v is not None and len(right) > wanted:
            p, s, _ = np.linalg.svd(_bidiagonal(alphas, betas))
            if (beta * np.abs(p[-1, :wanted]) <= tolerance * s[0]).all():
                break
    _, values, q = np.linalg.svd(_bidiagonal(alphas, betas))
    return q[:wanted] @ np.array(right).reshape(-1, width), values[:wanted]


def _bidiagonal(alphas: list[float], betas: list[float]) -> np.ndarray:
    b = np.diag(alphas)
    for k in range(1, len(alphas)):
        b[k - 1, k] = betas[k]
    return b


def fit(blocks: DataFrame, width: int, components: int = 8, tolerance: float | None = None) -> Whitening:
    n, sums = whole_sums(blocks, width)
    model = Whitening(n, sums, np.zeros((0, width)), np.zeros(0), 0.0)
    if not n or not width:
        return model

    def spread(batches):
        total = 0.0
        for _, x in matrices(batches, width):
            total += float(np.square(model.centred(x)).sum())
        return [total]

    total = float(_totals(blocks, spread, 1)[0])
    model.trace = total / n
    if total == 0:
        return model

    def product(c: np.ndarray) -> np.ndarray:
        def run(batches):
            w = np.zeros(width)
            for _, x in matrices(batches, width):
                x = model.centred(x)
                w += x.T @ (x @ c)
            return w

        return _totals(blocks, run, width)

    vectors, values = bidiagonalise(product, width, min(components, width), np.sqrt(total), tolerance)
    e = values**2 / n
    kept = e > NOTHING * model.trace
    vectors, model.eigenvalues = vectors[kept], e[kept]
    sign = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])
    model.components = vectors * sign[:, None]
    return model


def identity_error(blocks: DataFrame, width: int, model: Whitening) -> float:
    """The largest entry of the covariance of all whitened rows, less the identity."""
    k = len(model.components)
    if not k:
        return 0.0
    project = (model.components / np.sqrt(model.eigenvalues)[:, None]).T

    def mean(batches):
        total = np.zeros(k)
        for _, x in matrices(batches, width):
            total += (model.centred(x) @ project).sum(0)
        return total

    middle = _totals(blocks, mean, k) / model.n

    def moments(batches):
        total = np.zeros((k, k))
        for _, x in matrices(batches, width):
            z = model.centred(x) @ project - middle
            total += z.T @ z
        return total.ravel()

    return float(np.abs(_totals(blocks, moments, k * k).reshape(k, k) / model.n - np.eye(k)).max())


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """The sum of (n * entry - sum)² of each row, exactly."""
    off = x - model.pivot
    over = np.array([s % model.n for s in model.sums])  # n * x - S = n * off - over
    most = (int(np.abs(off).max(initial=0)) + 1) * model.n
    if most**2 * max(x.shape[1], 1) < 2**63:
        return np.square(off * model.n - over).sum(1).tolist()
    each = np.square(off.astype(object) * model.n - over.astype(object)).sum(1)
    return [int(v) if v < 2**63 else None for v in each]


def whiten(blocks: DataFrame, width: int, model: Whitening) -> DataFrame:
    """A row for each row in ``blocks`` and component; see OUT."""
    error, explained = identity_error(blocks, width, model), (model.eigenvalues / model.trace if model.trace else model.eigenvalues).tolist()
    k, project = len(model.components), (model.components / np.sqrt(model.eigenvalues)[:, None]).T

    def run(batches):
        for ids, x in matrices(batches, width):
            if not k:
                continue
            z, rows = model.centred(x) @ project, len(x)
            at = pa.array(np.repeat(np.arange(rows), k))
            columns = [
                ids.take(at), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, model.n), pa.int64()),
                pa.array(deviations(x, model), pa.int64()).take(at), pa.array(z.ravel()),
                pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.mapInArrow(run, OUT)


def whitened(rows: DataFrame, vector: str = "embedding", scale: int = 1024, offset: int = 0, components: int = 8, tolerance: float | None = None) -> DataFrame:
    """Whitening of ``rows`` (vec_id and a vector) fitted on all of them, by entries floor(scale * entry) + offset."""
    blocks, width = scaled_blocks(rows, vector, scale, offset)
    return whiten(blocks, width, fit(blocks, width, components, tolerance))
