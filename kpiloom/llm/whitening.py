"""Whitening of embeddings by shifted CholeskyQR.

Centred rows Y are never gathered. A pass over the table forms the Gram matrix of the rows as they
stand, the driver takes its Cholesky factor, and the next pass solves each row by the triangle of every
factor so far. The first Gram matrix of ill-conditioned rows is not positive in doubles, so it is shifted;
the passes after that start from rows that are nearly orthonormal and mend what the shift left. The
product R of the factors has the singular values and right vectors of Y, to double precision, where
the covariance itself would have lost half of the digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
PASSES = 6  # of orthogonalising at most; three do for any matrix of full rank
NEAR = 1e-13  # rows count as orthonormal if no entry of their Gram matrix is further from the identity, per row of it
LARGEST = 1 << 53  # whole components are cut to this
LONG = (1 << 63) - 1
_BITS = 2.0**-52
_BRANCH = 64  # partial matrices are added up in this many groups first
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- rows ----------------------------------------------------------------------------


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array of doubles) of the rows whose vector is whole and finite."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("x").isNotNull() & ~bad)


def whole_components(x: pa.Array, d: int, scale: int, offset: int) -> np.ndarray:
    """A matrix of floor(scale * c) + offset as 64-bit integers; missing components count as c = 0."""
    sizes = x.value_lengths().to_numpy(zero_copy_only=False)
    flat = x.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.full((len(sizes), d), offset, np.int64)
    with np.errstate(over="ignore"):
        out[row, at] = np.clip(np.floor(scale * flat), -LARGEST, LARGEST).astype(np.int64) + offset
    return out


class Fit:
    """Row count, exact sums and the factors so far; goes to the tasks, d x d numbers in size."""

    def __init__(self, n: int, sums: list[int], peak: int, scale: int, offset: int):
        self.n, self.sums, self.scale, self.offset = n, sums, scale, offset
        self.factors: list[np.ndarray] = []
        # Deviations from the mean times n fit 64 bits for all but huge components or tables.
        self.narrow = 2 * n * (peak + abs(offset) + 1) < LONG

    @property
    def d(self) -> int:
        return len(self.sums)

    def spread(self, x: pa.Array) -> np.ndarray:
        """n * x - S, exact: 64-bit integers, or Python's where those would overflow."""
        whole = whole_components(x, self.d, self.scale, self.offset)
        if self.narrow:
            return self.n * whole - np.array(self.sums, np.int64)
        return self.n * whole.astype(object) - np.array(self.sums, object)

    def centred(self, x: pa.Array) -> np.ndarray:
        return (self.spread(x) / self.n).astype(np.float64)

    def solved(self, x: pa.Array) -> np.ndarray:
        """The centred rows times the inverse of every factor, by solving with its triangle."""
        rows = self.centred(x).T
        for factor in self.factors:
            rows = np.linalg.solve(factor.T, rows)
        return rows.T


def squares(spread: np.ndarray) -> list[int]:
    """The sum of squares of each row, exact; beyond 64 bits it is cut to the largest long."""
    peak = int(np.abs(spread).max(initial=0))
    if peak * peak * max(spread.shape[1], 1) < LONG:
        return (spread.astype(np.int64) ** 2).sum(axis=1).tolist()
    return [min(int(v), LONG) for v in (spread.astype(object) ** 2).sum(axis=1)]


# --- passes --------------------------------------------------------------------------


def _added(rows: DataFrame) -> DataFrame:
    """Vectors (i, part, v) added up by i, in the order of part: first in groups, then those."""

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy(), kind="stable")
        values = table.column("v").combine_chunks()
        width = len(values.flatten()) // len(values)
        total = np.zeros(width)
        for at in order.tolist():
            total += values[at].values.to_numpy()
        first = table.slice(int(order[0]), 1)
        return pa.table({"i": first.column("i"), "part": first.column("part"), "v": pa.array([total.tolist()], pa.list_(pa.float64()))})

    schema = "i int, part long, v array<double>"
    grouped = rows.withColumn("_group", F.pmod("part", F.lit(_BRANCH))).groupBy("i", "_group").applyInArrow(add, schema)
    return grouped.groupBy("i").applyInArrow(add, schema)


def _gram(vectors: DataFrame, rows_of: Callable[[pa.Array], np.ndarray], d: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram matrix and sums of the rows that `rows_of` makes of the vectors; d + 1 rows of d come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d))
        seen = False
        for batch in batches:
            if batch.num_rows:
                rows, seen = rows_of(batch.column(0)), True
                total[:d] += rows.T @ rows
                total[d] += rows.sum(axis=0)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d + 1), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "v"]
            )

    partial = vectors.select("x").mapInArrow(run, "i int, v array<double>").withColumn("part", F.spark_partition_id().cast("long"))
    out = np.zeros((d + 1, d))
    for i, _, v in _added(partial).collect():  # d + 1 rows, however large the table
        out[i] = v
    gram = out[:d]
    return (gram + gram.T) / 2, out[d]


def _fit(vectors: DataFrame, scale: int, offset: int) -> Fit | None:
    """Counts and exact sums of whole components; None without vectors."""
    d, longest = vectors.agg(F.max(F.size("x")), F.count("*")).first()
    if not longest:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, peak = 0, np.zeros(d, object), 0
        for batch in batches:
            whole = whole_components(batch.column(0), d, scale, offset)
            n += len(whole)
            # A batch's sums fit 64 bits: components are at most 2**53, rows of a batch under 1,000.
            sums = sums + whole.sum(axis=0)
            peak = max(peak, int(np.abs(whole).max(initial=0)))
        if n:
            places = [*range(d), -1, -2]
            values = [Decimal(int(s)) for s in sums] + [Decimal(n), Decimal(peak)]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["i", "v"])

    partial = vectors.select("x").mapInArrow(run, "i int, v decimal(38,0)")
    found = {i: (int(s), int(m)) for i, s, m in partial.groupBy("i").agg(F.sum("v"), F.max("v")).collect()}
    return Fit(found[-1][0], [found[i][0] for i in range(d)], found[-2][1], scale, offset)


def _factor(gram: np.ndarray) -> np.ndarray | None:
    """The Cholesky factor of a Gram matrix, shifted as little as makes it one; None for all zeros."""
    d, size = len(gram), float(np.trace(gram))
    if not size > 0:
        return None
    shift = 0.0
    while True:
        try:
            factor = np.linalg.cholesky(gram + shift * np.eye(d)).T
            # A pivot that is all rounding would blow up its direction in the next pass.
            if np.diag(factor).min() ** 2 > d * _BITS * np.diag(factor).max() ** 2:
                return factor
        except np.linalg.LinAlgError:
            pass
        shift = max(4 * shift, 11 * d * (d + 1) * _BITS * size / d)


def singular(vectors: DataFrame, fit: Fit) -> tuple[np.ndarray, np.ndarray, int]:
    """Singular values and right vectors (rows) of the centred rows; the number of Gram passes."""
    d = fit.d
    product = np.eye(d)
    for step in range(PASSES):
        gram, _ = _gram(vectors, fit.solved, d)
        if step and np.abs(gram - np.eye(d)).max(initial=0) <= NEAR * d:
            break
        factor = _factor(gram)
        if factor is None or step == PASSES - 1:
            break
        fit.factors.append(factor)
        product = factor @ product
    # What the last rows lack of being orthonormal is in their Gram matrix: its root joins the product.
    # For rows of full rank this is the identity; in directions without spread it is zero.
    values, turned = np.linalg.eigh(gram)
    root = np.sqrt(np.maximum(values, 0))[:, None] * turned.T
    _, sizes, right = np.linalg.svd(root @ product)
    return sizes, right, step + 1


# --- whitening -----------------------------------------------------------------------


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """For each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries c become x = floor(scale * c) + offset. Components are unit eigenvectors of x's covariance
    (divisor n, the number of vectors), by falling eigenvalue e, the largest entry of each positive. `whitened`
    is the centred x along the component over sqrt(e), `deviation` the exact sum of (n * x - S)**2 over the
    dimensions, `explained` e over the sum of all eigenvalues, `identity_error` the largest entry of whitened's
    covariance minus the identity, measured in a pass over the table.

    Vectors that are null or hold a null, NaN or infinite entry take no part. Shorter vectors count as ending in
    zeros, so every other vector is in the fit. Rows of a null or repeated vec_id are vectors like others.
    There are as many components as directions with any spread, so equal vectors give no rows, nor does an empty
    table. Scaled entries beyond 2**53 are cut to it, deviations beyond 64 bits to the largest long. Other columns are not read.
    """
    rows = usable(vectors)
    fit = _fit(rows, scale, offset)
    empty = vectors.sparkSession.createDataFrame([], SCHEMA)
    if fit is None or not fit.d:
        return empty
    sizes, right, _ = singular(rows, fit)
    spread = sizes > 16 * fit.d * _BITS * sizes[0]
    kept = min(components, int(spread.sum()))
    if not sizes[0] > 0 or not kept:
        return empty
    axes = right[:kept]
    axes = axes * np.sign(axes[np.arange(kept), np.abs(axes).argmax(axis=1)])[:, None]
    sigma = sizes[:kept] / np.sqrt(fit.n)
    explained = (sizes**2 / (sizes**2).sum())[:kept]
    project = axes.T / sigma

    def projected(x: pa.Array) -> np.ndarray:
        return fit.centred(x) @ project

    gram, sums = _gram(rows, projected, kept)
    mean = sums / fit.n
    error = float(np.abs(gram / fit.n - np.outer(mean, mean) - np.eye(kept)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            spread_rows = fit.spread(batch.column("x"))
            whitened = (spread_rows / fit.n).astype(np.float64) @ project
            deviation = np.array(squares(spread_rows), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), kept))),
                    pa.array(np.tile(np.arange(1, kept + 1), m), pa.int32()),
                    pa.array(np.full(m * kept, fit.n), pa.int64()),
                    pa.array(np.repeat(deviation, kept), pa.int64()),
                    pa.array(whitened.ravel(), pa.float64()),
                    pa.array(np.tile(explained, m), pa.float64()),
                    pa.array(np.full(m * kept, error), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, SCHEMA)
