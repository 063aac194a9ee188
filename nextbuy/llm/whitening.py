"""Embedding whitening by mixed-precision refinement (operator 12).

Entries become integers x = floor(scale * entry) + offset, so the sums and the
covariance's numerators are exact whatever the order of rows and however large the offset is.

1. *Sums* by dimension: one pass, one row a dimension comes back.
2. *Covariance.* Rows are centred on the whole part of the mean before they are
   multiplied; the mean's fraction is taken out exactly afterwards. Products of a
   batch are one floating-point matrix product when all its partial sums are whole numbers
   below 2**53, else products of parts of 20 bits. Tasks yield dims * (dims + 1) / 2 integers,
   summed by Spark.
3. *Eigenvectors* of the covariance (dims x dims, on the driver) from single
   precision by refinement in higher precision (``eigen``).
4. *Check.* The whitened rows' covariance is measured over all rows.
5. *Projection* of all rows on the components.

Only matrices of dims x dims reach the driver; rows are stored once as integers
and read by each pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import share_package
from .common import empty, stored
from .eigen import WIDE, refined_eigenvectors
from .vectors import ExactSums, batches_of, decimals, floored, matrix, summed

#: Entries beyond this after scaling count as this much.
LIMIT = (1 << 40) - 1
_PART = 20
COLUMNS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def exact_gram(y: np.ndarray) -> np.ndarray:
    """y.T @ y of an integer matrix of up to 4,096 rows, exact."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    parts, rest = [], y
    while np.abs(rest).max(initial=0) >= 1 << _PART:
        parts.append((rest & ((1 << _PART) - 1)).astype(np.float64))
        rest = rest >> _PART
    parts.append(rest.astype(np.float64))
    out = np.zeros((y.shape[1],) * 2, object)
    for i, p in enumerate(parts):
        for j, q in enumerate(parts):
            out += (p.T @ q).astype(np.int64).astype(object) << (_PART * (i + j))
    return out


def _pieces(y: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(0, len(y), 4096):
        yield y[i:i + 4096]


def dimension_sums(rows: DataFrame, dims: int) -> list[int]:
    """The exact sum of each dimension of (vec_id, v) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = ExactSums(dims)
        for v in batches_of(batches, 0, dims):
            for y in _pieces(v):
                sums.add(y.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), decimals(sums.totals())], ["cell", "value"])

    got = {r.cell: int(r.value) for r in summed(rows.select("v"), run).collect()}  # one row a dimension
    return [got.get(i, 0) for i in range(dims)]


def covariance(rows: DataFrame, n: int, sums: list[int]) -> list[list[Fraction]]:
    """The exact covariance (divisor n) of (vec_id, v) rows with the given sums."""
    dims = len(sums)
    middle = np.array([s // n for s in sums], np.int64)
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = ExactSums(len(upper[0]))
        for v in batches_of(batches, 0, dims):
            for y in _pieces(v - middle):
                total.add(exact_gram(y)[upper])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(upper[0])), pa.int32()), decimals(total.totals())], ["cell", "value"])

    got = {r.cell: int(r.value) for r in summed(rows.select("v"), run).collect()}  # dims * (dims + 1) / 2 rows
    rest = [s - n * int(m) for s, m in zip(sums, middle, strict=True)]
    out = [[Fraction(0)] * dims for _ in range(dims)]
    for cell, (i, j) in enumerate(zip(*(x.tolist() for x in upper), strict=True)):
        out[i][j] = out[j][i] = Fraction(n * got.get(cell, 0) - rest[i] * rest[j], n * n)
    return out


def wide(values: list[list[Fraction]]) -> np.ndarray:
    """Rational numbers in ``WIDE`` precision."""
    high = [[float(x) for x in row] for row in values]
    low = [[float(x - Fraction(h)) for x, h in zip(row, hs, strict=True)] for row, hs in zip(values, high, strict=True)]
    return np.array(high).astype(WIDE) + np.array(low).astype(WIDE)


class Whitening:
    """The fitted projection: (v - sums / n) on the components, over the roots of their eigenvalues."""

    def __init__(self, n: int, sums: list[int], cov: list[list[Fraction]], n_components: int):
        values, vectors = refined_eigenvectors(wide(cov))
        trace = sum(float(cov[i][i]) for i in range(len(sums)))
        self.n, self.sums = n, sums
        self.middle = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s - n * int(m) for s, m in zip(sums, self.middle, strict=True)], np.int64)
        keep = min(n_components, len(sums))
        self.explained = [float(e) / trace if trace > 0 else None for e in values[:keep]]
        # a component along which the rows do not differ cannot be whitened
        floor = 1e-12 * max(float(values[0]), 0.0) if len(values) else 0.0
        self.real = np.array([e > floor for e in values[:keep]], bool)
        self.components = vectors[:, :keep] / np.sqrt(np.where(self.real, values[:keep], 1))

    def project(self, v: np.ndarray) -> np.ndarray:
        """Whitened rows; components that cannot be whitened hold NaN."""
        y = (v - self.middle).astype(np.float64) - self.rest / self.n
        return np.where(self.real, y @ self.components, np.nan)

    def deviations(self, v: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * v - sums)**2, exact; None beyond a long."""
        y, r, n = v - self.middle, self.rest, self.n
        if v.shape[1] * int(np.abs(y).max(initial=0)) * max(int(np.abs(y).max(initial=0)), n) >= 1 << 62:
            y, r = y.astype(object), r.astype(object)
        square, mixed = (y * y).sum(1).astype(object), (y * r).sum(1).astype(object)
        total = n * n * square - 2 * n * mixed + sum(int(x) ** 2 for x in self.rest)
        return [x if x < 1 << 63 else None for x in total.tolist()]

    def identity_error(self, rows: DataFrame) -> float:
        """The largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
        at = np.flatnonzero(self.real)
        k, dims, project = len(at), len(self.sums), self.project
        if not k:
            return 0.0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s, g = np.zeros(k), np.zeros((k, k))
            for v in batches_of(batches, 0, dims):
                w = project(v)[:, at]
                s += w.sum(0)
                g += w.T @ w
            yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int32()), pa.array(np.append(s, g.ravel()))], ["cell", "value"])

        sums = rows.select("v").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        total = np.zeros(k + k * k)
        for r in sums.collect():  # n_components * (n_components + 1) rows
            total[r.cell] = r.value
        mean, square = total[:k] / self.n, total[k:].reshape(k, k) / self.n
        return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, n_components: int = 32, scale: int = 64, dims: int | None = None, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every finite vector and component.

    Vectors that are null or hold null or non-finite entries are left out, and those whose length is
    not ``dims`` (by default the length that most vectors have). Adding one offset to all entries
    changes none of the results, so entries are kept without it; entries beyond +-``LIMIT`` after scaling count as ``LIMIT``.
    Components are numbered from 1 by falling eigenvalue. Along a component where the rows do not
    differ (an eigenvalue below 1e-12 of the largest) whitened is null and identity_error leaves it
    out; without any spread explained is null. deviation is null beyond a long. Null ids and
    repeated rows keep their rows. No vectors give no rows. Only id and vector are read.
    """
    spark = vectors.sparkSession
    share_package(spark)
    rows = floored(vectors, scale, LIMIT, id_col, vec_col).withColumn("size", F.size("v"))
    rows = stored(rows, "integer-vectors")
    if dims is None:
        first = rows.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
        dims = first["size"] if first else 0
    rows = rows.filter(F.col("size") == dims).select("vec_id", "v")
    n = rows.count()
    id_type = rows.schema["vec_id"].dataType
    if not n or not dims:
        return empty(spark, f"vec_id {id_type.simpleString()}, {COLUMNS}")
    sums = dimension_sums(rows, dims)
    fit = Whitening(n, sums, covariance(rows, n, sums), n_components)
    error = fit.identity_error(rows)
    keep = len(fit.explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, explained = np.arange(1, keep + 1, dtype=np.int32), pa.array(fit.explained, pa.float64())
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                m = part.num_rows
                v = matrix(part.column(1), dims)
                own = pa.array(np.repeat(np.arange(m), keep))
                white = fit.project(v).ravel()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(own), pa.array(np.tile(number, m)), pa.array(np.full(m * keep, n)), pa.array(fit.deviations(v), pa.int64()).take(own),
                     pa.array(white, mask=np.isnan(white)), explained.take(pa.array(np.tile(np.arange(keep), m))), pa.array(np.full(m * keep, error))],
                    ["vec_id", *(c.split()[0] for c in COLUMNS.split(", "))])

    schema = T.StructType([T.StructField("vec_id", id_type), *T.StructType.fromDDL(COLUMNS).fields])
    return rows.mapInArrow(run, schema)
