"""Integer vectors from float arrays, and exact sums over tasks (operators 11 and 12)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums and products over all rows are exact integers of up to this many digits.
EXACT = "decimal(38,0)"


def finite(vec: Column) -> Column:
    """Whether an array is not null and all its entries are finite numbers."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & F.coalesce(ok, F.lit(False))


def floored(vectors: DataFrame, scale: int, limit: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the finite vectors, v = floor(scale * entry) as longs, kept within +-``limit``."""
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[vec_col].cast("array<double>").alias("v"))
    whole = lambda x: F.floor(F.greatest(F.least(x * F.lit(float(scale)), F.lit(float(limit))), F.lit(float(-limit)))).cast("long")
    return rows.filter(finite(F.col("v"))).select("vec_id", F.transform("v", whole).alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """An Arrow list column of equal lengths as an (n, dims) integer matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dims)


class ExactSums:
    """Integer totals of a task that never overflow: int64 while that is safe, Python integers beyond."""

    def __init__(self, cells: int):
        self.small, self.bound, self.large = np.zeros(cells, np.int64), 0, None

    def add(self, values: np.ndarray) -> None:
        """``values``: one integer for each cell (int64, or Python integers as objects)."""
        most = int(np.abs(values).max(initial=0))
        if values.dtype != object and self.bound + most < 1 << 62:
            self.small += values
            self.bound += most
            return
        self.large = (0 if self.large is None else self.large) + self.small.astype(object) + values.astype(object)
        self.small[:], self.bound = 0, 0

    def totals(self) -> list[int]:
        return [int(x) for x in (self.small if self.large is None else self.large + self.small)]


def summed(rows: DataFrame, run, cells: str = "cell int") -> DataFrame:
    """The exact totals by cell of what ``run`` yields for each task ((cell, value) with value as decimal)."""
    names = [c.split()[0] for c in cells.split(",")]
    return rows.mapInArrow(run, f"{cells}, value {EXACT}").groupBy(*names).agg(F.sum("value").cast(EXACT).alias("value"))


def decimals(values: list[int]) -> pa.Array:
    from decimal import Decimal

    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


def batches_of(batches: Iterator[pa.RecordBatch], column: int, dims: int) -> Iterator[np.ndarray]:
    """The vectors of each batch that has rows."""
    for batch in batches:
        if batch.num_rows:
            yield matrix(batch.column(column), dims)
