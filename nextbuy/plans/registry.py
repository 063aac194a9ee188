"""Query registry: operator key -> (spark, sf_dir) -> DataFrame.

Each registered query runs over the whole stand-in tables; floating columns
are rounded to 6 decimals for the oracle compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import Y_COLS
from . import standin as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        def run(spark, sf_dir):
            return S.rounded(fn(spark, sf_dir))
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return register


def explode_steps(h: DataFrame, col: str = "x", width: int = 26) -> DataFrame:
    """(id, step, c_1..c_w) from an array<array<double>> column."""
    z = h.select("id", F.posexplode(col).alias("pos", "v"))
    return z.select("id", (F.col("pos") + 1).alias("step"),
                    *[F.get("v", i).alias(f"c_{i + 1}") for i in range(width)])


def y_columns(col: str, prefix: str) -> list:
    return [F.get(col, i).alias(f"{prefix}{i + 1}") for i in range(len(Y_COLS))]
