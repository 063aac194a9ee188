"""Standardisation, clamping and time-axis scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ZSCORE_COLS
from ..functions.clean import clamp_negative
from ..functions.scale import circular_month, time_fraction, zscore


def present(df: DataFrame, cols) -> list[str]:
    return [c for c in cols if c in df.columns]


def zscore_stats_frame(df: DataFrame, cols=ZSCORE_COLS) -> DataFrame:
    """One row: <col>_mean and <col>_std (sample standard deviation)."""
    aggs = []
    for c in present(df, cols):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return df.agg(*aggs)


def zscore_stats(df: DataFrame, cols=ZSCORE_COLS) -> dict:
    """{col: (mean, std)} from one global aggregate (partial aggregation, one row to the driver)."""
    cols = present(df, cols)
    if not cols:
        return {}
    row = zscore_stats_frame(df, cols).first()
    return {c: (row[f"{c}_mean"], row[f"{c}_std"]) for c in cols}


def apply_zscore(df: DataFrame, stats: dict) -> DataFrame:
    """Standardise with fixed statistics: a pure projection, no join."""
    return df.withColumns({c: zscore(c, m, s) for c, (m, s) in stats.items() if c in df.columns})


def clamp_negatives(df: DataFrame, cols=("seniority",)) -> DataFrame:
    return df.withColumns({c: clamp_negative(c) for c in present(df, cols)})


def scale_time(df: DataFrame, month: int) -> DataFrame:
    """t -> t / month; t_month -> circular closeness to the month after ``month``."""
    return df.withColumns({"t": time_fraction("t", month), "t_month": circular_month("t_month", month)})
