"""Mode / mean imputation with global statistics.

The statistics come from aggregates of bounded memory (a single row at the end);
filling is then a projection with literal values, so the table itself is never shuffled or joined.

Modes are exact for columns of any number of distinct values. One pass keeps a
mergeable heavy-hitter sketch of each column. A column whose sketch counts all rows is
settled by it (code columns are). For others a second pass counts the candidates exactly;
the sketch's error bound tells when no other value can be as frequent. Where that leaves a doubt (no
value is frequent), the column's values are counted by a grouped aggregate. No task holds all values of a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MEAN_FILL_COLS, MODE_FILL_COLS

#: Values a sketch follows, and the most it reports. A value that is not reported
#: occurs in at most MISSED / tracked of the rows, or less often than the last one reported.
TRACKED, REPORTED, MISSED = 4096, 256, 8


def _name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _sketches(cols, tracked: int, reported: int) -> list:
    return [F.expr(f"approx_top_k({_name(c)}, {reported}, {tracked})").alias(c) for c in cols]


def _settled(df: DataFrame, row, cols, n: int, tracked: int, reported: int) -> dict:
    """The modes of ``cols`` from their sketches ``row``: at once, by a second pass, or by counting all values."""
    out, open_ = {}, {}
    for c in cols:
        seen = [(x["item"], x["count"]) for x in (row[c] or [])]
        own = [(v, m) for v, m in seen if v is not None]
        if sum(m for _, m in seen) == n and len(seen) < reported:  # the counts are exact
            out[c] = min(own, key=lambda x: (-x[1], x[0]))[0] if own else None
        else:
            least = max((m for _, m in own), default=0) - MISSED * n / tracked
            others = max(MISSED * n / tracked, min(m for _, m in seen) if len(seen) == reported else 0)
            open_[c] = ([v for v, m in own if m >= least], others)
    asked = [(c, v) for c, (vs, _) in open_.items() for v in vs]
    if asked:
        counts = df.agg(*[F.count_if(F.col(c) == F.lit(v)).alias(f"_{i}") for i, (c, v) in enumerate(asked)]).first()
        found: dict = {}
        for i, (c, v) in enumerate(asked):
            found.setdefault(c, []).append((-counts[f"_{i}"], v))
        for c, own in found.items():
            m, v = min(own)
            if -m > open_[c][1]:
                out[c] = v
    for c in open_:
        if c not in out:
            counted = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
            r = counted.agg(F.min_by("v", F.struct((-F.col("n")).alias("n"), F.col("v").alias("v"))).alias("v")).first()
            out[c] = r["v"]
    return out


def exact_modes(df: DataFrame, cols, tracked: int = TRACKED, reported: int = REPORTED) -> dict:
    """{column: most frequent value, the lowest of equally frequent ones, None without values}."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return {}
    row = df.agg(F.count("*").alias("_n"), *_sketches(cols, tracked, reported)).first()
    return _settled(df, row, cols, row["_n"], tracked, reported)


def impute_stats(df: DataFrame, mode_cols=MODE_FILL_COLS, mean_cols=MEAN_FILL_COLS) -> dict:
    """{column: mode or mean}; one pass over the rows if all modes are settled by their sketches."""
    modes, means = ([c for c in cols if c in df.columns] for cols in (mode_cols, mean_cols))
    if not modes and not means:
        return {}
    row = df.agg(F.count("*").alias("_n"), *_sketches(modes, TRACKED, REPORTED), *[F.avg(c).alias(c) for c in means]).first()
    return {**_settled(df, row, modes, row["_n"], TRACKED, REPORTED), **{c: row[c] for c in means}}


def impute_stats_frame(df: DataFrame, mode_cols=MODE_FILL_COLS, mean_cols=MEAN_FILL_COLS) -> DataFrame:
    """One row: the mode (lowest value on ties) or the mean of each column."""
    values = impute_stats(df, mode_cols, mean_cols)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cols = [F.lit(v).cast(kinds[c] if c in mode_cols else "double").alias(c) for c, v in values.items()]
    return df.sparkSession.range(1).select(*cols)


def fill(df: DataFrame, values: dict) -> DataFrame:
    """coalesce(column, value) for each column with a known fill value."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()
                           if v is not None and c in df.columns})


def impute(df: DataFrame, stats_from: DataFrame | None = None, enabled: bool = True,
           mode_cols=MODE_FILL_COLS, mean_cols=MEAN_FILL_COLS) -> DataFrame:
    """Fill gaps with statistics of ``stats_from`` (default: the table itself).

    ``enabled=False`` returns the table unchanged (the "no impute" switch).
    """
    if not enabled:
        return df
    return fill(df, impute_stats(stats_from if stats_from is not None else df, mode_cols, mean_cols))
