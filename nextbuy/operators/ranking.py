"""Exact positions in a pseudo-random order inside (possibly huge) groups.

Batch assignment and stratified sampling need "row number of each row
inside its group, in a shuffled order". A window partitioned by the group
alone puts a whole group into one task, and a group (one label value, one
history length) may hold a third of all rows. Instead:

1. order key = md5(id) (a fixed pseudo-random permutation), ties by id;
2. bucket  = first ``prefix_len`` hex digits of that key (16**prefix_len
   buckets, so the order of buckets is the order of keys);
3. count rows per (group, bucket) - a small table, partial aggregation;
4. bucket offset = running count of the earlier buckets of the group
   (window over the small table only);
5. position = offset + row number inside (group, bucket).

Step 5 spreads every group over 16**prefix_len window partitions, and the
result equals ``row_number() over (partition by group order by md5(id), id)``.

The input is read twice (counts and rows): pass a stored or checkpointed
table when it is expensive to derive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bucket lists of up to this many rows (about 100 bytes each) may be broadcast.
BROADCAST_ROWS = 200_000


def order_key(id_col: str, seed: int | None = None) -> Column:
    """md5 of the id (seed None) or of "id:seed": a fixed pseudo-random order per seed."""
    key = F.col(id_col).cast("string")
    if seed is not None:
        key = F.concat(key, F.lit(f":{seed}"))
    return F.md5(key)


def bucket_offsets(df: DataFrame, group_cols, id_col: str, prefix_len: int = 3,
                   seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with _h/_b, offsets table (group, _b, _off, _n))."""
    d = df.withColumn("_h", order_key(id_col, seed)).withColumn("_b", F.substring("_h", 1, prefix_len))
    counts = d.groupBy(*group_cols, "_b").agg(F.count("*").alias("_nb"))
    before = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group_cols)
    offs = counts.select(*group_cols, "_b", F.coalesce(F.sum("_nb").over(before), F.lit(0)).alias("_off"),
                         F.sum("_nb").over(whole).alias("_n"))
    return d, offs


def _local_rank(j: DataFrame, group_cols, id_col: str) -> DataFrame:
    w = Window.partitionBy(*group_cols, "_b").orderBy("_h", id_col)
    return j.withColumn("_rank", F.col("_off") + F.row_number().over(w))


def rank_in_groups(df: DataFrame, group_cols, id_col: str = "id", prefix_len: int = 3,
                   seed: int | None = None) -> DataFrame:
    """Adds ``_rank`` (1-based position by md5(id), id) and ``_n`` (group size)."""
    d, offs = bucket_offsets(df, group_cols, id_col, prefix_len, seed)
    j = d.join(offs, [*group_cols, "_b"])
    return _local_rank(j, group_cols, id_col).drop("_h", "_b", "_off")


def shares(sizes: DataFrame, group_cols, fraction: float, within=(), seed: int | None = None) -> DataFrame:
    """(group_cols, _k): how many rows of each group to take so that those of each ``within`` come to ceil(n * fraction) in all.

    Largest remainders: every group gets the whole part of its proportional share, the rows that are left go to
    the largest remainders; equal remainders in the order of md5("group:values[:seed]"). ``sizes``: (group_cols, _n).
    """
    part = Window.partitionBy(*within)
    total = F.sum("_n").over(part)
    want = F.ceil(total.cast("double") * F.lit(float(fraction))).cast("decimal(38,0)")
    rows = sizes.withColumns({"_want": want, "_total": total.cast("decimal(38,0)")})
    quota = F.col("_n").cast("decimal(18,0)") * F.col("_want").cast("decimal(18,0)")
    rows = rows.withColumns({"_whole": F.floor(quota / F.col("_total")).cast("long"), "_quota": quota})
    # the division is rounded: settle the whole part exactly
    over = F.col("_quota") - F.col("_whole") * F.col("_total")
    rows = rows.withColumn("_whole", F.when(over < 0, F.col("_whole") - 1).when(over >= F.col("_total"), F.col("_whole") + 1).otherwise(F.col("_whole")))
    rows = rows.withColumn("_rest", F.col("_quota") - F.col("_whole") * F.col("_total"))
    tie = F.concat_ws(":", *[F.col(c).cast("string") for c in group_cols], *([F.lit(str(seed))] if seed is not None else []))
    place = F.row_number().over(part.orderBy(F.col("_rest").desc(), F.md5(tie), *group_cols))
    left = F.col("_want") - F.sum("_whole").over(part)
    return rows.withColumn("_k", (F.col("_whole") + (place <= left).cast("int")).cast("long")).select(*group_cols, "_k")


def first_in_groups(df: DataFrame, group_cols, how_many: Column | float, id_col: str = "id",
                    prefix_len: int = 3, seed: int | None = None, within=()) -> DataFrame:
    """Rows whose position is <= ``how_many``: an expression of the group size ``_n``, or a share of all rows of
    each ``within``, dealt to the groups by ``shares``.

    Buckets that start past the cut are dropped before the ranking window. The
    list of those that remain is written and counted; within ``BROADCAST_ROWS``
    it is broadcast, so only about the selected share of the rows is shuffled.
    """
    from ..sources.storage import store_rows

    d, offs = bucket_offsets(df, group_cols, id_col, prefix_len, seed)
    if isinstance(how_many, Column):
        offs = offs.withColumn("_k", how_many)
    else:
        offs = store_rows(offs, "sizes")
        own = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)]
        take = shares(offs.select(*group_cols, "_n").distinct(), group_cols, how_many, within, seed).select(*own, "_k")
        same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group_cols)]  # a null is a group, too
        offs = offs.join(take, reduce(lambda a, b: a & b, same)).drop(*[f"_g{i}" for i in range(len(group_cols))])
    offs = store_rows(offs.filter(F.col("_off") < F.col("_k")), "offsets")
    small = offs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own = offs.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate([*group_cols, "_b"])], "_off", "_n", "_k")
    same = reduce(lambda a, b: a & b, [d[c].eqNullSafe(own[f"_g{i}"]) for i, c in enumerate([*group_cols, "_b"])])
    j = d.join(F.broadcast(own) if small else own, same).drop(*[f"_g{i}" for i in range(len(group_cols) + 1)])
    r = _local_rank(j, group_cols, id_col)
    return r.filter(F.col("_rank") <= F.col("_k")).drop("_h", "_b", "_off")
