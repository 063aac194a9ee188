"""Mini-batch assignment inside history-length buckets.

Rows of a bucket are put in a fixed pseudo-random order (md5 of the id)
and cut into batches of ``batch_size``; the remainder joins the last batch
(1000 rows at 256 -> 256, 256, 488; fewer than 2 * 256 rows -> one batch).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BATCH_SIZE
from .ranking import rank_in_groups


def assign_batches(h: DataFrame, batch_size: int = BATCH_SIZE, bucket_col: str = "n_obs",
                   id_col: str = "id", epoch: int | None = None) -> DataFrame:
    """(id, bucket, batch, batch_rows): 0-based batch number inside each bucket.

    ``epoch`` gives every epoch its own order (the original reshuffles each
    epoch); None uses the base order md5(id).
    """
    r = rank_in_groups(h.select(id_col, bucket_col), [bucket_col], id_col, seed=epoch)
    n_batches = F.greatest(F.floor(F.col("_n") / batch_size), F.lit(1))
    batch = F.least(F.floor((F.col("_rank") - 1) / batch_size), n_batches - 1).cast("int")
    out = r.select(id_col, bucket_col, batch.alias("batch"), "_n", n_batches.alias("_nb"))
    rows = F.when(F.col("batch") < F.col("_nb") - 1, F.lit(batch_size)).otherwise(
        F.col("_n") - (F.col("_nb") - 1) * batch_size)
    return out.select(id_col, bucket_col, "batch", rows.cast("long").alias("batch_rows"))
