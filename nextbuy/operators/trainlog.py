"""Training-log tables (epoch, metric, value): best checkpoints and reports.

A log has one row per epoch and metric, so windows partitioned by metric
are small by nature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import VALIDATE_AT, VALIDATE_EVERY

INITIAL_BEST = 1e6


def improvements(log: DataFrame, initial: float = INITIAL_BEST, exclude=("loss",)) -> DataFrame:
    """(metric, epoch, value, is_best): epochs where a metric beat all earlier epochs.

    The first epoch is compared with ``initial``; ``is_best`` marks the last
    improvement (the checkpoint that is finally kept).
    """
    log = log.filter(~F.col("metric").isin(*exclude)) if exclude else log
    prev = Window.partitionBy("metric").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    best_before = F.coalesce(F.min("value").over(prev), F.lit(float(initial)))
    imp = log.withColumn("_imp", F.col("value") < best_before).filter("_imp")
    last = Window.partitionBy("metric")
    return imp.select("metric", "epoch", "value",
                      (F.col("epoch") == F.max("epoch").over(last)).cast("int").alias("is_best"))


def periodic_improvements(log: DataFrame, every: int = VALIDATE_EVERY, at=VALIDATE_AT, metric: str = "loss") -> DataFrame:
    """Improvements of one series, the validation loss, on validation epochs only (epoch % every in ``at``)."""
    checked = log.filter((F.col("metric") == metric) & F.pmod(F.col("epoch"), F.lit(every)).isin(*at))
    return improvements(checked, initial=float("inf"), exclude=())


def best_and_last(log: DataFrame) -> DataFrame:
    """(metric, best_epoch, best_value, last_epoch, last_value) per metric."""
    return log.groupBy("metric").agg(
        F.min_by("epoch", F.struct("value", "epoch")).alias("best_epoch"), F.min("value").alias("best_value"),
        F.max("epoch").alias("last_epoch"), F.max_by("value", "epoch").alias("last_value"))


def epoch_report(log: DataFrame, metrics=None) -> DataFrame:
    """One row per epoch, one column per metric."""
    g = log.groupBy("epoch")
    return (g.pivot("metric", list(metrics)) if metrics else g.pivot("metric")).agg(F.first("value"))
