"""Training with a held-out month: validated epochs, a log, versioned weights, the best ones kept.

An epoch is one pass of the joint fit, which goes on from the weights of the epoch
before. On the validation epochs (2 and 4 of every 5) the held-out histories are scored
with the weights of that epoch; the mean loss and MAP@7 on newly added products go into
the log, the weights are saved under the epoch's number, and those with the least
validation loss so far are the run's result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import TOP_K, VALIDATE_AT, VALIDATE_EVERY
from ..functions.arrays import ap_at_k, binary_crossentropy, mask_owned, new_labels
from ..sources.storage import store_rows
from . import metrics
from .joint import JointScorer

#: Series of the log; ``val_loss`` decides which weights are kept.
VAL_LOSS, VAL_MAP = "val_loss", "val_map7_new"


def validate(scored: DataFrame, k: int = TOP_K) -> tuple[int, float, float]:
    """(rows, mean binary cross-entropy, MAP@k on newly added products) of scored rows, in one pass."""
    rows = metrics.require_labels(scored)
    ap = ap_at_k(new_labels("y", "y_last"), mask_owned("p", "y_last"), k)
    r = rows.agg(F.count("*").alias("n"), F.avg(binary_crossentropy("y", "p")).alias("loss"), F.avg(ap).alias("map")).first()
    return r.n, r.loss, r.map


def is_validation_epoch(epoch: int, every: int = VALIDATE_EVERY, at=VALIDATE_AT) -> bool:
    return epoch % every in at


@dataclass
class TrainingRun:
    scorer: JointScorer                      # the weights with the least validation loss (the last ones if none was measured)
    best_epoch: int | None = None
    best_loss: float | None = None
    rows: list[tuple[int, str, float]] = field(default_factory=list)
    saved: list[str] = field(default_factory=list)     # folders written, in order

    def log(self, spark: SparkSession) -> DataFrame:
        """(epoch, metric, value): ``loss`` and each product's objective of every epoch, the validation series on their epochs."""
        return spark.createDataFrame(self.rows, "epoch int, metric string, value double")


def train_with_validation(train: DataFrame, validation: DataFrame | None, seq_len: int, width: int, epochs: int = 20,
                          path: str | None = None, reg_param: float = 0.01, tol: float = 1e-6, every: int = VALIDATE_EVERY,
                          at=VALIDATE_AT, patience: int | None = None, start: JointScorer | None = None) -> TrainingRun:
    """Fit on ``train`` for up to ``epochs`` epochs, watching ``validation`` (both: history rows with attrs, x, y, y_last).

    ``path``: the weights of validation epoch e are saved in ``path.ep_e``, the best ones in ``path``. Without
    validation rows the loss is not measured and the last weights are the result. ``patience`` ends the fit after so many
    validations in a row without improvement. ``start``: weights of an earlier run to go on from. A fit that settles
    early has fewer epochs.
    """
    spark = train.sparkSession
    held = None if validation is None else store_rows(validation.select("attrs", "x", "y", "y_last"), "validation")
    run = TrainingRun(JointScorer(max_iter=epochs - 1, reg_param=reg_param, tol=tol))
    best: tuple | None = None
    since = 0

    def keep(name: str, model: JointScorer) -> None:
        if path is not None:
            model.save(spark, name)
            run.saved.append(name)

    def on_epoch(epoch: int, model: JointScorer) -> bool:
        nonlocal best, since
        if not is_validation_epoch(epoch, every, at):
            return False
        keep(f"{path}.ep_{epoch}", model)
        if held is None:
            return False
        n, loss, map_new = validate(model.predict(held))
        if not n:
            return False
        run.rows += [(epoch, VAL_LOSS, float(loss)), (epoch, VAL_MAP, float(map_new))]
        if run.best_loss is None or loss < run.best_loss:
            run.best_epoch, run.best_loss, since = epoch, float(loss), 0
            best = (model.coefficients, model.intercepts)
            keep(path, model)
        else:
            since += 1
        return patience is not None and since >= patience

    run.scorer.fit(train, seq_len, width, start=start, on_epoch=on_epoch)
    run.rows += run.scorer.log
    if best is not None:
        run.scorer.coefficients, run.scorer.intercepts = best
    else:
        keep(path, run.scorer)
    return run
