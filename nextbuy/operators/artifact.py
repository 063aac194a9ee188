"""A fitted recommender in one folder: fills, categories, statistics, histories and weights.

``fit_artifact`` learns everything from cleaned training rows and writes it below one path;
``load_artifact`` needs that path only. A new month of cleaned rows is then scored without the
training table, and, once its products are known, appended.

  stages/      the pipeline of ``GapFiller`` and ``FeatureEncoder`` (ML format)
  histories/   the bucketed history table of each version
  weights/     the scorer
  state/       one JSON line a version: months, buckets, moments, table; the newest counts
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ATTR_COLS, NUM_PRODUCTS, Y_COLS
from ..sources.storage import store_rows
from . import sequence
from .history_store import HistoryStore
from .joint import JointScorer
from .stages import FeatureEncoder, GapFiller


@dataclass(frozen=True)
class Artifact:
    path: str
    stages: PipelineModel
    store: HistoryStore
    scorer: JointScorer
    train_month: int
    version: int
    scale_time: bool
    include_time: bool

    def features(self, cleaned: DataFrame) -> DataFrame:
        """Feature rows of cleaned rows, filled and encoded as in training."""
        return self.stages.transform(cleaned)

    def score(self, cleaned: DataFrame) -> DataFrame:
        """(id, n_obs, t_max, y, y_last, p) of the customers of one new month of cleaned rows that have a stored month before (y: null without products)."""
        target = store_rows(self.features(cleaned), "new-month")
        return self.scorer.predict(self.store.scoring(target, self.train_month, self.scale_time, self.include_time))

    def append(self, cleaned: DataFrame) -> Artifact:
        """The artifact with a new month's rows (with products) in its histories, saved as the next version; weights, fills and categories stay."""
        grown = self.store.append(store_rows(self.features(cleaned), "new-month"))
        out = replace(self, store=grown, version=self.version + 1)
        _save_state(cleaned.sparkSession, out)
        return out


def _save_state(spark: SparkSession, a: Artifact) -> None:
    state = {"store": a.store.state(), "train_month": a.train_month, "scale_time": a.scale_time, "include_time": a.include_time}
    rows = spark.createDataFrame([(a.version, json.dumps(state))], "version int, state string")
    rows.coalesce(1).write.mode("append").parquet(f"{a.path}/state")  # one row


def fit_artifact(cleaned: DataFrame, train_month: int, path: str, attr_cols=ATTR_COLS, ys=Y_COLS, observed_categories: bool = False,
                 scale_time: bool = True, include_time: bool = True, buckets: int | None = None, seq_len: int | None = None,
                 scorer: JointScorer | None = None, fit: bool = True) -> Artifact:
    """Fit on the cleaned rows of months up to ``train_month`` and write everything below ``path`` (a new folder).

    ``seq_len``: steps of the model's input; by default one more than ``train_month``, so that the next month's histories fit.
    ``fit=False`` takes the weights of ``scorer`` as they are.
    """
    spark, path = cleaned.sparkSession, path.rstrip("/")
    rows = sequence.month_filter(cleaned, train_month)
    stages = Pipeline(stages=[GapFiller(), FeatureEncoder(observed=observed_categories)]).fit(rows)
    stages.write().save(f"{path}/stages")
    store = HistoryStore.build(stages.transform(rows), "artifact", attr_cols, ys, buckets, root=f"{path}/histories")
    scorer = scorer or JointScorer()
    width = (2 if include_time else 0) + NUM_PRODUCTS
    if fit:
        scorer.fit(store.training(spark, scale_time, include_time), seq_len or train_month + 1, width)
    scorer.save(spark, f"{path}/weights")
    out = Artifact(path, stages, store, scorer, train_month, 0, scale_time, include_time)
    _save_state(spark, out)
    return out


def load_artifact(spark: SparkSession, path: str, version: int | None = None) -> Artifact:
    """The newest version (or the one asked for) of the artifact at ``path``."""
    path = path.rstrip("/")
    states = spark.read.schema("version int, state string").parquet(f"{path}/state")
    states = states if version is None else states.filter(F.col("version") == version)
    newest = states.orderBy(F.desc("version")).first()
    if newest is None:
        raise ValueError(f"no version {version} at {path}")
    state = json.loads(newest.state)
    return Artifact(path, PipelineModel.load(f"{path}/stages"), HistoryStore.reopen(spark, state["store"]), JointScorer.load(spark, f"{path}/weights"),
                    state["train_month"], newest.version, state["scale_time"], state["include_time"])
