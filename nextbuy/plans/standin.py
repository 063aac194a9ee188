"""Shared stand-in inputs for the registered queries (see FIXTURES.md section 3).

Each helper reads the driver's tables under ``sf_dir`` and applies library
operators; nothing here computes a result the operators should compute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..constants import ATTR_COLS, Y_COLS
from ..operators import score, sequence
from ..sources import fixtures

TRAIN_MONTH = fixtures.STANDIN_TRAIN_MONTH
TEST_MONTH = fixtures.STANDIN_TEST_MONTH
LAST_MONTH = fixtures.STANDIN_LAST_MONTH
BASE_YEAR = fixtures.STANDIN_BASE_YEAR
PAD_LEN = TEST_MONTH - 1      # the longest possible history before the target month
TIME_ATTRS = ("t", "t_month")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (engines may differ in the last bits of sums)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot table, lazily (for queries that read it once)."""
    return fixtures.snapshots(spark, sf_dir, BASE_YEAR)


def snap_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot table derived once and stored bucketed by customer.

    For queries that read it several times (history and target month,
    scores and owned products): lineitem is scanned and shuffled once, the
    lineage is cut (a lost executor re-reads the stored files), and the
    later groupings and joins on id need no exchange.
    """
    from ..sources.storage import store_by_customer

    return store_by_customer(snap(spark, sf_dir), "snap")


def target_rows(s: DataFrame) -> DataFrame:
    return sequence.select_target_rows(s, None, TEST_MONTH, LAST_MONTH)


def features_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table (cleaned, imputed, featurised), stored bucketed by customer; the rows are dealt before the features widen them."""
    from ..operators import features, impute
    from ..sources.storage import store_by_customer

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = impute.impute(snapshots_clean_once(spark, sf_dir)).repartition(buckets, "id")
    return store_by_customer(features.featurize(rows), "feat", buckets, dealt=True)


def full_trainset(spark: SparkSession, sf_dir: str, feats: DataFrame | None = None, **options) -> DataFrame:
    """Training histories with all attributes and scaled time."""
    feats = feats if feats is not None else features_once(spark, sf_dir)
    return sequence.build_train(feats, TRAIN_MONTH, attr_cols=ATTR_COLS, scale_time_dim=True, **options)


def full_testset(spark: SparkSession, sf_dir: str, feats: DataFrame | None = None, own_file: bool = False) -> DataFrame:
    """Test histories with all attributes and scaled time; ``own_file``: the target rows are a
    separate table without products, as the file of the month to predict."""
    feats = feats if feats is not None else features_once(spark, sf_dir)
    target = None
    if own_file:
        target = target_rows(feats).drop(*Y_COLS)
        feats = sequence.month_filter(feats, TRAIN_MONTH)
    return sequence.build_test(feats, target, TRAIN_MONTH, TEST_MONTH, attr_cols=ATTR_COLS, scale_time_dim=True)


def testset(spark: SparkSession, sf_dir: str, scale_time: bool = False, attr_cols=(), s: DataFrame | None = None) -> DataFrame:
    s = s if s is not None else snap_once(spark, sf_dir)
    return sequence.build_test(s, None, TRAIN_MONTH, TEST_MONTH, attr_cols=attr_cols,
                               scale_time_dim=scale_time, include_time=True)


def trainset(spark: SparkSession, sf_dir: str, scale_time: bool = False, attr_cols=()) -> DataFrame:
    return sequence.build_train(snap(spark, sf_dir), TRAIN_MONTH, attr_cols=attr_cols,
                                scale_time_dim=scale_time, include_time=True)


def scored_testset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test histories with the popularity scores (share of months <= train month)."""
    s = snap_once(spark, sf_dir)
    return score.with_constant_scores(testset(spark, sf_dir, s=s), score.popularity_scores(s, TRAIN_MONTH))


def fixed_weight(product: int, i: int) -> float:
    """A weight between -0.06 and 0.06 for product 0 to 23 and input i; the intercept is input -1."""
    return ((7 * product + 13 * (i + 1)) % 25 - 12) / 200


def fixed_scorer():
    """A scorer with the weights of ``fixed_weight`` over 51 attributes and PAD_LEN steps of 26 channels."""
    import numpy as np

    from ..operators.joint import JointScorer

    scorer, n = JointScorer(), len(ATTR_COLS) + 26 * PAD_LEN
    scorer.seq_len, scorer.width = PAD_LEN, 26
    scorer.coefficients = np.array([[fixed_weight(k, i) for i in range(n)] for k in range(len(Y_COLS))])
    scorer.intercepts = np.array([fixed_weight(k, -1) for k in range(len(Y_COLS))])
    return scorer


# --- raw attribute stand-ins --------------------------------------------------------------------

def orders_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order dirty attributes (FIXTURES.md 3.2) through the cleaning step.

    The stand-in segment text ("1-URGENT") carries its digit at position 0.
    """
    from ..operators.clean import clean

    raw = fixtures.raw_orders(spark, sf_dir).withColumnRenamed("id", "ncodpers")
    return clean(raw, base_year=BASE_YEAR, segment_pos=0, keep=("o_orderkey",))


def raw_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.raw_snapshots(spark, sf_dir, BASE_YEAR)


def snapshots_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.clean import clean

    return clean(raw_snapshots(spark, sf_dir), base_year=BASE_YEAR, segment_pos=1)


def snapshots_clean_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned snapshot table, written once for steps that read it twice
    (imputation statistics, then the fill)."""
    from ..sources.storage import store_rows

    return store_rows(snapshots_clean(spark, sf_dir), "clean")
