"""End-to-end flows: the four batch steps of the recommender as Spark jobs.

1. ``build_feature_tables``  raw snapshot CSV -> cleaned table + feature table
2. ``train_and_score``       histories -> 24 product models -> MAP@7 on new
                             products (held-out month) or written predictions
3. ``write_recommendations`` predictions + month snapshot -> ranked lists
4. ``inspect_activations``   stratified sample, 2-D projection, top-N per unit

Intermediate tables are written once (Parquet, partitioned by month so
month filters prune whole folders) and read back, so each step starts from
storage rather than from a long lineage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (ATTR_COLS, BASE_YEAR, LAST_FILE_MONTH, NUM_PRODUCTS, P_COLS,
                         SAMPLE_FRACTION, TOP_K, TOP_N_PER_DIM)
from ..operators import activations, features, impute, joint, metrics, recommend, sequence, training
from ..operators.clean import clean
from ..operators.history_store import rolling_sets
from ..sources import csv_io
from ..sources.storage import read_stored, store_rows, write_bucketed


@dataclass
class FeatureTables:
    cleaned_path: str       # Parquet folder, or table name when bucketed
    features_path: str


def build_feature_tables(spark: SparkSession, raw_path: str, out_dir: str, is_test: bool = False,
                         do_impute: bool = True, base_year: int = BASE_YEAR, segment_pos: int = 1,
                         fix_types: bool = False, table_prefix: str | None = None,
                         buckets: int | None = None, impute_stats_from: str | None = None) -> FeatureTables:
    """Clean (and impute) a raw snapshot file, then derive the feature table.

    Both tables are written under ``out_dir`` partitioned by month ``t``.
    With ``table_prefix`` they are also catalog tables bucketed and sorted
    by customer (``buckets`` files per month), so the history builds, the
    frequency windows and the score/snapshot join later run without a
    shuffle. Imputation statistics come from this file only, as in the
    original, or from the cleaned table ``impute_stats_from`` (e.g. impute
    the test file with training statistics).
    """
    raw = csv_io.read_raw(spark, raw_path, with_products=not is_test)
    stats_from = read_stored(spark, impute_stats_from) if impute_stats_from else None
    cleaned = clean(raw, base_year, segment_pos)
    if do_impute and stats_from is None:
        # statistics and fill both read the stored rows: the CSV text is parsed once
        cleaned = store_rows(cleaned, "clean")
    cleaned = impute.impute(cleaned, stats_from=stats_from, enabled=do_impute)
    prefix = "test" if is_test else ""
    cleaned_path = f"{out_dir.rstrip('/')}/{prefix}df"
    features_path = f"{out_dir.rstrip('/')}/{prefix}catdf"
    if table_prefix:
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        names = (f"{table_prefix}_{prefix}df", f"{table_prefix}_{prefix}catdf")
        stored = write_bucketed(cleaned, names[0], cleaned_path, n, partition_by="t")
        write_bucketed(features.featurize(stored, fix_types=fix_types), names[1], features_path, n, partition_by="t")
        return FeatureTables(*names)
    cleaned.write.mode("overwrite").partitionBy("t").parquet(cleaned_path)
    stored = spark.read.parquet(cleaned_path)
    features.featurize(stored, fix_types=fix_types).write.mode("overwrite").partitionBy("t").parquet(features_path)
    return FeatureTables(cleaned_path, features_path)


@dataclass
class ScoreResult:
    scored: DataFrame               # id, n_obs, y, y_last, p
    map7_new: DataFrame | None      # (n, map) when the target month has labels
    losses: DataFrame | None
    train_lengths: DataFrame | None = None   # (status, n_customers): kept / too short / too long
    log: DataFrame | None = None    # (epoch, metric, value) of a validated fit


def train_and_score(spark: SparkSession, features_path: str, train_month: int = LAST_FILE_MONTH,
                    test_month: int = LAST_FILE_MONTH + 1, test_features_path: str | None = None,
                    last_file_month: int = LAST_FILE_MONTH, attr_cols=ATTR_COLS, scale_time: bool = True,
                    include_time: bool = True, seq_len: int | None = None, max_len: int | None = None,
                    remove_non_buyers: bool = False, max_iter: int = 20, reg_param: float = 0.01,
                    pred_out: str | None = None, model_path: str | None = None, load_model: bool = False,
                    check_keys: bool = False, validate: bool = False) -> ScoreResult:
    """Train on months <= train_month, score test_month.

    A month inside the training file is a held-out evaluation (MAP@7 on new
    products and the losses); a month past it scores the test file and, with
    ``pred_out``, writes the headerless predictions file. ``model_path``
    saves the fitted models there, or with ``load_model`` reuses saved ones.
    ``check_keys`` verifies that (id, t) is unique (one extra aggregate).
    ``validate``: the fit watches the last training month as its validation set (fitted on the months
    before it), logs it on epochs 2 and 4 of 5 and keeps the weights with the least validation loss.
    """
    feats = read_stored(spark, features_path)
    if check_keys:
        sequence.require_unique_keys(feats)
    held_out = test_month <= last_file_month
    width = (2 if include_time else 0) + NUM_PRODUCTS
    loaded = joint.JointScorer.load(spark, model_path) if load_model and model_path else None
    # by default the longest possible history, or what a saved model was fitted on
    seq_len = seq_len or (loaded.seq_len if loaded else max(train_month, test_month - 1))
    # a held-out month is read from the same table in one scan (target=None)
    target = None if held_out else sequence.select_target_rows(
        feats, read_stored(spark, test_features_path) if test_features_path else None, test_month, last_file_month)
    test = sequence.build_test(feats, target, train_month, test_month, attr_cols, scale_time_dim=scale_time,
                               include_time=include_time, max_len=max_len)
    log = None
    if loaded:
        model = loaded
    else:
        last = train_month - 1 if validate else train_month
        train = sequence.build_train(feats, last, attr_cols, remove_non_buyers=remove_non_buyers,
                                     scale_time_dim=scale_time, include_time=include_time, max_len=max_len)
        held = sequence.build_test(feats, None, last, train_month, attr_cols, scale_time_dim=scale_time, include_time=include_time,
                                   max_len=max_len) if validate else None
        if validate:
            run = training.train_with_validation(train, held, seq_len, width, max_iter + 1, model_path, reg_param)
            model, log = run.scorer, run.log(spark)
        else:
            model = joint.JointScorer(max_iter=max_iter, reg_param=reg_param).fit(train, seq_len, width)
            if model_path:
                model.save(spark, model_path)
    scored = store_rows(model.predict(test), "scored")
    lengths = sequence.length_report(sequence.month_filter(feats, train_month), 2, max_len)
    if held_out:
        return ScoreResult(scored, metrics.map_at_k_new(scored), metrics.losses(scored), lengths, log)
    if pred_out:
        pred = scored.select("id", *[F.get("p", i).alias(c) for i, c in enumerate(P_COLS)])
        csv_io.write_predictions(pred, pred_out)
    return ScoreResult(scored, None, None, lengths, log)


def rolling_evaluation(spark: SparkSession, features_path: str, pairs: list[tuple[int, int]], attr_cols=ATTR_COLS, scale_time: bool = True,
                       include_time: bool = True, seq_len: int | None = None, max_iter: int = 20, reg_param: float = 0.01) -> DataFrame:
    """(train_month, test_month, n, loss, map_new): a fit and a held-out evaluation for each pair of months.

    All sets are cut from one stored scan of the feature table (see ``history_store.rolling_sets``); each pair gives
    what ``train_and_score`` gives for it alone. A pair without customers to score has no loss and no MAP.
    """
    sets = rolling_sets(read_stored(spark, features_path), pairs, attr_cols, scale_time=scale_time, include_time=include_time)
    width, rows = (2 if include_time else 0) + NUM_PRODUCTS, []
    for (train_month, test_month), (train, test) in sets.items():
        model = joint.JointScorer(max_iter, reg_param).fit(train, seq_len or max(train_month, test_month - 1), width)
        rows.append((train_month, test_month, *training.validate(model.predict(test))))
    return spark.createDataFrame(rows, "train_month int, test_month int, n long, loss double, map_new double")


@dataclass
class Recommendations:
    lists: DataFrame
    product_counts: DataFrame
    top_tally: DataFrame


def write_recommendations(spark: SparkSession, pred_path: str, cleaned_path: str, month: int = LAST_FILE_MONTH,
                          out_path: str | None = None, limit: int | None = None, k: int = TOP_K) -> Recommendations:
    """Ranked lists of new products per customer, owned products of ``month`` removed."""
    pred = csv_io.read_predictions(spark, pred_path)
    owned = recommend.owned_at_month(read_stored(spark, cleaned_path), month)
    ranked = store_rows(recommend.rank_products(recommend.join_owned(pred, owned)), "ranked")
    lists = recommend.format_lists(ranked, limit)
    if out_path:
        csv_io.write_submission(lists, out_path)
    return Recommendations(lists, recommend.product_counts(ranked), recommend.top_tally(ranked, k))


@dataclass
class Inspection:
    sample: DataFrame
    projection: DataFrame
    top_per_unit: DataFrame


def inspect_activations(acts: DataFrame, strata_col: str = "label", fraction: float = SAMPLE_FRACTION,
                        top_n: int = TOP_N_PER_DIM) -> Inspection:
    """``acts`` = (id, vec, label): stratified sample, its 2-D PCA, top-N examples per unit."""
    sample = store_rows(activations.stratified_sample(acts, strata_col, fraction), "sample")
    return Inspection(sample, activations.pca_2d(sample), activations.top_n_per_dim(acts, "vec", top_n))


@dataclass
class ModelInspection:
    label_counts: DataFrame    # per product: positives in its stratified sample and overall (training set)
    projections: DataFrame     # (k, id, label, pc1, pc2): per product, 2-D PCA of its stratified sample
    top_per_unit: DataFrame    # (dim, pos, id, value): test customers with the largest margin per product


def inspect_model(spark: SparkSession, features_path: str, model_path: str, train_month: int = LAST_FILE_MONTH - 1,
                  test_month: int = LAST_FILE_MONTH, last_file_month: int = LAST_FILE_MONTH,
                  test_features_path: str | None = None, attr_cols=ATTR_COLS, scale_time: bool = True,
                  include_time: bool = True, max_len: int | None = None,
                  fraction: float = SAMPLE_FRACTION, top_n: int = TOP_N_PER_DIM) -> ModelInspection:
    """Inspect a saved scorer through its 24 margins ("activations").

    Training customers: for every product, a sample stratified by that
    product's label, its size report and its 2-D projection. Test
    customers: the ``top_n`` customers with the largest margin per product.
    Histories are built as ``train_and_score`` builds them (scaled time by
    default), so the models see the inputs they were fitted on.
    """
    feats = read_stored(spark, features_path)
    model = joint.JointScorer.load(spark, model_path)
    train = sequence.build_train(feats, train_month, attr_cols, scale_time_dim=scale_time,
                                 include_time=include_time, max_len=max_len)
    train_acts = store_rows(model.margins(train).select("id", "y", "vec"), "margins")
    held_out = test_month <= last_file_month
    target = None if held_out else sequence.select_target_rows(
        feats, read_stored(spark, test_features_path) if test_features_path else None, test_month, last_file_month)
    test = sequence.build_test(feats, target, train_month, test_month, attr_cols, scale_time_dim=scale_time,
                               include_time=include_time, max_len=max_len)
    test_acts = model.margins(test)
    long = train_acts.select("id", F.posexplode("y").alias("pos", "label")).select((F.col("pos") + 1).alias("k"), "id", "label")
    # sampled by id first; the vectors join the sample only
    sample = activations.stratified_sample(long, ["k", "label"], fraction, within=["k"]).join(train_acts.select("id", "vec"), "id")
    sample = store_rows(sample, "sample")
    # one projection per product, as the original plots one per product; a product
    # whose sample has fewer than 2 rows has no covariance and gets no projection
    sizes = {r["k"]: r["count"] for r in sample.groupBy("k").count().collect()}   # <= 24 rows
    projections = None
    for k in sorted(k for k, n in sizes.items() if n >= 2):
        pk = activations.pca_2d(sample.filter(F.col("k") == k)).select("k", "id", "label", "pc1", "pc2")
        projections = pk if projections is None else projections.unionByName(pk)
    return ModelInspection(activations.label_counts(train_acts, fraction), projections,
                           activations.top_n_per_dim(test_acts, "vec", top_n))
