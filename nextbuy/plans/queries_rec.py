"""Registered queries: recommendations, training logs, activations, scoring, I/O
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..constants import ATTR_COLS, P_COLS, PRODUCT_LABELS, SAMPLE_FRACTION, TOP_N_PER_DIM, Y_COLS
from ..operators import activations, batches, features, impute, joint, metrics, recommend, score, sequence, training, trainlog
from ..operators.artifact import fit_artifact, load_artifact
from ..session import shared_output_dir
from ..sources import csv_io, fixtures
from ..sources.manifest import build_manifest
from ..sources.storage import store_rows
from ..streaming.month_scan import run_month_scan
from . import flows
from . import standin as S
from .registry import query


def _scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return shared_output_dir(spark, f"io/{name}-{uuid.uuid4().hex}")


def _pred(spark, sf_dir):
    """Stand-in predictions: how often the customer owned each product before their last month."""
    return score.frequency_scores(S.snap(spark, sf_dir))


def _ranked(spark, sf_dir):
    s = S.snap_once(spark, sf_dir)
    joined = recommend.join_owned(score.frequency_scores(s), recommend.owned_at_month(s, S.TRAIN_MONTH))
    return recommend.rank_products(joined)


# --- 2.1 sources and sinks ----------------------------------------------------------------------

@query("io_month_scan")
def io_month_scan(spark, sf_dir):
    """IO3/RE1: products owned in exactly month 78, scanned from a stored table partitioned by month."""
    path = _scratch(spark, "by-month")
    S.snap(spark, sf_dir).write.partitionBy("t").parquet(path)
    return csv_io.month_scan(spark, path, S.TRAIN_MONTH).select("id", *Y_COLS)


@query("io_month_scan_manifest")
def io_month_scan_manifest(spark, sf_dir):
    """IO3/RE1: month 78 of an unpartitioned folder of CSV files: a month manifest is built over the files
    up to month 60, refreshed when the later files have come, and only files that hold month 78 are read."""
    path = _scratch(spark, "unpartitioned")
    rows = S.snap(spark, sf_dir)
    csv_io.write_csv(rows.filter("t <= 60").repartitionByRange(8, "t"), path)
    manifest = build_manifest(spark, path, schema=rows.schema)
    csv_io.write_csv(rows.filter("t > 60").repartitionByRange(8, "t"), path, mode="append")
    return manifest.refreshed(spark).scan(spark, S.TRAIN_MONTH).select("id", *Y_COLS)


@query("io_month_stream")
def io_month_stream(spark, sf_dir):
    """IO3 (incremental): month-78 rows of a stored snapshot folder, scanned as a file stream
    with a byte-sized trigger, into a checkpointed Parquet sink."""
    src = _scratch(spark, "snapshots")
    s = S.snap(spark, sf_dir)
    s.write.parquet(src)
    stored = spark.read.parquet(src)
    out = run_month_scan(spark, src, stored.schema, S.TRAIN_MONTH, _scratch(spark, "month"),
                         _scratch(spark, "month-ckpt"), columns=["id", *Y_COLS])
    return out


@query("io_read_raw")
def io_read_raw(spark, sf_dir):
    """IO1/IO5: raw snapshot rows written as a real file has them (columns in another order, blanks
    around integers, flags as 1.0, float ids) and read back with the raw schema."""
    path = _scratch(spark, "raw")
    raw = S.raw_snapshots(spark, sf_dir)
    spelt = {c: F.concat(F.lit(" "), F.col(c).cast("string")) for c in ("indrel", "tipodom")}
    spelt |= {c: F.col(c).cast("double").cast("string") for c in ("cod_prov", *PRODUCT_LABELS)}
    spelt["ncodpers"] = F.format_string("%.18e", F.col("ncodpers").cast("double"))
    csv_io.write_csv(raw.withColumns(spelt).select(*reversed(raw.columns)), path)
    return csv_io.read_raw(spark, path)


def _damaged(spark, sf_dir):
    """Raw snapshot rows in a CSV with ids above 2**53 and, by rule, fractions, bad text and values out of range."""
    path = _scratch(spark, "damaged")
    raw = S.raw_snapshots(spark, sf_dir)
    who = F.col("ncodpers")
    text = {c: F.col(c).cast("string") for c in raw.columns}
    text["ncodpers"] = F.when(who % 101 == 0, "nobody").otherwise((who + F.lit((1 << 53) + 1)).cast("string"))
    text["indrel"] = F.when(who % 97 == 0, F.concat(F.col("indrel").cast("string"), F.lit(".7"))).otherwise(F.concat(F.col("indrel").cast("string"), F.lit(".0")))
    text["cod_prov"] = F.when(who % 89 == 0, "1e12").when(who % 83 == 0, " ").otherwise(F.col("cod_prov").cast("string"))
    csv_io.write_csv(raw.select(*[text[c].alias(c) for c in raw.columns]), path)
    return csv_io.read_raw_checked(spark, path)


@query("io_read_checked")
def io_read_checked(spark, sf_dir):
    """IO1: a damaged raw file read with exact ids, bad fields null and kept as text beside the typed row."""
    rescued = F.array_join(F.array_sort(F.transform(F.map_entries("_rescued"), lambda e: F.concat_ws("=", e.key, e.value))), ";")
    return _damaged(spark, sf_dir).rows.select("ncodpers", "fecha_dato", "indrel", "cod_prov", rescued.alias("rescued"))


@query("io_rejects")
def io_rejects(spark, sf_dir):
    """IO1: what was rejected in a damaged raw file, by field, text and reason."""
    return _damaged(spark, sf_dir).rejects.groupBy("field", "value", "reason").agg(F.count("*").alias("n"))


@query("io_write_features")
def io_write_features(spark, sf_dir):
    """IO2/IO6: feature table written as CSV and read back with its schema."""
    feats = features.featurize(impute.impute(S.snapshots_clean_once(spark, sf_dir)))
    path = _scratch(spark, "features")
    csv_io.write_csv(feats, path)
    return csv_io.read_csv(spark, path, feats.schema)


@query("io_read_pred")
def io_read_pred(spark, sf_dir):
    """IO7/IO4: predictions written headerless, with float ids as the scoring step writes them, and read back."""
    path = _scratch(spark, "pred")
    pred = _pred(spark, sf_dir)
    csv_io.write_predictions(pred.withColumn("id", F.format_string("%.18e", F.col("id").cast("double"))), path)
    return csv_io.read_predictions(spark, path)


@query("io_write_submission")
def io_write_submission(spark, sf_dir):
    """IO8: recommendation lists written with header and CRLF line ends, read back."""
    path = _scratch(spark, "submission")
    csv_io.write_submission(recommend.format_lists(_ranked(spark, sf_dir)), path)
    return csv_io.read_submission(spark, path)


@query("io_submission_file")
def io_submission_file(spark, sf_dir):
    """IO8: recommendation lists written as one file with one header and no final line end, by all tasks, read back."""
    path = f"{_scratch(spark, 'submission-file')}/submission.csv"
    csv_io.write_submission_file(recommend.format_lists(_ranked(spark, sf_dir)), path, rows_per_part=1_000)
    return csv_io.read_submission(spark, path)


# --- 2.8 recommendations --------------------------------------------------------------------------

@query("rec_join_owned")
def rec_join_owned(spark, sf_dir):
    """RE2: predictions left-joined with the month-78 snapshot (no snapshot -> nulls)."""
    s = S.snap_once(spark, sf_dir)
    j = recommend.join_owned(score.frequency_scores(s), recommend.owned_at_month(s, S.TRAIN_MONTH))
    return j.select("id", *[F.get("p", i).alias(c) for i, c in enumerate(P_COLS)],
                    *[F.get("owned", i).alias(f"owned_{i + 1}") for i in range(len(Y_COLS))])


@query("rec_product_counts")
def rec_product_counts(spark, sf_dir):
    """RE3/RE4: per product, customers with score > 0 and those not owning it."""
    s = S.snap_once(spark, sf_dir)
    j = recommend.join_owned(score.frequency_scores(s), recommend.owned_at_month(s, S.TRAIN_MONTH))
    return recommend.product_counts(j)


@query("rec_anti_owned")
def rec_anti_owned(spark, sf_dir):
    """RE5/RE6: candidate products (score > 0) minus owned products."""
    return recommend.candidates_table(_ranked(spark, sf_dir))


@query("rec_rank")
def rec_rank(spark, sf_dir):
    """RE7: candidates ranked by score, equal scores -> higher product index first."""
    return recommend.ranked_table(_ranked(spark, sf_dir))


@query("rec_top7_tally")
def rec_top7_tally(spark, sf_dir):
    """RE8: how often each product is in the first 7 places."""
    return recommend.top_tally(_ranked(spark, sf_dir))


@query("rec_format")
def rec_format(spark, sf_dir):
    """RE9/RE10: space-joined labels per customer (whole list), empty when no candidate."""
    return recommend.format_lists(_ranked(spark, sf_dir))


# --- 2.7 training logs ----------------------------------------------------------------------------

@query("log_best_epoch")
def log_best_epoch(spark, sf_dir):
    """EV16: epochs where each metric improved on all earlier epochs; the kept checkpoint flagged."""
    return trainlog.improvements(fixtures.training_log(spark, sf_dir))


@query("log_periodic_best")
def log_periodic_best(spark, sf_dir):
    """EV17: improvements of the loss, counted on validation epochs only (epoch % 5 in 2, 4)."""
    return trainlog.periodic_improvements(fixtures.training_log(spark, sf_dir))


@query("log_pivot")
def log_pivot(spark, sf_dir):
    """EV18: epoch x metric report."""
    return trainlog.epoch_report(fixtures.training_log(spark, sf_dir))


@query("log_best_last")
def log_best_last(spark, sf_dir):
    """EV16: best (earliest minimum) and last value per metric."""
    return trainlog.best_and_last(fixtures.training_log(spark, sf_dir))


# --- 2.9 activations --------------------------------------------------------------------------------

@query("an_stratified_sample")
def an_stratified_sample(spark, sf_dir):
    """AN1: 0.5 % of every label stratum, in md5(id) order."""
    return activations.stratified_sample(fixtures.activations(spark, sf_dir), "label", SAMPLE_FRACTION).select(
        "id", "label")


@query("an_label_counts")
def an_label_counts(spark, sf_dir):
    """AN2: per product, positives in a 0.5 % sample stratified by that product, and overall (train targets)."""
    targets = store_rows(S.trainset(spark, sf_dir).select("id", "y"), "targets")
    return activations.label_counts(targets, SAMPLE_FRACTION)


@query("an_topn_per_dim")
def an_topn_per_dim(spark, sf_dir):
    """AN3: the 10 examples with the largest value of every vector position, ascending."""
    return activations.top_n_per_dim(fixtures.activations(spark, sf_dir), "vec", TOP_N_PER_DIM)


@query("an_pca_2d")
def an_pca_2d(spark, sf_dir):
    """AN4: 2-D PCA projection of a 10 % stratified sample of the activations."""
    sample = activations.stratified_sample(fixtures.activations(spark, sf_dir), "label", 0.1)
    return activations.pca_2d(sample)


@query("an_pca_explained")
def an_pca_explained(spark, sf_dir):
    """AN4: the share of the variance of all activations along their first two components."""
    return activations.pca_explained(fixtures.activations(spark, sf_dir))


# --- 2.7 batches and scoring ---------------------------------------------------------------------

@query("batch_assign")
def batch_assign(spark, sf_dir):
    """EV3: mini-batches of 256 inside each history-length bucket, remainder in the last batch."""
    return batches.assign_batches(S.trainset(spark, sf_dir).select("id", "n_obs").transform(lambda d: store_rows(d, "lengths")))


def _fit_and_score(spark, sf_dir):
    feats = S.features_once(spark, sf_dir)
    model = joint.JointScorer().fit(S.full_trainset(spark, sf_dir, feats), S.PAD_LEN, 26)
    return model.predict(S.full_testset(spark, sf_dir, feats))


@query("score_products")
def score_products(spark, sf_dir):
    """EV1/EV2: 24 logistic regressions fit together on all attributes and training histories, scores for the test month."""
    p = _fit_and_score(spark, sf_dir)
    return p.select("id", *[F.get("p", i).alias(c) for i, c in enumerate(P_COLS)])


@query("eval_holdout")
def eval_holdout(spark, sf_dir):
    """EV19: train on months <= 78, score month 79, MAP@7 on new products."""
    return metrics.map_at_k_new(_fit_and_score(spark, sf_dir))


def _fixed_scores(spark, sf_dir):
    """Scores of the test month by fixed weights: a rule of product and input number (see S.fixed_weight)."""
    return store_rows(S.fixed_scorer().predict(S.full_testset(spark, sf_dir)), "fixed-scores")


@query("score_fixed_weights")
def score_fixed_weights(spark, sf_dir):
    """EV1: scores by a scorer with given weights over all attributes and padded histories of the test month."""
    return _fixed_scores(spark, sf_dir).select("id", *[F.get("p", i).alias(c) for i, c in enumerate(P_COLS)])


@query("eval_fixed_weights")
def eval_fixed_weights(spark, sf_dir):
    """EV1/EV19: mean loss and MAP@7 on new products of the test month, scored by given weights."""
    scored = _fixed_scores(spark, sf_dir)
    n, loss, map_new = training.validate(scored)
    return spark.createDataFrame([(n, loss, map_new)], "n long, loss double, map_new double")


def _validated_run(spark, sf_dir):
    feats = S.features_once(spark, sf_dir)
    train = sequence.build_train(feats, S.TRAIN_MONTH - 1, attr_cols=ATTR_COLS, scale_time_dim=True)
    held = sequence.build_test(feats, None, S.TRAIN_MONTH - 1, S.TRAIN_MONTH, attr_cols=ATTR_COLS, scale_time_dim=True)
    return training.train_with_validation(train, held, S.PAD_LEN, 26, epochs=20, path=_scratch(spark, "weights"))


@query("log_validated_fit")
def log_validated_fit(spark, sf_dir):
    """EV16/EV17: log of a fit on months <= 77 validated on month 78: the improvements of the validation
    loss, on epochs 2 and 4 of 5 only, the kept one flagged."""
    return trainlog.periodic_improvements(_validated_run(spark, sf_dir).log(spark), metric=training.VAL_LOSS)


@query("log_validated_report")
def log_validated_report(spark, sf_dir):
    """EV17/EV18: training loss, validation loss and MAP@7 on new products of each epoch of a validated fit."""
    return trainlog.epoch_report(_validated_run(spark, sf_dir).log(spark), ["loss", training.VAL_LOSS, training.VAL_MAP])


@query("score_from_artifact")
def score_from_artifact(spark, sf_dir):
    """FE5/IM1/SC1/EV1: month 79 scored from a saved artifact (fills, categories, statistics and histories of
    months <= 78, given weights) without the training table."""
    path = _scratch(spark, "artifact")
    cleaned = S.snapshots_clean_once(spark, sf_dir)
    fit_artifact(cleaned, S.TRAIN_MONTH, path, scorer=S.fixed_scorer(), fit=False)
    scored = load_artifact(spark, path).score(S.target_rows(cleaned).drop(*Y_COLS))
    return scored.select("id", *[F.get("p", i).alias(c) for i, c in enumerate(P_COLS)])


@query("eval_rolling")
def eval_rolling(spark, sf_dir):
    """EV19: fits on months <= 72, 75 and 78 evaluated on the month after each, all cut from one stored scan."""
    path = _scratch(spark, "features")
    S.features_once(spark, sf_dir).write.parquet(path)
    return flows.rolling_evaluation(spark, path, [(m, m + 1) for m in (S.TRAIN_MONTH - 6, S.TRAIN_MONTH - 3, S.TRAIN_MONTH)], seq_len=S.PAD_LEN)
