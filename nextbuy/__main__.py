"""Command line: the four steps with the options of the original scripts.

  python -m nextbuy features RAW_CSV OUT_DIR [--test] [--noimpute]
  python -m nextbuy train FEATURES [--testset TEST_FEATURES] [-m TRAIN_MONTH] [-t TEST_MONTH]
                          [-f MODEL_DIR [--load]] [-n MAX_ITER] [--validate] [--pred-out PRED_DIR]
  python -m nextbuy recommend PRED_DIR SUBMIT_DIR [-d CLEANED] [-m MONTH] [--limit K]
  python -m nextbuy inspect ACTIVATIONS [-n TOP_N] [-s FRACTION] [--out DIR]
  python -m nextbuy inspect -f MODEL_DIR --features FEATURES [-m TRAIN_MONTH] [-t TEST_MONTH] [-n] [-s]

Run it with spark-submit on a cluster (the session comes from there), or
with --master for a local run.
"""

from __future__ import annotations

import argparse

from .constants import BASE_YEAR, LAST_FILE_MONTH, SAMPLE_FRACTION, TOP_N_PER_DIM
from .operators import training, trainlog
from .plans import flows
from .session import get_spark


def main(argv=None, spark=None) -> None:
    """Parse the arguments and run one step (``spark``: reuse a session and leave it open)."""
    ap = argparse.ArgumentParser(prog="nextbuy")
    ap.add_argument("--master", default=None)
    sub = ap.add_subparsers(dest="cmd", required=True)

    f = sub.add_parser("features", help="clean, impute and featurize a raw snapshot CSV")
    f.add_argument("raw")
    f.add_argument("out_dir")
    f.add_argument("--test", action="store_true", help="the file has no product columns")
    f.add_argument("--noimpute", action="store_true")
    f.add_argument("--base-year", type=int, default=BASE_YEAR)
    f.add_argument("--impute-from", default=None, help="cleaned table whose statistics fill the gaps")

    t = sub.add_parser("train", help="fit the product models; evaluate a held-out month or predict")
    t.add_argument("features")
    t.add_argument("--testset", default=None)
    t.add_argument("-m", "--train_month", type=int, default=LAST_FILE_MONTH)
    t.add_argument("-t", "--test_month", type=int, default=LAST_FILE_MONTH + 1)
    t.add_argument("--last-file-month", type=int, default=LAST_FILE_MONTH)
    t.add_argument("-f", "--model", default=None, help="folder to save (or with --load, to read) the models")
    t.add_argument("--load", action="store_true")
    t.add_argument("-n", "--max_iter", type=int, default=20)
    t.add_argument("--seq-len", type=int, default=None, help="steps to pad to (default: the longest possible history)")
    t.add_argument("--pred-out", default=None)
    t.add_argument("--validate", action="store_true", help="watch the last training month and keep the best epoch's weights")

    r = sub.add_parser("recommend", help="ranked lists of new products")
    r.add_argument("pred")
    r.add_argument("submit")
    r.add_argument("-d", "--dataset", required=True, help="cleaned table folder")
    r.add_argument("-m", "--month", type=int, default=LAST_FILE_MONTH)
    r.add_argument("--limit", type=int, default=None)

    i = sub.add_parser("inspect", help="stratified sample, 2-D projection, top-N per unit")
    i.add_argument("activations", nargs="?", default=None, help="Parquet with id, vec, label")
    i.add_argument("-f", "--model", default=None, help="saved models: inspect their 24 margins instead")
    i.add_argument("--features", default=None, help="feature table (with --model)")
    i.add_argument("--testset", default=None)
    i.add_argument("-m", "--train_month", type=int, default=LAST_FILE_MONTH - 1)
    i.add_argument("-t", "--test_month", type=int, default=LAST_FILE_MONTH)
    i.add_argument("--last-file-month", type=int, default=LAST_FILE_MONTH)
    i.add_argument("-n", "--top_n_samples", type=int, default=TOP_N_PER_DIM)
    i.add_argument("-s", "--shuffle_split_size", type=float, default=SAMPLE_FRACTION)
    i.add_argument("--out", default=None)

    a = ap.parse_args(argv)
    own_session = spark is None
    spark = spark or get_spark(a.master)
    if a.cmd == "features":
        res = flows.build_feature_tables(spark, a.raw, a.out_dir, is_test=a.test, do_impute=not a.noimpute,
                                         base_year=a.base_year, impute_stats_from=a.impute_from)
        print(res)
    elif a.cmd == "train":
        res = flows.train_and_score(spark, a.features, a.train_month, a.test_month, a.testset, a.last_file_month,
                                    seq_len=a.seq_len, max_iter=a.max_iter, pred_out=a.pred_out,
                                    model_path=a.model, load_model=a.load, validate=a.validate)
        res.train_lengths.show(truncate=False)
        if res.log is not None:
            trainlog.epoch_report(res.log, ["loss", training.VAL_LOSS, training.VAL_MAP]).orderBy("epoch").show(100, truncate=False)
        if res.map7_new is not None:
            print("MAP@7 on new products:", res.map7_new.first().asDict())
            res.losses.orderBy("n_obs").show(50, truncate=False)
    elif a.cmd == "recommend":
        res = flows.write_recommendations(spark, a.pred, a.dataset, a.month, a.submit, a.limit)
        res.product_counts.orderBy("k").show(24, truncate=False)
        res.top_tally.orderBy("k").show(24, truncate=False)
    elif a.cmd == "inspect" and a.model:
        res = flows.inspect_model(spark, a.features, a.model, a.train_month, a.test_month, a.last_file_month,
                                  a.testset, fraction=a.shuffle_split_size, top_n=a.top_n_samples)
        res.label_counts.orderBy("k").show(24, truncate=False)
        if a.out and res.projections is not None:
            res.projections.write.mode("overwrite").parquet(f"{a.out}/projections")
            res.top_per_unit.write.mode("overwrite").parquet(f"{a.out}/top_per_unit")
        res.top_per_unit.orderBy("dim", "pos").show(40, truncate=False)
    elif a.cmd == "inspect":
        acts = spark.read.parquet(a.activations)
        res = flows.inspect_activations(acts, fraction=a.shuffle_split_size, top_n=a.top_n_samples)
        if a.out:
            res.projection.write.mode("overwrite").parquet(f"{a.out}/projection")
            res.top_per_unit.write.mode("overwrite").parquet(f"{a.out}/top_per_unit")
        res.top_per_unit.orderBy("dim", "pos").show(40, truncate=False)
    if own_session:
        spark.stop()


if __name__ == "__main__":
    main()
