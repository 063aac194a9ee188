"""The four flows end to end on raw-schema files derived from the smallest tables."""

from pyspark.sql import functions as F

from nextbuy.constants import PRODUCT_LABELS
from nextbuy.plans import flows
from nextbuy.sources import csv_io, fixtures

from .conftest import SF_SMALL


def test_flows_end_to_end(spark, tmp_path):
    raw = fixtures.raw_snapshots(spark, SF_SMALL).withColumn("_t", F.substring("fecha_dato", 1, 7))
    month = F.col("_t")
    # training file: months up to July 2001 (t <= 79); test file: August 2001 without products
    train_raw, test_raw = str(tmp_path / "train_csv"), str(tmp_path / "test_csv")
    csv_io.write_csv(raw.filter(month <= "2001-07").drop("_t"), train_raw)
    csv_io.write_csv(raw.filter(month == "2001-08").drop("_t", *PRODUCT_LABELS), test_raw)

    tr = flows.build_feature_tables(spark, train_raw, str(tmp_path / "out"), base_year=1995,
                                    table_prefix="flowtest", buckets=4)
    te = flows.build_feature_tables(spark, test_raw, str(tmp_path / "out"), is_test=True, base_year=1995)
    from nextbuy.sources.storage import read_stored
    feats = read_stored(spark, tr.features_path)
    assert feats.filter(F.col("age").isNull() | F.col("income").isNull()).count() == 0

    model_dir = str(tmp_path / "models")
    held_out = flows.train_and_score(spark, tr.features_path, train_month=78, test_month=79,
                                     last_file_month=79, max_iter=5, model_path=model_dir, check_keys=True)
    m = held_out.map7_new.first()
    assert m["n"] > 0 and 0.0 <= m["map"] <= 1.0
    assert held_out.losses.filter(F.col("n_obs").isNull()).first()["n"] == m["n"]
    reloaded = flows.train_and_score(spark, tr.features_path, train_month=78, test_month=79,
                                     last_file_month=79, model_path=model_dir, load_model=True)
    assert abs(reloaded.map7_new.first()["map"] - m["map"]) < 1e-12

    watched = flows.train_and_score(spark, tr.features_path, train_month=78, test_month=79, last_file_month=79, max_iter=5, validate=True,
                                    model_path=str(tmp_path / "watched"))
    assert {r.epoch for r in watched.log.filter("metric = 'val_loss'").collect()} == {2, 4}
    assert watched.map7_new.first()["n"] == m["n"]

    rolled = flows.rolling_evaluation(spark, tr.features_path, [(70, 71), (78, 79)], max_iter=5)
    assert [(r.train_month, r.test_month) for r in rolled.collect()] == [(70, 71), (78, 79)]
    one = rolled.filter("test_month = 79").first()  # as the single run
    assert one["n"] == m["n"] and abs(one["map_new"] - m["map"]) < 1e-9
    assert abs(one["loss"] - held_out.losses.filter("n_obs is null").first()["bce"]) < 1e-6

    seen = flows.inspect_model(spark, tr.features_path, model_dir, train_month=78, test_month=79, last_file_month=79, fraction=0.2, top_n=3)
    assert seen.label_counts.count() == 24 and seen.top_per_unit.count() == 24 * 3

    pred_path = str(tmp_path / "pred")
    flows.train_and_score(spark, tr.features_path, train_month=79, test_month=80, test_features_path=te.features_path,
                          last_file_month=79, max_iter=5, pred_out=pred_path)
    pred = csv_io.read_predictions(spark, pred_path)
    assert pred.count() > 0

    sub_path = str(tmp_path / "submission")
    rec = flows.write_recommendations(spark, pred_path, tr.cleaned_path, month=79, out_path=sub_path)
    back = csv_io.read_submission(spark, sub_path)
    assert back.count() == pred.count()
    assert rec.product_counts.count() == 24 and rec.top_tally.count() == 24

    insp = flows.inspect_activations(fixtures.activations(spark, SF_SMALL), fraction=0.2, top_n=3)
    assert insp.projection.count() == insp.sample.count() > 0
    assert insp.top_per_unit.count() == 64 * 3


def test_bucketed_histories_skip_shuffles(spark):
    from nextbuy.operators import sequence
    from nextbuy.plans import standin as S

    s = S.snap_once(spark, SF_SMALL)
    for h in (sequence.build_train(s, 78), sequence.build_test(s, None, 78, 79)):
        plan = h._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan
