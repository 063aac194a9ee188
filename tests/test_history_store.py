"""Incremental and rolling histories against building all months anew."""

import random

import pytest
from pyspark.sql import functions as F

from nextbuy.constants import ATTR_COLS, Y_COLS
from nextbuy.operators import sequence
from nextbuy.operators.history_store import HistoryStore, merged_stats, rolling_sets
from nextbuy.operators.scale import clamp_negatives, zscore_stats


@pytest.fixture(scope="module")
def months(spark):
    """Rows of 60 customers over 12 months with gaps, late joiners, nulls and negative seniority."""
    rnd = random.Random(5)
    rows = []
    for i in range(60):
        for t in range(rnd.randint(1, 11), 13):
            if rnd.random() < 0.7:
                age = None if rnd.random() < 0.1 else rnd.uniform(18, 90)
                rows.append((i, t, (t - 1) % 12 + 1, age, float(rnd.randint(-3, 200)), rnd.choice([None, 1e5 * rnd.random()]), rnd.randint(0, 1),
                             *[rnd.randint(0, 1) for _ in Y_COLS]))
    schema = "id long, t int, t_month int, age double, seniority double, income double, sex int, " + ", ".join(f"{c} int" for c in Y_COLS)
    return spark.createDataFrame(rows, schema).repartition(6).cache()


def close(a, b):
    if isinstance(a, (list, tuple)):
        return isinstance(b, (list, tuple)) and len(a) == len(b) and all(close(x, y) for x, y in zip(a, b, strict=True))
    if a is None or b is None:
        return a is b
    return abs(a - b) <= 1e-9 * max(1, abs(a))


def same(got, want):
    g, w = ({r.id: r for r in d.select("id", "n_obs", "t_max", "attrs", "x", "y", "y_last").collect()} for d in (got, want))
    assert set(g) == set(w) and len(w) > 5
    for i in w:
        assert close(list(g[i]), list(w[i])), (g[i], w[i])


def test_equal_to_a_rebuild_after_each_month(spark, months):
    store = HistoryStore.build(months.filter("t <= 8"), "growing", buckets=4)
    versions = [store]
    for t in range(9, 13):
        if t < 12:
            same(store.training(spark), sequence.build_train(months, t - 1, ATTR_COLS, scale_time_dim=True))
        before, store = store, store.append(months.filter(F.col("t") == t))
        versions.append(store)
        same(store.training(spark), sequence.build_train(months, t, ATTR_COLS, scale_time_dim=True))
        same(store.testing(spark, t - 1), sequence.build_test(months, None, t - 1, t, ATTR_COLS, scale_time_dim=True))
        same(store.testing(spark, 6, scale_time=False), sequence.build_test(months, None, 6, t, ATTR_COLS))
        assert before.last_month == t - 1 and store.last_month == t
    same(versions[0].training(spark), sequence.build_train(months, 8, ATTR_COLS, scale_time_dim=True))  # older versions stay
    with pytest.raises(ValueError, match="not after"):
        store.append(months.filter("t = 12"))
    for v in versions:
        v.drop(spark)


def test_several_months_at_once_and_an_empty_store(spark, months):
    store = HistoryStore.build(months.limit(0), "empty", buckets=3)
    assert store.last_month is None and store.rows(spark).count() == 0
    store = store.append(months.filter("t <= 5")).append(months.filter("t in (6, 7, 9)")).append(months.limit(0))
    same(store.training(spark), sequence.build_train(months.filter("t <= 7 or t = 9"), 9, ATTR_COLS, scale_time_dim=True))


def test_stored_rows_are_not_exchanged(spark, months):
    store = HistoryStore.build(months.filter("t <= 8"), "plan", buckets=4)
    spark.conf.set("spark.sql.shuffle.partitions", "32")  # more than the buckets: still only the new rows move
    try:
        merged = store.merged(months.filter("t = 9"))
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert "REPARTITION_BY_NUM" in plan.split("Exchange hashpartitioning")[1].split("\n")[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    after = store.append(months.filter("t = 9"))
    files = [f for f in after.rows(spark).inputFiles()]
    assert len(files) <= 4  # one file a bucket
    plan = after.training(spark)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_rows_of_a_bucketed_table_are_not_exchanged(spark, months, monkeypatch):
    from nextbuy.sources.storage import store_by_customer

    plans, real = [], HistoryStore._written
    monkeypatch.setattr(HistoryStore, "_written", lambda self, g, *more: plans.append(g._jdf.queryExecution().executedPlan().toString()) or real(self, g, *more))
    store = HistoryStore.build(store_by_customer(months, "months").filter("t <= 8"), "dealt", dealt=True)
    assert "Exchange" not in plans[0]
    same(store.training(spark), sequence.build_train(months, 8, ATTR_COLS, scale_time_dim=True))
    files = [f.rsplit("/", 1)[1] for f in store.rows(spark).inputFiles()]
    assert len(files) <= store.buckets


def test_merged_statistics(months):
    from nextbuy.operators.history_store import _moments

    moments = _moments(months)
    for month in (3, 7, 12):
        rows = months.filter(F.col("t") <= month)
        for clamped in (True, False):
            want = zscore_stats(clamp_negatives(rows) if clamped else rows)
            got = merged_stats(moments, month, clamped)
            assert set(got) == set(want) and all(close(list(got[c]), list(want[c])) for c in want)


def test_rolling_pairs_equal_single_runs(months):
    pairs = [(6, 7), (7, 9), (9, 10), (11, 12)]
    got = rolling_sets(months, pairs)
    for m, t in pairs:
        same(got[m, t][0], sequence.build_train(months, m, ATTR_COLS, scale_time_dim=True))
        same(got[m, t][1], sequence.build_test(months, None, m, t, ATTR_COLS, scale_time_dim=True))
        plan = got[m, t][0]._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan  # cut from the stored lines


def test_timelines_hold_attributes_of_the_cut_months_only(months):
    from nextbuy.operators.history_store import timelines

    lines = timelines(months, [(6, 7), (6, 9)])
    assert lines.columns == ["id", "steps", "train_6", "test_7", "test_9"]
    assert lines.schema["steps"].dataType.elementType.names == ["t", "t_month", "y"]  # no attributes in the months' array
    rows = {(r.id, r.t): r for r in months.collect()}
    for r in lines.collect():
        own = sorted(t for i, t in rows if i == r.id)
        assert [s.t for s in r.steps] == own
        last = max((t for t in own if t <= 6), default=None)
        for got, t in ((r.train_6, last), (r.test_7, 7 if 7 in own else None), (r.test_9, 9 if 9 in own else None)):
            assert (got is None) == (t is None)
            if t is not None:
                assert got[0] == t and got[ATTR_COLS.index("seniority")] == rows[r.id, t].seniority
