"""Scale properties of the physical plans (guards against regressions)."""

import re

from nextbuy.operators import activations, features, recommend, score
from nextbuy.plans import standin as S
from nextbuy.sources import fixtures

from .conftest import SF_SMALL


def plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_n_has_group_limit(spark):
    p = plan(activations.top_n_per_dim(fixtures.activations(spark, SF_SMALL), n=5))
    assert p.count("WindowGroupLimit") == 2 and p.count("Exchange hashpartitioning") == 1


def test_recommendations_on_stored_snapshot_need_no_shuffle(spark):
    s = S.snap_once(spark, SF_SMALL)
    ranked = recommend.rank_products(recommend.join_owned(score.frequency_scores(s), recommend.owned_at_month(s, 78)))
    assert "Exchange hashpartitioning" not in plan(recommend.format_lists(ranked))


def test_cleaning_and_features_are_projections(spark):
    p = plan(features.featurize(S.orders_clean(spark, SF_SMALL), keep=("o_orderkey",)))
    assert "Exchange hashpartitioning" not in p and "SortMergeJoin" not in p


def test_snapshot_scan_prunes_columns(spark):
    p = plan(S.snap(spark, SF_SMALL))
    line = [ln for ln in p.splitlines() if "lineitem" in ln and "ReadSchema" in ln][0]
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in line


def test_raw_snapshots_deal_orders_by_customer_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(S.raw_snapshots(spark, SF_SMALL)).split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)#[^\n]*", p)
    # orders by order, then by customer; lineitem and part for the join, masks by order; customers by customer
    assert dealt.count("ncodpers") == 1 and "o_custkey" not in dealt and dealt.count("o_orderkey") == 1
    assert not re.search(r"hashpartitioning\(ncodpers#\d+L?, t#", p)


def test_feature_rows_are_dealt_before_they_widen(spark, monkeypatch):
    from nextbuy.sources import storage

    plans, real = [], storage.write_bucketed
    monkeypatch.setattr(storage, "write_bucketed", lambda df, *a, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, *a, **k))
    got = S.features_once(spark, SF_SMALL)
    assert plans[0].count("REPARTITION_BY_NUM") == 1
    assert 0 <= plans[0].index("Project") < plans[0].index("Exchange")  # the features are derived after the exchange
    assert len({f for f in got.inputFiles()}) <= 8 and got.count() == S.snapshots_clean(spark, SF_SMALL).count()


def test_raw_snapshots_of_repeated_and_missing_keys(spark, tmp_path):
    import datetime as dt

    day = lambda d: dt.datetime(1996, 3, d)
    tables = {
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
                   [(7, 1, "F", 50.5, day(2), "1-URGENT"), (3, 1, "O", 9.5, day(9), "2-HIGH"), (3, 1, "F", 8.0, day(9), None), (None, 2, "F", 1.0, day(1), "3-MEDIUM"),
                    (5, None, "F", 1.0, day(1), "3-MEDIUM"), (6, 9, "F", 1.0, day(1), "3-MEDIUM"), (8, 2, "F", 1.0, None, "3-MEDIUM")]),
        "customer": ("c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string",
                     [(1, 1, 400.0, "a"), (1, 0, 120.0, "b"), (1, 1, 120.0, "b"), (2, 0, None, "a"), (2, None, 40.0, "a"), (None, 0, 1.0, "a")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N0", 0), (1, "N1", 0)]),
        "region": ("r_regionkey int, r_name string", [(0, "R")]),
        "part": ("p_partkey long, p_brand string", [(1, "Brand#1"), (2, "Brand#3")]),
        "lineitem": ("l_orderkey long, l_partkey long", [(7, 1), (7, 1), (3, 2), (5, 1)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted(([r.ncodpers, r.fecha_dato, r.sexo, r.antiguedad, r.cod_prov, r.nomprov, r.renta, r.ind_ahor_fin_ult1, r.ind_cco_fin_ult1]
                  for r in fixtures.raw_snapshots(spark, str(tmp_path), 1995).collect()), key=str)
    assert got == [[1, "1996-03-09", "H", "     3", 0, "N0", "8", 1, 1],  # the least order, then the least customer row; products of all orders
                   [2, "1996-03-01", "H", None, 0, "N0", "1", 0, 0], [2, None, "H", None, 0, "N0", "1", 0, 0]]


def test_label_counts_shuffle_no_exploded_rows(spark):
    rows = [(i, [int((i + k) % 3 == 0) for k in range(24)]) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, y array<int>")
    p = plan(activations.label_counts(df, 0.05))
    # the strata are joined null-safely: their keys are (coalesce(k), isnull(k), ...)
    assert re.search(r"BroadcastHashJoin \[coalesce\(k#\d+", p) and not re.search(r"SortMergeJoin \[coalesce\(k#\d+", p)
    got = {r.k: (r.n_sample, r.n_pos_sample, r.n_pos_total) for r in activations.label_counts(df, 0.05).collect()}
    total = {k + 1: sum(y[k] for _, y in rows) for k in range(24)}
    # 25 rows for each product; 8.3 of them positive, the row that is left goes to the larger remainder of the others
    assert all(got[k] == (25, 8, n) for k, n in total.items())
