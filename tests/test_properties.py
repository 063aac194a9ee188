"""Array metrics and ranking against plain-Python definitions on generated cases.

Hypothesis draws a whole batch of cases; Spark evaluates the batch in one job.
"""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nextbuy.constants import Y_COLS
from nextbuy.functions import arrays as A
from nextbuy.operators import sequence

N = 24
labels = st.lists(st.integers(0, 1), min_size=N, max_size=N)
# few distinct score values so that ties are common
scores = st.lists(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 0.9]), min_size=N, max_size=N)
owned = st.one_of(st.none(), st.lists(st.integers(0, 1), min_size=N, max_size=N))
cases = st.lists(st.tuples(labels, scores, labels, owned), min_size=30, max_size=60)


def ap7(y, p):
    order = sorted(range(N), key=lambda i: (-p[i], i))[:7]
    n_true = sum(1 for v in y if v > 0)
    if n_true == 0:
        return 0.0
    hits, total = 0, 0.0
    for r, i in enumerate(order, start=1):
        if y[i] > 0:
            hits += 1
            total += hits / r
    return total / min(n_true, 7)


def ranked(p, o):
    cand = [i for i in range(N) if p[i] > 0 and not (o is not None and o[i] >= 1)]
    return sorted(cand, key=lambda i: (-p[i], -i))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(cases)
def test_metrics_match_definitions(spark, batch):
    rows = [(i, y, p, last, o) for i, (y, p, last, o) in enumerate(batch)]
    df = spark.createDataFrame(rows, "i int, y array<int>, p array<double>, last array<int>, o array<int>")
    out = df.select("i", A.ap_at_k("y", "p").alias("ap"),
                    A.ap_at_k(A.new_labels("y", "last"), A.mask_owned("p", "last")).alias("ap_new"),
                    A.ranked_candidates("p", "o").alias("rk")).orderBy("i").collect()
    for (i, y, p, last, o), r in zip(rows, out):
        assert abs(r["ap"] - ap7(y, p)) < 1e-12
        new = [max(0, min(1, a - b)) for a, b in zip(y, last)]
        masked = [(1 - b) * a for a, b in zip(p, last)]
        assert abs(r["ap_new"] - ap7(new, masked)) < 1e-12
        assert r["rk"] == ranked(p, o)


def test_hot_duplicated_key_is_dropped_before_collect(spark):
    # customer 0 has a third of all rows (duplicated months); histories keep <= 17 rows per customer
    rows = [(0, 1 + i % 5, 1) for i in range(3000)]
    rows += [(c, t, 1) for c in range(1, 601) for t in range(1, 11)]
    df = spark.createDataFrame(rows, "id long, t int, y int")
    df = df.select("id", "t", (F.col("t") % 12 + 1).alias("t_month"),
                   *[F.col("y").alias(c) for c in Y_COLS])
    h = sequence.build_train(df, max_month=20, max_len=17)
    assert h.filter("id = 0").count() == 0 and h.count() == 600
