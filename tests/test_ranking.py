"""The skew-safe ranking equals a plain window; samples and batches against brute force."""

import hashlib
import math
import random
from fractions import Fraction

from pyspark.sql import Window
from pyspark.sql import functions as F

from nextbuy.operators import activations, ranking


def _skewed(spark, n=6000):
    # one group holds half of the rows
    rows = [(i, 0 if i % 2 == 0 else (i % 7) + 1) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g int")


def test_rank_in_groups_equals_window(spark):
    df = _skewed(spark)
    got = ranking.rank_in_groups(df, ["g"], "id", prefix_len=2).select("id", "_rank", "_n")
    w = Window.partitionBy("g").orderBy(F.md5(F.col("id").cast("string")), "id")
    ref = df.select("id", F.row_number().over(w).alias("rn"), F.count("*").over(Window.partitionBy("g")).alias("n"))
    bad = got.join(ref, "id").filter((F.col("_rank") != F.col("rn")) | (F.col("_n") != F.col("n")))
    assert got.count() == df.count() and bad.count() == 0


def plain_shares(sizes, fraction, spell):
    """{stratum: rows to take}: whole parts of the proportional shares, then the largest remainders, ties by md5."""
    n = sum(sizes.values())
    want = math.ceil(fraction * n)
    whole = {s: c * want // n for s, c in sizes.items()}
    rest = sorted(sizes, key=lambda s: (-Fraction(sizes[s] * want, n) + whole[s], hashlib.md5(spell(s).encode()).hexdigest()))
    for s in rest[:want - sum(whole.values())]:
        whole[s] += 1
    return whole


def test_stratified_sample_brute_force(spark):
    df = _skewed(spark)
    for frac, seed in ((0.03, None), (0.005, 7)):
        tag = "" if seed is None else f":{seed}"
        got = [r["id"] for r in activations.stratified_sample(df, "g", frac, seed=seed).collect()]
        pdf = df.toPandas()
        pdf["h"] = [hashlib.md5(f"{i}{tag}".encode()).hexdigest() for i in pdf["id"]]
        take = plain_shares(pdf.groupby("g").size().to_dict(), frac, lambda s, tag=tag: f"{s}{tag}")
        expect = [i for g, own in pdf.groupby("g") for i in own.sort_values(["h", "id"]).head(take[g])["id"]]
        assert sorted(got) == sorted(expect) and len(got) == math.ceil(6000 * frac)


def test_shares_on_random_inputs(spark):
    rnd = random.Random(4)
    cases = {c: {s: rnd.choice([1, 2, 3, 10, 10, 500, 7]) for s in range(rnd.randint(1, 9))} for c in range(50)}
    cases[50] = {0: 10**14, 1: 10**14 - 1, 2: 5}
    for fraction in (0.005, 0.1, 0.37, 1.0):
        rows = [(c, s, n) for c, own in cases.items() for s, n in own.items()]
        got = ranking.shares(spark.createDataFrame(rows, "case int, g int, _n long"), ["case", "g"], fraction, within=["case"], seed=3).collect()
        want = {}
        for c, own in cases.items():
            want |= {(c, s): k for s, k in plain_shares(own, fraction, lambda s, c=c: f"{c}:{s}:3").items()}
        assert {(r.case, r.g): r["_k"] for r in got} == want
        for c, own in cases.items():
            assert sum(k for (d, _), k in want.items() if d == c) == math.ceil(fraction * sum(own.values()))


def test_sample_edge_cases(spark):
    none = spark.createDataFrame([], "id long, g int")
    assert activations.stratified_sample(none, "g", 0.5).count() == 0
    nulls = spark.createDataFrame([(i, None if i % 2 else 1) for i in range(10)], "id long, g int")
    got = activations.stratified_sample(nulls, "g", 0.5).collect()
    assert len(got) == 5 and {sum(r.g is None for r in got)} <= {2, 3}
    labels = spark.createDataFrame([(i, [int(i < 3), 1] + [0] * 22) for i in range(400)], "id long, y array<int>")
    counts = {r.k: (r.n_sample, r.n_pos_sample, r.n_pos_total) for r in activations.label_counts(labels, 0.005).collect()}
    assert counts[1] == (2, 0, 3) and counts[2] == (2, 2, 400) and counts[3] == (2, 0, 0)


def test_top_n_per_dim_brute_force(spark):
    rows = [(i, [float((i * 37 + d * 11) % 101) for d in range(4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = activations.top_n_per_dim(df, n=5).collect()
    for d in range(4):
        best = sorted(rows, key=lambda r: (-r[1][d], r[0]))[:5]
        listed = sorted([r for r in got if r["dim"] == d + 1], key=lambda r: r["pos"])
        assert [r["id"] for r in listed] == [b[0] for b in reversed(best)]


def test_seeded_orders_differ_but_keep_sizes(spark):
    from nextbuy.operators import batches
    df = _skewed(spark).withColumnRenamed("g", "n_obs")
    a = batches.assign_batches(df, batch_size=256, epoch=1)
    b = batches.assign_batches(df, batch_size=256, epoch=2)
    sizes = lambda x: sorted((r["n_obs"], r["batch"], r["count"]) for r in x.groupBy("n_obs", "batch").count().collect())
    assert sizes(a) == sizes(b)
    moved = a.join(b.withColumnRenamed("batch", "b2"), ["id", "n_obs"]).filter("batch != b2").count()
    assert moved > 0
