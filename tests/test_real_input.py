"""Values as real files and real scores have them."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from nextbuy import session
from nextbuy.constants import P_COLS, PRODUCT_LABELS, RAW_ATTR_COLS, Y_COLS
from nextbuy.functions import arrays, clean, scale
from nextbuy.operators import recommend, score, sequence, trainlog
from nextbuy.sources import csv_io


def test_only_finite_decimal_numbers_are_numbers(spark):
    texts = [" 1", "29.0", "1.0", "-3.5e2", ".5", "5.", "NaN", "Infinity", "-inf", "1d", "7f", "1e999", "", " ", "0x10", None, "1.375586000000000000e+06"]
    want = [1, 29, 1, -350, 0.5, 5, None, None, None, None, None, None, None, None, None, None, 1375586]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    got = rows.select("i", clean.try_number("c").alias("v"), clean.income("c").alias("inc")).orderBy("i").collect()
    assert [r.v for r in got] == want and [r.inc for r in got] == want
    assert rows.filter("i = 16").select(clean.try_number("c", "bigint")).first()[0] == 1375586
    assert spark.createDataFrame([(float("nan"),), (2.0,)], "c double").select(F.avg(clean.try_number("c"))).first()[0] == 2.0


def test_raw_file_by_header_name(spark, tmp_path):
    path = tmp_path / "raw.csv"
    names = [*reversed(PRODUCT_LABELS), "renta", *[c for c in RAW_ATTR_COLS if c != "renta"]]
    values = dict.fromkeys(names, "")
    values |= {c: "1.0" for c in PRODUCT_LABELS[:3]} | {PRODUCT_LABELS[4]: " 1", PRODUCT_LABELS[5]: "NA"}
    values |= {"ncodpers": "1.375586e+06", "indrel": " 1", "tipodom": "1.0", "cod_prov": "29.0", "age": " NA", "indresi": "S", "indext": "N"}
    path.write_text(",".join(names) + "\n" + ",".join(values[n] for n in names) + "\n")
    r = csv_io.read_raw(spark, str(path)).first()
    assert (r.ncodpers, r.indrel, r.tipodom, r.cod_prov, r.age, r.indresi, r.indext) == (1375586, 1, 1, 29, " NA", "S", "N")
    assert [r[c] for c in PRODUCT_LABELS[:6]] == [1, 1, 1, None, 1, None]
    (tmp_path / "short.csv").write_text("ncodpers,age\n1,2\n")
    with pytest.raises(ValueError, match="missing"):
        csv_io.read_raw(spark, str(tmp_path / "short.csv"))


def test_prediction_ids(spark, tmp_path):
    row = ",".join(["0.5"] * len(P_COLS))
    (tmp_path / "p.csv").write_text(f"1.375586000000000000e+06,{row}\n7,{row}\n")
    assert sorted(r.id for r in csv_io.read_predictions(spark, str(tmp_path / "p.csv")).collect()) == [7, 1375586]
    (tmp_path / "q.csv").write_text(f"nobody,{row}\n")
    with pytest.raises(PySparkException, match="without a customer id"):
        csv_io.read_predictions(spark, str(tmp_path / "q.csv")).collect()


def test_circular_month_from_its_definition(spark):
    for month in range(1, 25):
        target = month % 12 + 1
        rows = spark.range(1, 13).select("id", scale.circular_month("id", month).alias("v")).collect()
        for r in rows:
            away = min((r.id - target) % 12, (target - r.id) % 12)
            assert abs(r.v - (1.1 - away / 6)) < 1e-12


def test_scores_of_zero_and_nan(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "y array<double>, p array<double>")
    v = df.select(arrays.categorical_crossentropy("y", "p").alias("v")).first().v
    assert abs(v + math.log(1e-7)) < 1e-9
    scores = spark.createDataFrame([(1, [float("nan"), 0.3] + [0.0] * 22, [0] * 24)], "id long, p array<double>, owned array<int>")
    assert recommend.rank_products(scores).first().ranked == [1]
    counts = {r.k: (r.n_pos, r.n_new) for r in recommend.product_counts(scores).collect()}
    assert counts[1] == (0, 0) and counts[2] == (1, 1)


def test_padding_below_the_longest_history_is_an_error(spark):
    h = spark.createDataFrame([(1, [[1.0], [2.0], [3.0]])], "id long, x array<array<double>>")
    assert sequence.pad_histories(h, 4, 1).first().x == [[-1.0], [1.0], [2.0], [3.0]]
    with pytest.raises(PySparkException, match="more steps than seq_len"):
        sequence.pad_histories(h, 2, 1).collect()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Away:
        """A session on a cluster that names no checkpoint folder."""

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Away)


def test_target_histories_are_reduced_before_they_are_collected(spark):
    rows = [(c, t, t % 12 + 1, *([1] + [0] * 23)) for c in range(50) for t in range(1, 6 if c else 7)]
    df = spark.createDataFrame(rows, ["id", "t", "t_month", *Y_COLS])
    h = sequence.build_test(df, None, 5, 6, attr_cols=("t",))
    plan = h._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan.split("collect_list", 1)[1]
    r = h.collect()
    assert [x.id for x in r] == [0] and r[0].n_obs == 6 and r[0].attrs == [6.0]
    other = sequence.build_test(df.filter("t < 6"), df.filter("t = 6").select("id", "t", "t_month"), 5, 6, attr_cols=("t",)).collect()
    assert [(x.id, x.n_obs, x.y) for x in other] == [(0, 6, None)] and other[0].x == r[0].x


def test_frequency_is_the_share_of_months_before_the_last(spark):
    rows = [(1, 1, 1), (1, 2, 0), (1, 3, 1), (2, 1, 1)]
    df = spark.createDataFrame([(i, t, *([y] + [0] * 23)) for i, t, y in rows], ["id", "t", *Y_COLS])
    assert {r.id: r.p_1 for r in score.frequency_scores(df).collect()} == {1: 0.5}


def test_fit_leaves_a_training_log(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.dense([float(i % 2), float(i % 3)]), [int(i % 2)] + [int(i % 3 == k % 3) for k in range(23)]) for i in range(60)]
    model = score.ProductScorer(max_iter=5, reg_param=0.1).fit(spark.createDataFrame(rows, ["features", "y"]))
    log = model.training_log(spark)
    loss = [r.value for r in log.filter("metric = 'loss'").orderBy("epoch").collect()]
    assert len(loss) > 1 and loss == sorted(loss, reverse=True)
    assert trainlog.best_and_last(log).count() == 25
    kept = [r.epoch for r in trainlog.periodic_improvements(log).collect()]
    assert all(e % 5 in (2, 4) for e in kept)
