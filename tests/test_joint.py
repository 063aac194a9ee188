"""The joint fit against 24 separate fits, and the validated training loop against its log."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from nextbuy.constants import VALIDATE_AT, VALIDATE_EVERY, Y_COLS
from nextbuy.operators import joint, metrics, score, sequence, trainlog, training
from nextbuy.operators.joint import JointScorer, minimise, sparse_rows

SEQ, WIDTH, ATTRS = 4, 5, 3


@pytest.fixture(scope="module")
def histories(spark):
    """Small histories (3 attributes, up to 4 steps of 5 channels, 24 products), a product that all have and one that none has."""
    rnd = random.Random(11)
    rows = []
    for i in range(300):
        n = rnd.randint(1, SEQ)
        attrs = [rnd.gauss(0, 1), rnd.choice([0.0, 1.0, None]), 2.5]
        x = [[rnd.random(), *[float(rnd.randint(0, 1)) for _ in range(WIDTH - 1)]] for _ in range(n)]
        last = [int(v) for v in x[-1][1:]]
        y = [int(rnd.random() < 0.1 + 0.7 * last[k % 4]) for k in range(22)] + [1, 0]
        rows.append((i, n + 1, attrs, x, y, [last[k % 4] for k in range(24)]))
    schema = "id long, n_obs int, attrs array<double>, x array<array<double>>, y array<int>, y_last array<int>"
    return spark.createDataFrame(rows, schema).repartition(5)


def dense(h):
    """Inputs as the padded vectors have them, by id."""
    rows = score.feature_vectors(sequence.pad_histories(h, SEQ, WIDTH)).collect()
    return {r.id: r.features.toArray() for r in rows}


def test_sparse_rows_are_the_padded_vectors(histories):
    want = dense(histories)
    for r in sparse_rows(histories, SEQ, WIDTH).collect():
        v = np.zeros(ATTRS + SEQ * WIDTH)
        v[r.idx] = r.val
        v[ATTRS:] -= 1
        assert 0.0 not in r.val and np.allclose(v, want[r.id], atol=1e-12)
    n = histories.select(F.size("x").alias("n")).first().n
    assert n <= SEQ
    with pytest.raises(PySparkException, match="more steps than seq_len"):
        sparse_rows(histories, 1, WIDTH).collect()


@pytest.mark.parametrize("direct_tasks", [64, 2])
def test_equal_to_separate_fits(histories, monkeypatch, direct_tasks):
    from pyspark.ml.classification import LogisticRegression

    monkeypatch.setattr(joint, "DIRECT_TASKS", direct_tasks)
    model = JointScorer(max_iter=300, reg_param=0.05, tol=1e-9).fit(histories, SEQ, WIDTH)
    vectors = score.feature_vectors(sequence.pad_histories(histories, SEQ, WIDTH)).cache()
    for k in (0, 3, 7, 21, 22, 23):
        d = vectors.select("features", F.get("y", k).cast("double").alias("label"))
        one = LogisticRegression(maxIter=500, regParam=0.05, tol=1e-12, family="binomial").fit(d)
        assert np.abs(one.coefficients.toArray() - model.coefficients[k]).max() < 1e-4
        if k < 22:
            assert abs(one.intercept - model.intercepts[k]) < 1e-4
        else:
            assert one.intercept == model.intercepts[k] == (np.inf if k == 22 else -np.inf)


def test_products_of_a_block(monkeypatch):
    """As matrices and entry by entry, rows without entries included."""
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(7, 12)) * (rnd.random((7, 12)) < 0.4)
    x[[0, 3, 6]] = 0
    row, idx = np.nonzero(x)
    w, b, r = rnd.normal(size=(12, 4)), rnd.normal(size=4), rnd.normal(size=(7, 4))
    for cells in (1 << 22, 0):
        monkeypatch.setattr(joint, "DENSE_CELLS", cells)
        block = joint._Block(idx, x[row, idx], np.bincount(row, minlength=7))
        assert np.allclose(block.margins(w, b), x @ w + b) and np.allclose(block.back(r, 12), r.T @ x)
        assert (block.dense is None) == (cells == 0)


def test_scores(histories, spark, tmp_path):
    model = JointScorer(max_iter=6).fit(histories, SEQ, WIDTH)
    want = dense(histories)
    got = {r.id: r for r in model.predict(histories).collect()}
    assert len(got) == 300
    for i, v in want.items():
        z = model.coefficients @ v + model.intercepts
        assert np.allclose(got[i].p, 1 / (1 + np.exp(-z)), atol=1e-12)
        assert got[i].p[22:] == [1.0, 0.0]
    margins = {r.id: r.vec for r in model.margins(histories).collect()}
    assert np.allclose([margins[i][:22] for i in want], [(model.coefficients @ v + model.intercepts)[:22] for v in want.values()])
    assert set(model.predict(histories).columns) == {"id", "n_obs", "y", "y_last", "p"}
    model.save(spark, str(tmp_path / "m"))
    again = JointScorer.load(spark, str(tmp_path / "m"))
    assert (again.coefficients == model.coefficients).all() and (again.intercepts == model.intercepts).all()
    assert (again.seq_len, again.width) == (SEQ, WIDTH)
    with pytest.raises(PySparkException, match="inputs"):
        again.predict(histories.withColumn("attrs", F.concat("attrs", F.array(F.lit(1.0))))).collect()


def test_log_and_warm_start(histories, spark):
    whole = JointScorer(max_iter=12).fit(histories, SEQ, WIDTH)
    log = whole.training_log(spark)
    loss = [r.value for r in log.filter("metric = 'loss'").orderBy("epoch").collect()]
    assert len(loss) == 13 and all(a >= b - 1e-12 for a, b in zip(loss, loss[1:], strict=False))
    assert trainlog.best_and_last(log).count() == 25
    first = JointScorer(max_iter=6).fit(histories, SEQ, WIDTH)
    rest = JointScorer(max_iter=0).fit(histories, SEQ, WIDTH, start=first)
    assert abs(rest.log[-1][2] - first.log[-1][2]) < 1e-9  # goes on where the other stopped
    assert np.allclose(rest.coefficients, first.coefficients)
    assert np.allclose(rest.intercepts[:22], first.intercepts[:22])


def test_no_rows_and_missing_labels(histories, spark):
    none = JointScorer().fit(histories.limit(0), SEQ, WIDTH)
    assert (none.coefficients == 0).all() and none.log == []
    bad = histories.withColumn("y", F.transform("y", lambda v: F.when(v == 0, v)))
    with pytest.raises(PySparkException, match="without labels"):
        JointScorer().fit(bad, SEQ, WIDTH)


def test_minimise_many_problems():
    rnd = np.random.default_rng(3)
    a = [q @ np.diag(10.0 ** rnd.uniform(-2, 2, 6)) @ q.T for q in (np.linalg.qr(rnd.normal(size=(6, 6)))[0] for _ in range(5))]
    b = rnd.normal(size=(5, 6))

    def evaluate(points, which):
        g = np.stack([a[i] @ p - b[i] for p, i in zip(points, which, strict=True)])
        v = np.array([p @ a[i] @ p / 2 - b[i] @ p for p, i in zip(points, which, strict=True)])
        return v, g

    *_, (x, value) = minimise(evaluate, np.zeros((5, 6)), np.array([True] * 4 + [False]), 400, 1e-10)
    for i in range(4):
        assert np.allclose(x[i], np.linalg.solve(a[i], b[i]), atol=1e-5)
    assert (x[4] == 0).all()


def test_validated_run(histories, spark, tmp_path):
    train, held = histories.filter("id % 3 <> 0"), histories.filter("id % 3 = 0")
    path = str(tmp_path / "w")
    run = training.train_with_validation(train, held, SEQ, WIDTH, epochs=10, path=path, reg_param=0.001)
    log = run.log(spark)
    epochs = [e for e in range(10) if e % VALIDATE_EVERY in VALIDATE_AT]
    own = {r.epoch: r.value for r in log.filter("metric = 'val_loss'").collect()}
    assert sorted(own) == epochs
    # every validated epoch's stored weights give the logged loss and MAP
    maps = {r.epoch: r.value for r in log.filter("metric = 'val_map7_new'").collect()}
    for e in epochs:
        scored = JointScorer.load(spark, f"{path}.ep_{e}").predict(held)
        assert abs(own[e] - scored.agg(F.avg(metrics.loss_columns()["bce"])).first()[0]) < 1e-9
        assert abs(maps[e] - metrics.map_at_k_new(scored).first()["map"]) < 1e-9
    best = min(epochs, key=lambda e: (own[e], e))
    assert (run.best_epoch, run.best_loss) == (best, own[best])
    kept = {r.epoch: r.is_best for r in trainlog.periodic_improvements(log, metric="val_loss").collect()}
    assert kept == {e: int(e == best) for e in epochs if all(own[e] < own[f] for f in epochs if f < e)}
    assert (JointScorer.load(spark, path).coefficients == JointScorer.load(spark, f"{path}.ep_{best}").coefficients).all()
    assert (run.scorer.coefficients == JointScorer.load(spark, path).coefficients).all()
    assert log.filter("metric = 'loss'").count() == 10


def test_validation_options(histories, spark, tmp_path):
    path = str(tmp_path / "v")
    run = training.train_with_validation(histories, None, SEQ, WIDTH, epochs=4, path=path)
    assert run.best_epoch is None and run.saved == [f"{path}.ep_2", path]
    empty = training.train_with_validation(histories, histories.limit(0), SEQ, WIDTH, epochs=4)
    assert empty.best_epoch is None and empty.saved == []
    # labels turned round: the better the fit, the worse the held-out loss
    wrong = histories.withColumn("y", F.transform("y", lambda v: 1 - v))
    run = training.train_with_validation(histories, wrong, SEQ, WIDTH, epochs=20, patience=2)
    assert run.best_epoch == 2 and len([r for r in run.rows if r[1] == training.VAL_LOSS]) == 3


def test_flow_has_all_products():
    assert len(Y_COLS) == JointScorer().n_products


def test_blocks_hold_only_the_inputs_they_use(histories, monkeypatch):
    """Blocks are the rows of the padded vectors, rows of one length together, without the inputs that none of them uses."""
    monkeypatch.setattr(joint, "GROUP_ROWS", 8)
    want = sorted((tuple(np.round(r.features.toArray() + np.repeat([0.0, 1.0], [ATTRS, SEQ * WIDTH]), 12)), tuple(r.y))
                  for r in score.feature_vectors(sequence.pad_histories(histories, SEQ, WIDTH)).select("features", "y").collect())
    got, narrow = [], 0
    for r in joint.pack_blocks(histories, SEQ, WIDTH).toArrow().to_batches():
        for block, y in joint._blocks(r, 24):
            assert len(y) <= 8
            narrow += len(block.cols) <= ATTRS + WIDTH
            x = np.zeros((len(y), ATTRS + SEQ * WIDTH))
            x[block.row, block.inputs] = block.val
            got += [(tuple(np.round(a, 12)), tuple(int(v) for v in b)) for a, b in zip(x, y, strict=True)]
    assert sorted(got) == want and narrow > 0


def test_rows_without_arrays_or_steps(spark):
    rows = [(1, None, [[0.5, 1.0]]), (2, [1.0, 0.0], None), (3, [1.0], [[0.5, None], None]), (4, [0.0, None, 2.0], [[None, -1.0]]), (5, [], [])]
    h = spark.createDataFrame(rows, "id int, attrs array<double>, x array<array<double>>").coalesce(1)
    got = {r.id: (r.idx, r.val) for r in sparse_rows(h, 2, 2).collect()}
    assert got == {1: ([], []), 2: ([], []), 3: ([], []), 4: ([2, 5], [2.0, 1.0]), 5: ([], [])}


def test_a_task_holds_a_part_of_its_blocks(spark, monkeypatch):
    """Many blocks in one file come in small row groups, packed, and are unpacked one at a time."""
    monkeypatch.setattr(joint, "GROUP_ROWS", 20)
    monkeypatch.setattr(joint, "GROUP_BLOCKS", 16, raising=False)
    bit = lambda k: (F.xxhash64("id", F.lit(k)) % 2).cast("double")
    h = spark.range(4000).select(F.array(*[F.lit(1.0)] * ATTRS).alias("attrs"), F.array(*[F.array(*[F.abs(bit(k))] * WIDTH) for k in range(SEQ)]).alias("x"),
                                 F.array_repeat(F.lit(1), 24).alias("y")).coalesce(1)
    blocks = joint.pack_blocks(h, SEQ, WIDTH)
    (file,) = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in blocks.inputFiles()]
    assert file.num_rows == 200 and max(file.row_group(i).num_rows for i in range(file.num_row_groups)) <= 16
    n, held, whole = 0, 0, 0
    for batch in blocks.select("size", "cols", "idx", "val", "y").toArrow().to_batches():
        assert sum(batch.column(c).nbytes for c in ("idx", "val")) < 4000 * SEQ * WIDTH * 10 / 4
        before = pa.total_allocated_bytes()
        for block, y in joint._blocks(batch, 24):
            n, whole, held = n + len(y), whole + block.val.nbytes, max(held, pa.total_allocated_bytes() - before)
    assert n == 4000 and held < whole / 20
