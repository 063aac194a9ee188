"""Clustering and whitening against plain Python and numpy."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nextbuy.llm.clustering import LIMIT, candidates, cluster_vectors, compared, first_centroids, hilbert_keys, moved, nearest, zone_blocks
from nextbuy.llm.eigen import refined_eigenvectors
from nextbuy.llm.vectors import ExactSums, floored
from nextbuy.llm.whitening import exact_gram, whiten

NAN, INF = float("nan"), float("inf")


def vector_rows(dims=64, n=90, seed=3):
    """Generated vectors around a few centres, with copies, ties and rows to leave out."""
    rnd = random.Random(seed)
    f = lambda x: float(np.float32(x))  # noqa: E731  as the column holds it
    centres = [[rnd.uniform(-0.5, 0.5) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [f(x + rnd.gauss(0, 0.05)) for x in rnd.choice(centres)]) for i in range(n)]
    rows += [(1000 + i, list(rows[4][1])) for i in range(40)]  # a vector that many rows share
    rows += [(7, list(rows[9][1])), (7, list(rows[9][1])), (None, list(rows[11][1])), (None, [0.0] * dims), (2000, [f(3.0e6)] * dims), (2001, [-1.0e30] * dims)]
    out = [(3000, None), (3001, []), (3002, [0.5] * (dims - 1)), (3003, [0.5] * (dims + 1)), (3004, [None] + [0.1] * (dims - 1)),
           (3005, [NAN] * dims), (3006, [0.1] * (dims - 1) + [INF]), (3007, [-INF] * dims)]
    return rows, out


def table(spark, rows):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    return d.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("v", "key", "salt", "cluster", "distance", "cell", "value", "size", "n", "ids", "low"))])


def whole(x, scale, limit):
    return int(np.floor(max(min(float(np.float32(x)) * scale, limit), -limit)))


def plain_clusters(rows, k, rounds, scale=256, tag="2"):
    v = [(i, tuple(whole(x, scale, LIMIT) for x in a)) for i, a in rows]
    order = sorted(v, key=lambda r: (hashlib.sha256(f"{tag}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [r[1] for r in order[:k]]
    def assign():
        out = []
        for _, a in v:
            d = [sum((x - y) ** 2 for x, y in zip(a, m, strict=True)) for m in c]
            out.append((d.index(min(d)), min(d)))
        return out
    for _ in range(rounds):
        own = assign()
        for j in range(len(c)):
            mine = [a for (_, a), (o, _) in zip(v, own, strict=True) if o == j]
            if mine:
                c[j] = tuple(sum(col) // len(mine) for col in zip(*mine, strict=True))
    own = assign()
    per = Counter()
    for o, d in own:
        per[o] += d
    fits = lambda x: x if x < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return Counter((i, o, d, fits(per[o]), fits(sum(per.values())), sha[o]) for (i, _), (o, d) in zip(v, own, strict=True))


@pytest.mark.parametrize("k,rounds,block", [(8, 3, 16), (40, 5, 128), (500, 1, 4)])
def test_clusters(spark, k, rounds, block):
    rows, out = vector_rows()
    got = cluster_vectors(table(spark, rows + out), k=k, rounds=rounds, block_rows=block, rows_per_task=20).collect()
    assert Counter(tuple(r) for r in got) == plain_clusters(rows, k, rounds)


def test_clusters_of_nothing(spark):
    _, out = vector_rows()
    for rows in ([], out):
        got = cluster_vectors(table(spark, rows))
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert got.count() == 0
    with pytest.raises(ValueError):
        cluster_vectors(table(spark, []), dims=65)


def test_hilbert_curve():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = [k.tobytes() for k in hilbert_keys(grid, bits)]
        assert len(set(keys)) == len(grid)
        walk = grid[np.argsort(np.array([int.from_bytes(k, "big") for k in keys]))]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()  # each step goes to a neighbour


def test_candidates_keep_every_nearest():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        v = rnd.integers(-9, 9, (12, 3))
        c = rnd.integers(-20, 20, (10, 3))
        own, d = nearest(v, v.min(0), v.max(0), c)
        all_d = ((v[:, None] - c[None]) ** 2).sum(2)
        assert (own == all_d.argmin(1)).all() and (d == all_d.min(1)).all()
        assert set(all_d.argmin(1)) <= set(candidates(v.min(0), v.max(0), c))
    big = np.array([[LIMIT, -LIMIT], [LIMIT - 1, 5]], np.int64)
    assert nearest(big, big.min(0), big.max(0), big)[1].tolist() == [0, 0]


def test_boxes_spare_comparisons(spark):
    rnd = np.random.default_rng(5)
    centres = rnd.integers(-2000, 2000, (20, 64)) / 256
    rows = [(i, (centres[i % 20] + rnd.normal(0, 0.02, 64)).tolist()) for i in range(4000)]
    v = floored(table(spark, rows), 256, LIMIT, "vec_id", "embedding")
    first = first_centroids(v, 20, "2")
    blocks = zone_blocks(v, first, 16, 1000)
    for _ in range(2):
        first = moved(blocks, first)
    got = compared(blocks, first).agg(F.sum(F.col("n_rows") * F.col("n_candidates")).alias("done"), F.sum("n_rows").alias("n")).first()
    assert got.n == 4000 and got.done < 0.4 * 4000 * 20


def test_exact_sums():
    s = ExactSums(2)
    for _ in range(9):
        s.add(np.array([1 << 61, -1], np.int64))
    s.add(np.array([1 << 90, 3], object))
    assert s.totals() == [9 * (1 << 61) + (1 << 90), -6]
    y = np.array([[3, -(1 << 40)], [-(1 << 39) + 7, 5]])
    want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(2)] for i in range(2)]
    assert exact_gram(y).tolist() == want


def test_eigenvectors_to_double_precision():
    rnd = np.random.default_rng(2)
    q, _ = np.linalg.qr(rnd.normal(size=(24, 24)))
    for values in (np.arange(24, 0, -1.0), np.repeat([5.0, 2.0, 1.0], 8), 1 + 1e-9 * np.arange(24), np.r_[np.ones(8) + 1e-7 * np.arange(8), np.zeros(16)],
                   np.r_[1e6, np.linspace(2, 1, 23)]):
        a = (q.astype(np.longdouble) * values) @ q.T.astype(np.longdouble)
        a = (a + a.T) / 2
        e, x = refined_eigenvectors(a)
        assert np.allclose(np.sort(values)[::-1], e, rtol=0, atol=1e-13 * values.max())
        assert np.abs(x.T @ x - np.eye(24)).max() < 1e-15 * 24
        assert np.abs(a @ x - x * e).max() < 1e-14 * values.max()
    # an eigenvector well apart: equal to the true one
    e, x = refined_eigenvectors((q * np.arange(24, 0, -1.0)) @ q.T)
    sign = np.sign((x * q).sum(0))
    assert np.abs(x * sign - q).max() < 1e-13
    assert refined_eigenvectors(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]
    assert refined_eigenvectors(np.array([[4.0]]))[0].tolist() == [4]


def check_white(got, rows, scale, n_components):
    x = np.array([[whole(c, scale, (1 << 40) - 1) + 1_000_000 for c in a] for _, a in rows], object)
    n, s = len(x), x.sum(0)
    z = n * x - s
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert Counter(r.vec_id for r in got) == Counter({i: c * n_components for i, c in Counter(i for i, _ in rows).items()})
    cov = (z.astype(float).T @ z.astype(float)) / n**3
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert all(r.n == n and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 for r in got)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    want = z.astype(float) / n @ vectors[:, :n_components] / np.sqrt(values[:n_components])
    gaps = np.abs(np.diff(values[:n_components + 1]))
    for (i, _), w, own in zip(rows, want, z, strict=True):
        for r in by[i]:
            k = r.component - 1
            if min(gaps[max(k - 1, 0)], gaps[k]) > 1e-6 * values[0]:
                assert any(abs(abs(q.whitened) - abs(w[k])) < 1e-7 for q in by[i] if q.component == r.component)
        assert int((own * own).sum()) in {q.deviation for q in by[i]}


def test_whitening(spark):
    rows, out = vector_rows(dims=12)
    rows = [r for r in rows if r[0] not in (2000, 2001)]
    for k in (5, 11):
        check_white(whiten(table(spark, rows + out), n_components=k).collect(), rows, 64, k)


def test_whitening_is_exact_for_any_split(spark):
    rows, out = vector_rows(dims=12)
    rows = [r for r in rows if r[0] not in (2000, 2001)]
    keyed = lambda d: sorted((str(r.vec_id), r.component, r.deviation or -1, round(r.whitened, 12)) for r in whiten(d, n_components=4).collect())
    a = table(spark, rows + out)
    assert keyed(a) == keyed(a.repartition(3)) == keyed(a.coalesce(1))


def test_whitening_without_spread(spark):
    one = whiten(table(spark, [(1, [0.5] * 4)])).collect()
    assert len(one) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error == 0 for r in one)
    flat = whiten(table(spark, [(i, [0.5, i * 0.25, 0.0]) for i in range(5)])).collect()
    assert Counter((r.component, r.whitened is None) for r in flat) == Counter({(1, False): 5, (2, True): 5, (3, True): 5})
    axes = [(10 * i + s, [0.0] * i + [float(2 * s - 1)] + [0.0] * (5 - i)) for i in range(6) for s in (0, 1)]  # all eigenvalues equal
    got = whiten(table(spark, axes)).collect()
    assert len(got) == 72 and got[0].identity_error < 1e-9 and all(abs(r.explained - 1 / 6) < 1e-9 for r in got)


def test_whitening_of_nothing(spark):
    _, out = vector_rows()
    for rows in ([], [(1, None)], [(1, [])], [(1, [NAN])]):
        assert whiten(table(spark, rows)).count() == 0
    huge = whiten(table(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 0.0])])).collect()
    assert len(huge) == 6 and huge[0].identity_error < 1e-4 and any(r.deviation is None for r in huge)
