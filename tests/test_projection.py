"""The 2-D projection against numpy."""

import numpy as np

from nextbuy.operators import activations


def test_projection_and_explained_variance(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(200, 6)) * np.array([5, 3, 1, 1, 0.5, 0.1]) @ np.linalg.qr(rnd.normal(size=(6, 6)))[0]
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, vec array<double>, label int")
    values, vectors = np.linalg.eigh(np.cov(x.T))
    order = np.argsort(-values)
    got = {r.id: (r.pc1, r.pc2) for r in activations.pca_2d(df).collect()}
    for d in (df, df.repartition(7)):
        assert activations.pca_2d(d).columns == ["id", "label", "pc1", "pc2"]
        for j in range(2):
            w = vectors[:, order[j]]
            w = w * np.sign(w[np.abs(w).argmax()])
            assert np.allclose([got[i][j] for i in range(200)], x @ w, atol=1e-8)
    explained = {r.component: r.explained for r in activations.pca_explained(df).collect()}
    assert np.allclose([explained[1], explained[2]], values[order[:2]] / values.sum())
