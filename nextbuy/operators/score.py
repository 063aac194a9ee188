"""Scorers: two plain statistical scorers and 24 logistic regressions.

``popularity_scores`` and ``frequency_scores`` are simple baselines of our
own (they give results with an SQL oracle). ``ProductScorer`` is the model
the rest of the library expects: 24 independent binary ``pyspark.ml``
logistic regressions over [attributes | flattened padded history].
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import NUM_PRODUCTS, P_COLS, Y_COLS


def popularity_scores(history: DataFrame, train_month: int, ys=Y_COLS) -> list[float]:
    """Share of customer-months owning each product over months <= train_month."""
    row = history.filter(F.col("t") <= train_month).agg(*[F.avg(c).alias(c) for c in ys]).first()
    return [float(row[c]) if row[c] is not None else 0.0 for c in ys]


def with_constant_scores(df: DataFrame, scores: list[float], p_col: str = "p") -> DataFrame:
    return df.withColumn(p_col, F.array(*[F.lit(float(v)) for v in scores]))


def frequency_scores(history: DataFrame, ys=Y_COLS) -> DataFrame:
    """(id, p_1..p_24): how often the customer owned each product before their last month.

    Customers with a single month get no row. One aggregate (totals less the
    last month's row; (id, t) is unique), so no customer's rows meet in one sort.
    """
    last = F.max_by(F.struct(*[F.col(y).cast("double").alias(y) for y in ys]), F.col("t"))
    g = history.groupBy("id").agg(F.count("*").alias("n"), last.alias("last"), *[F.sum(F.col(y).cast("double")).alias(y) for y in ys])
    g = g.filter(F.col("n") > 1)
    return g.select("id", *[((F.col(y) - F.col(f"last.{y}")) / (F.col("n") - 1)).alias(p) for y, p in zip(ys, P_COLS)])


# --- 24 logistic regressions -------------------------------------------------------------------

def feature_vectors(h: DataFrame) -> DataFrame:
    """Replaces ``attrs`` and ``x`` by ``features`` = attrs ++ flattened x (an ML vector).

    Histories must be padded to one length first so that all vectors have
    the same size. A missing attribute (e.g. the population of a province
    outside the lookup) enters the vector as 0.0.
    """
    from pyspark.ml.functions import array_to_vector

    flat = F.transform(F.concat(F.col("attrs"), F.flatten("x")), lambda v: F.coalesce(v, F.lit(0.0)))
    return h.select(*[c for c in h.columns if c not in ("attrs", "x")], array_to_vector(flat).alias("features"))


class ProductScorer:
    """24 binary logistic regressions, one per product (fit in parallel driver threads)."""

    def __init__(self, max_iter: int = 20, reg_param: float = 0.01, parallelism: int = 2,
                 max_rows: int | None = None):
        """``parallelism`` fits run at a time; each holds its own cached copy of the training
        vectors, so memory grows with it. ``max_rows`` bounds the rows used to fit (about that many, chosen
        by a hash of the vector); by default all are used."""
        self.max_iter = max_iter
        self.reg_param = reg_param
        self.parallelism = parallelism
        self.max_rows = max_rows
        self.models = []
        self.log: list[tuple[int, str, float]] = []

    def fit(self, train_vectors: DataFrame) -> "ProductScorer":
        """Fit the 24 models on the training vectors, written once as Parquet.

        Every fit reads the stored columns and caches its own standardised
        blocks while it runs (Spark ML's doing), ``parallelism`` of them at a time.
        ``log`` then holds (epoch, metric, value) rows: each product's objective per pass.
        """
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.functions import vector_to_array

        from ..sources.storage import store_rows

        data = store_rows(train_vectors.select("features", "y"), "vectors")
        if self.max_rows is not None and (n := data.count()) > self.max_rows:
            data = data.filter(F.pmod(F.xxhash64(vector_to_array("features")), F.lit(1_000_000)) < int(1e6 * self.max_rows / n))

        def fit_one(k: int):
            d = data.select("features", F.get("y", k).cast("double").alias("label"))
            lr = LogisticRegression(maxIter=self.max_iter, regParam=self.reg_param, family="binomial")
            return lr.fit(d)

        with ThreadPoolExecutor(max_workers=self.parallelism) as pool:
            self.models = list(pool.map(fit_one, range(NUM_PRODUCTS)))
        self.log = [(i, f"objective_{k + 1}", float(v)) for k, m in enumerate(self.models)
                    for i, v in enumerate(m.summary.objectiveHistory)]
        return self

    def training_log(self, spark) -> DataFrame:
        """(epoch, metric, value) of the fit, for ``trainlog``: each product's objective, and ``loss``, their mean.

        A product whose fit ended early keeps its last value. At most 25 rows per pass.
        """
        if not self.log:
            raise ValueError("fit first")
        passes = 1 + max(i for i, _, _ in self.log)
        of: dict[str, list[float]] = {}
        for _, metric, v in self.log:
            of.setdefault(metric, []).append(v)
        loss = [(i, "loss", sum(v[min(i, len(v) - 1)] for v in of.values()) / len(of)) for i in range(passes)]
        return spark.createDataFrame(self.log + loss, "epoch int, metric string, value double")

    def save(self, path: str) -> None:
        """One sub-folder per product model (Spark ML format)."""
        for k, m in enumerate(self.models):
            m.write().overwrite().save(f"{path.rstrip('/')}/product_{k + 1}")

    @classmethod
    def load(cls, path: str) -> "ProductScorer":
        from pyspark.ml.classification import LogisticRegressionModel

        scorer = cls()
        scorer.models = [LogisticRegressionModel.load(f"{path.rstrip('/')}/product_{k + 1}")
                         for k in range(NUM_PRODUCTS)]
        return scorer

    def seq_len(self, n_attrs: int, width: int) -> int:
        """The steps that the models' inputs were padded to."""
        return (self.models[0].numFeatures - n_attrs) // width

    def margins(self, vectors: DataFrame, vec_col: str = "vec") -> DataFrame:
        """Adds ``vec``: the 24 raw margins (the model's last-layer activations; other columns kept)."""
        from pyspark.ml.functions import vector_to_array

        keep = [c for c in vectors.columns if c != "features"]
        out = vectors
        for k, m in enumerate(self.models):
            m.setFeaturesCol("features").setRawPredictionCol(f"_raw{k}").setProbabilityCol(f"_prob{k}") \
             .setPredictionCol(f"_pred{k}")
            out = m.transform(out).withColumn(f"_m{k}", vector_to_array(f"_raw{k}")[1]) \
                   .drop(f"_prob{k}", f"_pred{k}", f"_raw{k}")
        return out.select(*keep, F.array(*[F.col(f"_m{k}") for k in range(NUM_PRODUCTS)]).alias(vec_col))

    def predict(self, vectors: DataFrame, p_col: str = "p") -> DataFrame:
        """Adds ``p``: the positive-class probability of each product model (other columns kept)."""
        from pyspark.ml.functions import vector_to_array

        keep = [c for c in vectors.columns if c != "features"]
        scored = vectors
        for k, m in enumerate(self.models):
            m.setFeaturesCol("features").setProbabilityCol(f"_prob{k}").setPredictionCol(f"_pred{k}") \
             .setRawPredictionCol(f"_raw{k}")
            scored = m.transform(scored).withColumn(f"_s{k}", vector_to_array(f"_prob{k}")[1]) \
                      .drop(f"_prob{k}", f"_pred{k}", f"_raw{k}")
        return scored.select(*keep, F.array(*[F.col(f"_s{k}") for k in range(NUM_PRODUCTS)]).alias(p_col))
