"""Inspection of activation vectors: stratified samples, top-N per unit, 2-D projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import NUM_PRODUCTS, SAMPLE_FRACTION, TOP_N_PER_DIM
from .ranking import first_in_groups


def stratified_sample(df: DataFrame, strata_cols, fraction: float = SAMPLE_FRACTION, id_col: str = "id",
                      seed: int | None = None, within=()) -> DataFrame:
    """Deterministic stratified sample: ceil(n * fraction) of all n rows (of each ``within``, strata columns of their own),
    shared out among the strata in proportion, largest remainders first. A stratum's rows are
    taken in md5(id) order, or md5("id:seed") with a seed (an exact, skew-safe top-k per stratum)."""
    strata_cols = [strata_cols] if isinstance(strata_cols, str) else list(strata_cols)
    return first_in_groups(df, strata_cols, float(fraction), id_col, seed=seed, within=tuple(within)).drop("_n", "_k", "_rank")


def label_counts(targets: DataFrame, fraction: float = SAMPLE_FRACTION, y_col: str = "y",
                 n_products: int = NUM_PRODUCTS) -> DataFrame:
    """Per product: positives in a sample stratified by that product's label, and in all rows."""
    long = targets.select("id", F.posexplode(y_col).alias("pos", "label")).select(
        "id", (F.col("pos") + 1).alias("k"), "label")
    sample = stratified_sample(long, ["k", "label"], fraction, within=["k"])
    s = sample.groupBy("k").agg(F.count("*").alias("n_sample"), F.count_if(F.col("label") == 1).alias("n_pos_sample"))
    # totals: one wide aggregate, not 24 rows per customer
    wide = targets.agg(*[F.count_if(F.get(y_col, i) == 1).alias(f"n_{i}") for i in range(n_products)])
    t = wide.select(F.inline(F.array(*[F.struct(F.lit(i + 1).alias("k"), F.col(f"n_{i}").alias("n_pos_total")) for i in range(n_products)])))
    return t.join(s, "k", "left").select("k", F.coalesce("n_sample", F.lit(0)).alias("n_sample"),
                                         F.coalesce("n_pos_sample", F.lit(0)).alias("n_pos_sample"), "n_pos_total")


def top_n_per_dim(df: DataFrame, vec_col: str = "vec", n: int = TOP_N_PER_DIM, id_col: str = "id") -> DataFrame:
    """(dim, pos, id, value): the n largest values of every vector position, listed ascending.

    ``row_number() <= n`` lets Spark cut each input partition to n rows per
    unit before the exchange, so a unit never gathers all rows in one task.
    """
    z = df.select(id_col, F.posexplode(vec_col).alias("d", "value"))
    w = Window.partitionBy("d").orderBy(F.col("value").desc(), F.col(id_col).asc())
    top = z.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    kept = Window.partitionBy("d")
    return top.select((F.col("d") + 1).alias("dim"),
                      (F.count("*").over(kept) - F.col("_rn") + 1).alias("pos"),
                      id_col, F.col("value").cast("double").alias("value"))


def _fitted_pca(sample: DataFrame, vec_col: str, k: int):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    v = sample.withColumn("_v", array_to_vector(F.col(vec_col).cast("array<double>")))
    return v, PCA(k=k, inputCol="_v", outputCol="_pc").fit(v)


def pca_2d(sample: DataFrame, vec_col: str = "vec", k: int = 2) -> DataFrame:
    """Project vectors on their first two principal components (distributed covariance).

    A component's largest loading (the first of equally large ones) is positive, so its sign does not depend on the solver.
    """
    from pyspark.ml.functions import vector_to_array

    v, model = _fitted_pca(sample, vec_col, k)
    loadings = model.pc.toArray().T  # k rows, as many columns as a vector has entries
    signs = [-1.0 if max(row, key=abs) < 0 else 1.0 for row in loadings.tolist()]
    out = model.transform(v).withColumn("_pc", vector_to_array("_pc"))
    keep = [c for c in sample.columns if c != vec_col]
    return out.select(*keep, *[(F.get("_pc", i) * F.lit(signs[i])).alias(f"pc{i + 1}") for i in range(k)])


def pca_explained(sample: DataFrame, vec_col: str = "vec", k: int = 2) -> DataFrame:
    """(component, explained): the share of the vectors' variance along each component."""
    _, model = _fitted_pca(sample, vec_col, k)
    shares = [(i + 1, float(x)) for i, x in enumerate(model.explainedVariance.toArray())]
    return sample.sparkSession.createDataFrame(shares, "component int, explained double")
