"""A month scored from the saved artifact alone against scoring with the training table."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from nextbuy.constants import ATTR_COLS, Y_COLS
from nextbuy.operators import features, impute, scale, sequence
from nextbuy.operators.artifact import fit_artifact, load_artifact
from nextbuy.operators.joint import JointScorer
from nextbuy.operators.stages import AttributeScaler, FeatureEncoder, GapFiller, GapFillerModel
from nextbuy.plans import standin as S
from nextbuy.sources.storage import store_rows

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def cleaned(spark):
    return store_rows(S.snapshots_clean(spark, SF_SMALL), "cleaned")


def close(got, want):
    g, w = ({r.id: r for r in d.select("id", "n_obs", "y", "y_last", "p").collect()} for d in (got, want))
    assert set(g) == set(w) and len(w) > 3
    for i in w:
        assert (g[i].n_obs, g[i].y, g[i].y_last) == (w[i].n_obs, w[i].y, w[i].y_last)
        assert all(abs(a - b) < 1e-9 for a, b in zip(g[i].p, w[i].p, strict=True))


def by_hand(cleaned, scorer, train_month, month, last=None):
    """Scores of ``month`` with the training table at hand."""
    train = cleaned.filter(F.col("t") <= train_month)
    fills = impute.impute_stats(train)
    feats = features.featurize(impute.fill(cleaned.filter(F.col("t") <= (last or month)), fills))
    target = feats.filter(F.col("t") == month).drop(*Y_COLS)
    h = sequence.build_test(feats.filter(F.col("t") < month), target, train_month, month, ATTR_COLS, scale_time_dim=True)
    return scorer.predict(h)


def test_scored_from_the_artifact_alone(spark, cleaned, tmp_path):
    path = str(tmp_path / "model")
    fitted = fit_artifact(cleaned, 76, path, buckets=4, scorer=JointScorer(max_iter=4), seq_len=80)
    new = cleaned.filter("t = 77").drop(*Y_COLS)
    table = fitted.store.table
    spark.sql(f"DROP TABLE {table}")  # as in a new session: only the files are left
    loaded = load_artifact(spark, path)
    close(loaded.score(new), by_hand(cleaned, fitted.scorer, 76, 77))
    assert loaded.store.rows(spark).groupBy("id").count()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    # the month's products come: the next month sees them, statistics and weights stay
    grown = loaded.append(cleaned.filter("t = 77"))
    assert grown.version == 1
    close(load_artifact(spark, path).score(cleaned.filter("t = 78").drop(*Y_COLS)), by_hand(cleaned, fitted.scorer, 76, 78))
    close(load_artifact(spark, path, version=0).score(new), by_hand(cleaned, fitted.scorer, 76, 77))
    with_y = grown.score(cleaned.filter("t = 78"))
    assert with_y.filter("y is null").count() == 0
    assert grown.score(cleaned.filter("t = 500")).count() == 0
    with pytest.raises(ValueError, match="after 77"):
        grown.score(new)
    with pytest.raises(ValueError, match="no version"):
        load_artifact(spark, path, version=9)


def test_stages_keep_what_they_learnt(spark, cleaned, tmp_path):
    from pyspark.ml import Pipeline

    train, later = cleaned.filter("t <= 70"), cleaned.filter("t > 70")
    model = Pipeline(stages=[GapFiller(), FeatureEncoder(observed=True), AttributeScaler(maxMonth=60)]).fit(train)
    model.write().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    filled = impute.impute(train)
    feats = features.featurize(filled, categories="observed")
    stats = scale.zscore_stats(scale.clamp_negatives(feats.filter("t <= 60")))
    hand = features.featurize(impute.fill(later, impute.impute_stats(train)), categories=features.observed_categories(filled))
    hand = scale.apply_zscore(scale.clamp_negatives(hand), stats)
    for m in (model, again):
        got = m.transform(later)
        assert got.columns == hand.columns and got.exceptAll(hand).isEmpty() and hand.exceptAll(got).isEmpty()
    assert isinstance(again.stages[0], GapFillerModel) and isinstance(again.stages[0].getOrDefault("values"), dict)
    assert GapFiller(modeCols=["employee"], meanCols=[]).fit(train).getOrDefault("values") == impute.impute_stats(train, ["employee"], [])
