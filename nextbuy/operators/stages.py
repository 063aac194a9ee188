"""The fitted steps before the model as ML pipeline stages that can be saved.

``GapFiller`` learns the fills (modes and means), ``FeatureEncoder`` the categories, ``AttributeScaler``
the means and deviations; their models only project. A fitted ``PipelineModel`` of
them is saved and loaded with ``write()`` and ``load()`` as any other.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MEAN_FILL_COLS, MODE_FILL_COLS, ZSCORE_COLS
from . import features, impute, scale


class _Stage(Params, DefaultParamsReadable, DefaultParamsWritable):
    """A stage with parameters given by name; what is learnt is a parameter, too, and so is saved."""

    def _with(self, **values) -> _Stage:
        for name, v in values.items():
            if v is not None:
                self._set(**{name: v})
        return self


class GapFillerModel(Model, _Stage):
    values = Param(Params._dummy(), "values", "fill value by column", TypeConverters.identity)

    def __init__(self, values: dict | None = None):
        super().__init__()
        self._with(values=values)

    def _transform(self, df: DataFrame) -> DataFrame:
        return impute.fill(df, self.getOrDefault(self.values))


class GapFiller(Estimator, _Stage):
    """Fills gaps with the mode or the mean of the rows it is fitted on."""

    modeCols = Param(Params._dummy(), "modeCols", "columns filled with their mode", TypeConverters.toListString)
    meanCols = Param(Params._dummy(), "meanCols", "columns filled with their mean", TypeConverters.toListString)

    def __init__(self, modeCols=None, meanCols=None):
        super().__init__()
        self._setDefault(modeCols=list(MODE_FILL_COLS), meanCols=list(MEAN_FILL_COLS))
        self._with(modeCols=modeCols, meanCols=meanCols)

    def _fit(self, df: DataFrame) -> GapFillerModel:
        return GapFillerModel(impute.impute_stats(df, self.getOrDefault(self.modeCols), self.getOrDefault(self.meanCols)))


class FeatureEncoderModel(Model, _Stage):
    categories = Param(Params._dummy(), "categories", "categories by column", TypeConverters.identity)
    fixTypes = Param(Params._dummy(), "fixTypes", "compare the customer type as text", TypeConverters.toBoolean)

    def __init__(self, categories: dict | None = None, fixTypes: bool | None = None):
        super().__init__()
        self._setDefault(fixTypes=False)
        self._with(categories=categories, fixTypes=fixTypes)

    def _transform(self, df: DataFrame) -> DataFrame:
        return features.featurize(df, fix_types=self.getOrDefault(self.fixTypes), categories=self.getOrDefault(self.categories))


class FeatureEncoder(Estimator, _Stage):
    """Cleaned rows -> feature rows; ``observed`` categories are those of the rows it is fitted on."""

    observed = Param(Params._dummy(), "observed", "categories of the data instead of the fixed lists", TypeConverters.toBoolean)
    fixTypes = Param(Params._dummy(), "fixTypes", "compare the customer type as text", TypeConverters.toBoolean)

    def __init__(self, observed: bool | None = None, fixTypes: bool | None = None):
        super().__init__()
        self._setDefault(observed=False, fixTypes=False)
        self._with(observed=observed, fixTypes=fixTypes)

    def _fit(self, df: DataFrame) -> FeatureEncoderModel:
        cats = features.observed_categories(df) if self.getOrDefault(self.observed) else {k: list(v) for k, v in features.FIXED_CATEGORIES.items()}
        return FeatureEncoderModel(cats, self.getOrDefault(self.fixTypes))


class AttributeScalerModel(Model, _Stage):
    stats = Param(Params._dummy(), "stats", "mean and deviation by column", TypeConverters.identity)
    clamp = Param(Params._dummy(), "clamp", "negative seniority counts as 0", TypeConverters.toBoolean)

    def __init__(self, stats: dict | None = None, clamp: bool | None = None):
        super().__init__()
        self._setDefault(clamp=True)
        self._with(stats=stats, clamp=clamp)

    def _transform(self, df: DataFrame) -> DataFrame:
        stats = {c: tuple(v) for c, v in self.getOrDefault(self.stats).items()}
        return scale.apply_zscore(scale.clamp_negatives(df) if self.getOrDefault(self.clamp) else df, stats)


class AttributeScaler(Estimator, _Stage):
    """Standardises with the statistics of the rows up to ``maxMonth`` (all, if not positive) that it is fitted on."""

    inputCols = Param(Params._dummy(), "inputCols", "columns to standardise", TypeConverters.toListString)
    maxMonth = Param(Params._dummy(), "maxMonth", "last month of the statistics", TypeConverters.toInt)
    clamp = Param(Params._dummy(), "clamp", "negative seniority counts as 0, before the statistics too", TypeConverters.toBoolean)

    def __init__(self, inputCols=None, maxMonth: int | None = None, clamp: bool | None = None):
        super().__init__()
        self._setDefault(inputCols=list(ZSCORE_COLS), maxMonth=0, clamp=True)
        self._with(inputCols=inputCols, maxMonth=maxMonth, clamp=clamp)

    def _fit(self, df: DataFrame) -> AttributeScalerModel:
        month, clamp = self.getOrDefault(self.maxMonth), self.getOrDefault(self.clamp)
        rows = df.filter(F.col("t") <= month) if month > 0 else df
        rows = scale.clamp_negatives(rows) if clamp else rows
        return AttributeScalerModel({c: list(v) for c, v in scale.zscore_stats(rows, self.getOrDefault(self.inputCols)).items()}, clamp)
