"""Id join, the unit-scaling Transformer and the decision-tree fit.

``UnitScaleTransformer`` turns ``(weight, age, high)`` rows into
``label, features = [age / 12, high / 100]``.  Its parameters are real
``pyspark.ml`` params: set them in the constructor, with setters, or through a
``ParamMap`` passed to ``transform``/``fit`` -- overrides take effect.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Unit divisors (months -> years, centimetres -> metres) and the
# default column names of the transformer.
AGE_DIVISOR = 12.0
HEIGHT_DIVISOR = 100.0
DEFAULT_INPUT_1 = "age"
DEFAULT_INPUT_2 = "high"
DEFAULT_OUTPUT_1 = "age_years"
DEFAULT_OUTPUT_2 = "high_meters"
DEFAULT_LABEL = "weight"


def join_on_id(a: DataFrame, b: DataFrame, columns=("age", "weight", "high")) -> DataFrame:
    """J4 + P12: inner equi-join on ``id``, then the three model columns."""
    return a.join(b, "id", "inner").select(*columns)


class UnitScaleTransformer(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``label = labelCol``, ``features = [inputCol1 / 12, inputCol2 / 100]``."""

    inputCol1 = Param(Params._dummy(), "inputCol1", "input column 1 (divided by 12)",
                      typeConverter=TypeConverters.toString)
    inputCol2 = Param(Params._dummy(), "inputCol2", "input column 2 (divided by 100)",
                      typeConverter=TypeConverters.toString)
    outputCol1 = Param(Params._dummy(), "outputCol1", "name of scaled column 1",
                       typeConverter=TypeConverters.toString)
    outputCol2 = Param(Params._dummy(), "outputCol2", "name of scaled column 2",
                       typeConverter=TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "column copied to label",
                     typeConverter=TypeConverters.toString)
    keepScaled = Param(Params._dummy(), "keepScaled",
                       "also keep the two scaled columns next to label and features",
                       typeConverter=TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCol1=DEFAULT_INPUT_1, inputCol2=DEFAULT_INPUT_2,
                 outputCol1=DEFAULT_OUTPUT_1, outputCol2=DEFAULT_OUTPUT_2,
                 labelCol=DEFAULT_LABEL, keepScaled=False):
        super().__init__()
        self._setDefault(inputCol1=DEFAULT_INPUT_1, inputCol2=DEFAULT_INPUT_2,
                         outputCol1=DEFAULT_OUTPUT_1, outputCol2=DEFAULT_OUTPUT_2,
                         labelCol=DEFAULT_LABEL, keepScaled=False)
        self._set(**self._input_kwargs)

    @keyword_only
    def setParams(self, *, inputCol1=None, inputCol2=None, outputCol1=None, outputCol2=None,
                  labelCol=None, keepScaled=None):
        kwargs = {k: v for k, v in self._input_kwargs.items() if v is not None}
        return self._set(**kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        in1, in2 = self.getOrDefault(self.inputCol1), self.getOrDefault(self.inputCol2)
        out1, out2 = self.getOrDefault(self.outputCol1), self.getOrDefault(self.outputCol2)
        label = self.getOrDefault(self.labelCol)
        lab = F.col(label).cast("double")
        scaled = dataset.select(
            F.when(lab.isNull(), F.raise_error(F.lit(f"null in label column {label}")))
            .otherwise(lab).alias("label"),
            (F.col(in1).cast("double") / F.lit(AGE_DIVISOR)).alias(out1),
            (F.col(in2).cast("double") / F.lit(HEIGHT_DIVISOR)).alias(out2),
        )
        out = VectorAssembler(inputCols=[out1, out2], outputCol="features",
                              handleInvalid="error").transform(scaled)
        keep = [out1, out2] if self.getOrDefault(self.keepScaled) else []
        return out.select("label", "features", *keep)


def tree_pipeline(max_bins: int = 1024, max_depth: int = 30, seed: int = 42,
                  scaler: UnitScaleTransformer | None = None) -> Pipeline:
    """M15 + M16: the transformer followed by a variance decision tree."""
    tree = DecisionTreeRegressor(maxBins=max_bins, maxDepth=max_depth, impurity="variance",
                                 seed=seed, featuresCol="features", labelCol="label")
    return Pipeline(stages=[scaler or UnitScaleTransformer(), tree])


def fit_tree_pipeline(df: DataFrame, max_bins: int = 1024, max_depth: int = 30,
                      seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """Fit on ``df`` and transform the same rows -> (model, predictions)."""
    model = tree_pipeline(max_bins, max_depth, seed).fit(df)
    return model, model.transform(df)
