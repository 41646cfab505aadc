"""Regression: full-batch gradient-descent linear model, random forests, grid
search, repeats, split, prediction, MSE and residuals.

The gradient-descent model needs one distributed pass: the sums ``X'X``,
``X'y`` and ``n`` (a d x d matrix, d = number of features); the iterations
then run on that small matrix.  Forests are ``pyspark.ml`` estimators.
"""

from __future__ import annotations

import math
import threading
import time
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fit_layout, in_parallel
from .forest_tasks import Packed, TaskForest, pack_for

# Fixed values of the original linear model: 300 iterations, step 5e-15, no intercept.
SGD_ITERATIONS = 300
SGD_STEP = 5e-15


def gram_statistics(df: DataFrame, feature_cols: Sequence[str],
                    label: str = "label") -> tuple[np.ndarray, np.ndarray, int]:
    """One pass: ``X'X``, ``X'y`` and the row count.

    Rows become vectors ``[1, x, y]`` whose Gram matrix is summed in the JVM
    (``RowMatrix``: a packed triangle per task, merged in a tree), so the buffer
    is d(d+1)/2 doubles per task whatever the row count.  The constant 1 makes
    the row count part of the same matrix.
    """
    d = len(feature_cols)
    rows = VectorAssembler(inputCols=["_one", *feature_cols, "_label"], outputCol="v", handleInvalid="error").transform(
        df.select(F.lit(1.0).alias("_one"), *[F.col(c).cast("double").alias(c) for c in feature_cols],
                  F.col(label).cast("double").alias("_label"))).select("v")
    if rows.isEmpty():
        return np.zeros((d, d)), np.zeros(d), 0
    vectors = MLUtils.convertVectorColumnsFromML(rows, "v")
    g = RowMatrix(vectors).computeGramianMatrix().toArray()
    return g[1:-1, 1:-1], g[1:-1, -1], int(round(g[0, 0]))


@dataclass
class LinearModel:
    """Linear model (weights over named columns); predictions are a column expression."""
    feature_cols: list[str]
    weights: list[float]
    intercept: float = 0.0
    iterations_run: int = 0

    def prediction(self) -> Column:
        expr = F.lit(float(self.intercept))
        for c, w in zip(self.feature_cols, self.weights):
            expr = expr + F.col(c).cast("double") * F.lit(float(w))
        return expr

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn(output, self.prediction())

    def weights_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(i, c, float(w)) for i, (c, w) in enumerate(zip(self.feature_cols, self.weights))],
            "position int, feature string, weight double")


def gradient_descent(xtx: np.ndarray, xty: np.ndarray, n: int, iterations: int = SGD_ITERATIONS,
                     step: float = SGD_STEP, convergence_tol: float = 0.0) -> tuple[np.ndarray, int]:
    """Full-batch least squares: ``w <- w - step/sqrt(t) * (X'X w - X'y) / n``, ``w0 = 0``.

    With ``convergence_tol > 0`` it stops once the weights move by less than
    ``tol * max(|w|, 1)`` between two iterations.
    """
    w = np.zeros(len(xty))
    if n == 0:
        return w, 0
    prev = None
    t_run = 0
    for t in range(1, iterations + 1):
        grad = (xtx @ w - xty) / n
        w = w - (step / math.sqrt(t)) * grad
        t_run = t
        if convergence_tol > 0 and prev is not None:
            if np.linalg.norm(prev - w) < convergence_tol * max(np.linalg.norm(w), 1.0):
                break
        prev = w.copy()
    return w, t_run


def fit_linear_sgd(df: DataFrame, feature_cols: Sequence[str], label: str = "label",
                   iterations: int = SGD_ITERATIONS, step: float = SGD_STEP,
                   convergence_tol: float = 0.0) -> LinearModel:
    """M7: linear regression by full-batch gradient descent, no intercept, unscaled."""
    xtx, xty, n = gram_statistics(df, feature_cols, label)
    w, t_run = gradient_descent(xtx, xty, n, iterations, step, convergence_tol)
    return LinearModel(list(feature_cols), [float(v) for v in w], 0.0, t_run)


def fit_linear(df: DataFrame, feature_cols: Sequence[str], label: str = "label", **params):
    """Least squares solved to convergence (``pyspark.ml``), for useful predictions."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    data = VectorAssembler(inputCols=list(feature_cols), outputCol="features").transform(df)
    return LinearRegression(featuresCol="features", labelCol=label, **params).fit(data)


# ---- evaluation -------------------------------------------------------------

def mse(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean squared error as a one-row frame ``rows, mse``."""
    err = F.col(label) - F.col(prediction)
    return pred.agg(F.count(F.lit(1)).alias("rows"), F.avg(err * err).alias("mse"))


def mse_value(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> float:
    """``mse`` as a Python float (one aggregate row)."""
    v = mse(pred, label, prediction).first()["mse"]
    return float(v) if v is not None else float("nan")


def residuals(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``residual = label - prediction`` next to both."""
    return pred.withColumn("residual", F.col(label) - F.col(prediction))


def predict(df: DataFrame, model) -> DataFrame:
    """``(label, prediction)`` pairs and whatever else the frame holds."""
    return model.transform(df)


# ---- split ------------------------------------------------------------------

SPLIT_BUCKETS = 1_000_000


def split_bucket(key_cols: Sequence[str], seed: int = 42) -> Column:
    """A stable bucket in ``[0, SPLIT_BUCKETS)`` from a hash of the row's columns."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in key_cols], F.lit(seed)), F.lit(SPLIT_BUCKETS))


def text_split_bucket(key_cols: Sequence[str | Column], seed: int = 42) -> Column:
    """The same from the md5 of the columns' text, which any engine can repeat."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in key_cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % SPLIT_BUCKETS


def split_by_bucket(df: DataFrame, train_fraction: float = 0.7,
                    bucket: str = "_bucket") -> tuple[DataFrame, DataFrame]:
    """Train/test by the stable bucket column, which is dropped from both sides."""
    cut = F.lit(int(round(train_fraction * SPLIT_BUCKETS)))
    return (df.filter(F.col(bucket) < cut).drop(bucket),
            df.filter(F.col(bucket) >= cut).drop(bucket))


def split_train_test(df: DataFrame, train_fraction: float = 0.7, seed: int = 42,
                     key_cols: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """70/30 split.

    With ``key_cols`` the side of a row is a hash of those columns and the
    seed, so it does not depend on partitioning or on re-execution order (a
    recomputed partition lands on the same side).  Without, ``randomSplit``.
    """
    if key_cols is None:
        train, test = df.randomSplit([train_fraction, 1.0 - train_fraction], seed)
        return train, test
    return split_by_bucket(df.withColumn("_bucket", split_bucket(key_cols, seed)), train_fraction)


# ---- forests ----------------------------------------------------------------

#: Node statistics of one fit, in MB.  A task holds them for the nodes it grows
#: at a time; 32 MB keep several concurrent fits of 150 trees of depth 19 with
#: 1024 bins inside a 1 GiB heap, at the price of more passes over the rows.
MAX_MEMORY_MB = 32


def fit_forest(train: DataFrame, num_trees: int, max_depth: int, max_bins: int = 1024,
               seed: int = 42, feature_subset: str = "auto",
               features: str = "features", label: str = "label", *,
               max_memory_mb: int = MAX_MEMORY_MB, cache_node_ids: bool = False,
               checkpoint_interval: int = 10, subsampling_rate: float = 1.0,
               bootstrap: bool = True) -> RandomForestRegressionModel | TaskForest:
    """M8: random-forest regressor, variance impurity, all features continuous.

    Rows that :func:`for_fits` has packed give a forest grown by tasks, others a ``pyspark.ml`` fit.
    """
    if isinstance(train, Packed):
        return TaskForest(train, num_trees, max_depth, seed, feature_subset, bootstrap, subsampling_rate, features, label)
    return RandomForestRegressor(
        featuresCol=features, labelCol=label, numTrees=num_trees, maxDepth=max_depth,
        maxBins=max_bins, impurity="variance", featureSubsetStrategy=feature_subset,
        maxMemoryInMB=max_memory_mb, cacheNodeIds=cache_node_ids, checkpointInterval=checkpoint_interval,
        subsamplingRate=subsampling_rate, bootstrap=bootstrap, seed=seed).fit(train)


def for_fits(train: DataFrame | Packed, test: DataFrame | None, max_bins: int, options: dict) -> DataFrame | Packed:
    """What :func:`fit_forest` is to take for fits of many deep trees: the rows packed for ``forest_tasks`` where they are
    many and fit a task, else ``train`` as it is.  The grids and repeats call it themselves; given here first, they share it."""
    if isinstance(train, Packed):
        return train
    named = {k: options[k] for k in ("feature_subset", "features", "label") if k in options}
    return pack_for(train, test, max_bins, **named) or train


def _score_forest(train, test, trees, depth, max_bins, seed, options):
    t0 = time.perf_counter()
    model = fit_forest(train, trees, depth, max_bins, seed, **options)
    if isinstance(model, TaskForest):  # its trees grow while they score
        score = model.errors().first()["mse"]
        return model, math.nan if score is None else score, time.perf_counter() - t0
    fit_seconds = time.perf_counter() - t0
    return model, mse_value(model.transform(test)), fit_seconds


def grid_forest(train: DataFrame, test: DataFrame, trees: Sequence[int], depths: Sequence[int],
                max_bins: int = 1024, seed: int = 42, parallelism: int = 1,
                keep_models: bool = False, checkpoint_inputs: bool = True, **options):
    """M9: every (trees, depth) on one fixed split -> ``num_trees, max_depth, mse, fit_seconds``.

    Train and test rows are laid out once (``fit_layout``) so every fit rescans
    a short, reliable lineage.  A model is dropped once scored unless
    ``keep_models``; ``options`` go to :func:`fit_forest`.  Forests of packed rows
    (:func:`for_fits`) with one seed hold each other: all points are scored as the
    largest grows, with the same trees as fits of their own, and share its seconds.
    """
    if checkpoint_inputs:
        train, test = fit_layout(train), fit_layout(test)
    grid = [(t, d) for t in trees for d in depths]
    rows = for_fits(train, test, max_bins, options)
    if isinstance(rows, Packed):
        res = _grid_together(rows, grid, max_bins, seed, options)
        metrics = test.sparkSession.createDataFrame(
            [(t, d, r[1], r[2]) for (t, d), r in zip(grid, res)],
            "num_trees int, max_depth int, mse double, fit_seconds double")
        return (metrics, [r[0] for r in res]) if keep_models else metrics

    def one(p):
        model, score, seconds = _score_forest(train, test, p[0], p[1], max_bins, seed, options)
        return (model if keep_models else None), score, seconds

    res = in_parallel(one, grid, parallelism)
    metrics = train.sparkSession.createDataFrame(
        [(t, d, r[1], r[2]) for (t, d), r in zip(grid, res)],
        "num_trees int, max_depth int, mse double, fit_seconds double")
    return (metrics, [r[0] for r in res]) if keep_models else metrics


def _grid_together(rows: Packed, grid, max_bins, seed, options):
    """(model, mse, seconds) of every point, from one growth of the largest forest for each number of features a node takes."""
    found = {}
    for alone in (True, False):  # by default a single tree takes all features
        points = [p for p in grid if (p[0] == 1) == alone]
        if points:
            t0 = time.perf_counter()
            model = fit_forest(rows, max(t for t, _ in points), max(d for _, d in points), max_bins, seed, **options)
            errors = {(r["num_trees"], r["max_depth"]): r["mse"] for r in model.errors(points).collect()}
            seconds = time.perf_counter() - t0
            found |= {p: (fit_forest(rows, *p, max_bins, seed, **options), math.nan if (e := errors.get(p)) is None else e, seconds) for p in points}
    return [found[p] for p in grid]


def repeat_forest(train: DataFrame, test: DataFrame, trees: Sequence[int], depths: Sequence[int],
                  max_bins: int = 1024, seeds: Sequence[int] | None = None, parallelism: int = 1,
                  checkpoint_inputs: bool = True, **options):
    """Repeated fits (one seed per repeat) -> metrics ``run, seed, num_trees, max_depth, mse``
    and the model of lowest test MSE (the first on ties); no other model is kept."""
    if checkpoint_inputs:
        train, test = fit_layout(train), fit_layout(test)
    rows = for_fits(train, test, max_bins, options)
    runs = [(t, d) for t in trees for d in depths]
    seeds = list(seeds) if seeds is not None else [100 + i for i in range(len(runs))]
    best, lock = [math.inf, len(runs), None], threading.Lock()

    def one(i: int):
        model, score, seconds = _score_forest(rows, test, runs[i][0], runs[i][1], max_bins, seeds[i], options)
        with lock:
            if (score, i) < (best[0], best[1]):
                best[:] = [score, i, model]
        return score, seconds

    res = in_parallel(one, range(len(runs)), parallelism)
    metrics = test.sparkSession.createDataFrame(
        [(i, seeds[i], *runs[i], *r) for i, r in enumerate(res)],
        "run int, seed long, num_trees int, max_depth int, mse double, fit_seconds double")
    return metrics, best[2]


def tune_forest(data: DataFrame, trees: Sequence[int], depths: Sequence[int],
                max_bins: int = 1024, train_ratio: float = 0.7, seed: int = 42,
                parallelism: int = 1):
    """M9 with ``TrainValidationSplit``: one random split for every grid point,
    validation MSE per point, the winner refit on all rows.

    Returns ``(metrics, best_model)``; metrics ``num_trees, max_depth, mse``.
    """
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
    rf = RandomForestRegressor(featuresCol="features", labelCol="label", maxBins=max_bins,
                               impurity="variance", featureSubsetStrategy="auto", seed=seed,
                               maxMemoryInMB=MAX_MEMORY_MB)
    grid = ParamGridBuilder().addGrid(rf.numTrees, list(trees)).addGrid(rf.maxDepth, list(depths)).build()
    tvs = TrainValidationSplit(estimator=rf, estimatorParamMaps=grid, trainRatio=train_ratio,
                               evaluator=RegressionEvaluator(metricName="mse"), seed=seed,
                               parallelism=parallelism)
    fitted = tvs.fit(fit_layout(data))
    rows = [(pm[rf.numTrees], pm[rf.maxDepth], float(m))
            for pm, m in zip(grid, fitted.validationMetrics)]
    metrics = data.sparkSession.createDataFrame(rows, "num_trees int, max_depth int, mse double")
    return metrics, fitted.bestModel


def describe(model) -> str:
    """Text dump of a tree ensemble."""
    return model.toDebugString
