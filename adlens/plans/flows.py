"""End-to-end flows: keyword clustering, campaign training rows, regression,
and the tree-model flow.  Each is a composition of the operators.

Not everything is lazy: a flow runs jobs while it is built wherever later
steps need a written table (shared pairs, dictionaries whose bytes are
measured, fit inputs), model parameters or metrics.  Run flows inside
``session.staging`` to drop the written tables at the end."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from ..operators import clustering as C
from ..operators import features as FT
from ..operators import keywords as K
from ..operators import regression as R
from ..session import fit_layout, materialize


def campaign_training_rows(keyword_rows: DataFrame, history_rows: DataFrame,
                           centres: C.ClusterCentres, features: Sequence[str] = C.TWO_D,
                           k: int | None = None, lookup_case: str = "reference",
                           excluded_accounts: Iterable[str] = (),
                           pairs: DataFrame | None = None) -> DataFrame:
    """keyword rows + history -> ``client_id, account_id, label, impression, max_cpc, k0..``.

    ``pairs`` (``features.shared_pairs(keyword_rows)``) can be passed to build
    several feature sets from one scan of the keyword rows.
    """
    k = centres.k if k is None else k
    hist = FT.campaign_cluster_features(keyword_rows, centres, k, features, lookup_case,
                                        pairs=pairs)
    history = FT.campaign_history(history_rows, excluded_accounts)
    return FT.training_rows(FT.join_history(history, hist), FT.histogram_columns(k))


def campaign_avg_training_rows(keyword_rows: DataFrame, history_rows: DataFrame,
                               lookup_case: str = "reference",
                               excluded_accounts: Iterable[str] = (),
                               pairs: DataFrame | None = None) -> DataFrame:
    """Average-of-average variant: features ``impression, max_cpc, avg_of_avg``."""
    feats = FT.campaign_avg_of_avg(keyword_rows, lookup_case, pairs=pairs)
    history = FT.campaign_history(history_rows, excluded_accounts)
    return FT.training_rows(FT.join_history(history, feats), ["avg_of_avg"])


def keyword_clustering(keyword_rows: DataFrame, ks: Iterable[int] = C.K_SWEEP,
                       features: Sequence[str] = C.TWO_D, max_iter: int = 50, seed: int = 42,
                       parallelism: int = 1):
    """Keyword statistics -> K sweep -> (metrics, fits by K)."""
    stats = K.keyword_stats(keyword_rows)
    return C.sweep_k(stats, ks, features, max_iter=max_iter, seed=seed, parallelism=parallelism)


def forest_regression(rows: DataFrame, feature_cols: Sequence[str], trees: Sequence[int],
                      depths: Sequence[int], max_bins: int = 1024, seed: int = 42,
                      parallelism: int = 1):
    """Training rows -> hash split 70/30 -> forest grid -> (metrics, train, test rows)."""
    train, test = labeled_split(rows, feature_cols, seed)
    metrics = R.grid_forest(train, test, trees, depths, max_bins, seed, parallelism=parallelism,
                            checkpoint_inputs=False)
    return metrics, train, test


def labeled_split(rows: DataFrame, feature_cols: Sequence[str], seed: int = 42,
                  train_fraction: float = 0.7, bucket: Column | None = None):
    """Label/feature rows with a stable hash bucket, written and laid out once
    (``session.fit_layout``); train and test are filters over that table.
    ``bucket`` is ``R.split_bucket`` of all columns unless another is given."""
    with_bucket = rows.withColumn("_bucket", R.split_bucket(rows.columns, seed) if bucket is None else bucket)
    labeled = fit_layout(FT.to_labeled(with_bucket, feature_cols, keep=["_bucket"]))
    return R.split_by_bucket(labeled, train_fraction)


# Fixed values of the original workflows: the forest grids, the final
# repeated models and the K-means settings.
FOREST_GRID_21 = (tuple(range(20, 501, 50)), tuple(range(4, 31, 5)))   # 10 x 6 = 60 points
FOREST_GRID_36 = (tuple(range(20, 201, 70)), tuple(range(4, 21, 5)))   # 3 x 4 = 12 points
FINAL_FORESTS = ((150, 150, 150), (14, 19))                            # 3 repeats x 2 depths
KMEANS_RESTARTS = 7
KMEANS_ITERATIONS = 50


@dataclass
class RegressionResult:
    """Everything ``campaign_regression`` produces."""
    linear: R.LinearModel
    linear_training_mse: float
    grid: DataFrame                      # num_trees, max_depth, mse, fit_seconds
    final: DataFrame | None = None       # run, seed, num_trees, max_depth, mse, fit_seconds
    final_model: object = field(repr=False, default=None)   # the best final model
    residuals: DataFrame | None = None   # residual, label, prediction (best final model, test rows)


def campaign_regression(rows: DataFrame, feature_cols: Sequence[str],
                        grid: tuple[Sequence[int], Sequence[int]] = FOREST_GRID_36,
                        final: tuple[Sequence[int], Sequence[int]] | None = FINAL_FORESTS,
                        max_bins: int = 1024, seed: int = 42,
                        parallelism: int = 1) -> RegressionResult:
    """The regression workflow on training rows.

    Linear model by full-batch gradient descent (training MSE), one stable
    70/30 split, the forest grid on it, the final repeated forests, and the
    residuals of the best final model on the test rows.
    """
    fixed = materialize(rows)
    linear = R.fit_linear_sgd(fixed, feature_cols)
    linear_mse = R.mse_value(linear.transform(fixed))
    train, test = labeled_split(fixed, feature_cols, seed)
    grid_metrics = R.grid_forest(train, test, grid[0], grid[1], max_bins, seed,
                                 parallelism=parallelism, checkpoint_inputs=False)
    result = RegressionResult(linear, linear_mse, grid_metrics)
    if final is not None:
        result.final, result.final_model = R.repeat_forest(
            train, test, final[0], final[1], max_bins, parallelism=parallelism, checkpoint_inputs=False)
        result.residuals = R.residuals(result.final_model.transform(test)).select(
            "residual", "label", "prediction")
    return result


def keyword_restarts(keyword_rows: DataFrame, k: int = 21, n: int = KMEANS_RESTARTS,
                     features: Sequence[str] = C.ONE_D, parallelism: int = 1):
    """1-D workflow: keyword counts -> ``n`` K-means fits at one K -> (metrics, best fit)."""
    counts = K.keyword_counts(keyword_rows) if list(features) == ["n"] else K.keyword_stats(keyword_rows)
    metrics, fits = C.restart_kmeans(counts, k, n, features, max_iter=KMEANS_ITERATIONS,
                                     parallelism=parallelism)
    best_run = C.select_best(metrics, "dispersion").first()["run"]
    return metrics, fits[best_run]
