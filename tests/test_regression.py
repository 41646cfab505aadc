import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlens.operators import features as FT
from adlens.operators import regression as R

ROWS = [(3.0, 1.0, 2.0), (5.0, 2.0, 0.5), (7.0, 3.0, 1.0), (4.0, 0.5, 4.0), (10.0, 6.0, 2.5)]


def frame(spark):
    return spark.createDataFrame(ROWS, "label double, x0 double, x1 double")


def reference_formula(rows, iterations, step):
    x = np.array([[r[1], r[2]] for r in rows])
    y = np.array([r[0] for r in rows])
    w = np.zeros(2)
    for t in range(1, iterations + 1):
        g = np.zeros(2)
        for xi, yi in zip(x, y):
            g += (xi @ w - yi) * xi
        w = w - step / math.sqrt(t) * g / len(rows)
    return w


def test_sgd_equals_formula(spark):
    m = R.fit_linear_sgd(frame(spark), ["x0", "x1"], iterations=300, step=5e-15)
    want = reference_formula(ROWS, 300, 5e-15)
    assert m.iterations_run == 300
    for a, b in zip(m.weights, want):
        assert a == pytest.approx(b, rel=1e-12)


def test_sgd_larger_step_converges_towards_least_squares(spark):
    m = R.fit_linear_sgd(frame(spark), ["x0", "x1"], iterations=300, step=0.05)
    want = reference_formula(ROWS, 300, 0.05)
    for a, b in zip(m.weights, want):
        assert a == pytest.approx(b, rel=1e-9)


def test_sgd_matches_mllib(spark):
    try:
        from pyspark.mllib.linalg import Vectors
        from pyspark.mllib.regression import LabeledPoint, LinearRegressionWithSGD
    except ImportError:
        pytest.skip("mllib not available")
    pts = spark.sparkContext.parallelize([LabeledPoint(r[0], Vectors.dense([r[1], r[2]])) for r in ROWS], 2)
    import warnings
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        ref = LinearRegressionWithSGD.train(pts, iterations=300, step=5e-15, miniBatchFraction=1.0,
                                            convergenceTol=0.0)
    m = R.fit_linear_sgd(frame(spark), ["x0", "x1"])
    for a, b in zip(m.weights, ref.weights.toArray()):
        assert a == pytest.approx(b, rel=1e-9)


def test_convergence_tolerance_stops_early(spark):
    m = R.fit_linear_sgd(frame(spark), ["x0", "x1"], convergence_tol=0.001)
    assert m.iterations_run == 2


def test_mse_and_residuals(spark):
    m = R.LinearModel(["x0"], [2.0])
    pred = R.residuals(m.transform(frame(spark)))
    rows = pred.collect()
    assert all(r.residual == r.label - 2.0 * r.x0 for r in rows)
    want = sum((r[0] - 2.0 * r[1]) ** 2 for r in ROWS) / len(ROWS)
    assert R.mse(pred).first().mse == pytest.approx(want)


def test_hash_split_is_deterministic_and_complete(spark):
    df = spark.range(2000).withColumn("v", F.col("id") * 3)
    a1, b1 = R.split_train_test(df, 0.7, 5, key_cols=["id"])
    a2, _ = R.split_train_test(df.repartition(7), 0.7, 5, key_cols=["id"])
    s1 = {r.id for r in a1.collect()}
    assert s1 == {r.id for r in a2.collect()}
    assert len(s1) + b1.count() == 2000
    assert 0.65 < len(s1) / 2000 < 0.75


def test_forest_grid_and_repeats(spark):
    df = spark.range(300).select(
        (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    df = df.withColumn("label", F.col("a") * 2 + F.col("b"))
    data = FT.to_labeled(df, ["a", "b"])
    train, test = data.randomSplit([0.7, 0.3], 1)
    metrics = R.grid_forest(train, test, [3, 5], [2, 4], max_bins=32)
    rows = metrics.collect()
    assert len(rows) == 4 and all(r.mse >= 0 for r in rows)
    assert min(rows, key=lambda r: r.mse).max_depth == 4
    m2, best = R.repeat_forest(train, test, [3], [2, 4], max_bins=32, seeds=[1, 2])
    assert m2.count() == 2
    assert R.mse_value(best.transform(test)) == pytest.approx(min(r.mse for r in m2.collect()))
    assert "Tree" in R.describe(best)


def test_fit_linear_solves_least_squares(spark):
    m = R.fit_linear(frame(spark), ["x0", "x1"], fitIntercept=False, regParam=0.0)
    x = np.array([[r[1], r[2]] for r in ROWS])
    y = np.array([r[0] for r in ROWS])
    want, *_ = np.linalg.lstsq(x, y, rcond=None)
    assert np.allclose(m.coefficients.toArray(), want, rtol=1e-6)


def test_campaign_regression_flow(spark):
    from adlens.operators import clustering as C
    from adlens.plans import flows
    from adlens.sources import tables as TB
    from conftest import SF_SMALL
    rows = flows.campaign_training_rows(TB.keyword_rows(spark, SF_SMALL), TB.history_rows(spark, SF_SMALL),
                                        C.fixed_centres_2d(36), C.TWO_D, 36,
                                        excluded_accounts=TB.EXCLUDED_ACCOUNTS)
    cols = FT.feature_columns(FT.histogram_columns(36))
    res = flows.campaign_regression(rows, cols, grid=([5], [3, 4]), final=([5, 5], [3]), max_bins=32)
    assert res.linear.iterations_run == 300 and res.linear_training_mse > 0
    assert res.grid.count() == 2 and res.final.count() == 2 and res.final_model.getNumTrees == 5
    assert res.residuals.count() > 0
    assert flows.FOREST_GRID_21[0][-1] == 470 and len(flows.FOREST_GRID_21[1]) == 6
    assert flows.FOREST_GRID_36 == ((20, 90, 160), (4, 9, 14, 19))


def test_keyword_restarts_flow(spark):
    from adlens.plans import flows
    from adlens.sources import tables as TB
    from conftest import SF_SMALL
    metrics, best = flows.keyword_restarts(TB.keyword_rows(spark, SF_SMALL), k=5, n=3)
    assert metrics.count() == 3 and best.k <= 5


def test_tune_forest_with_train_validation_split(spark):
    df = spark.range(400).select(
        (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    data = FT.to_labeled(df.withColumn("label", F.col("a") * 2 + F.col("b")), ["a", "b"])
    metrics, best = R.tune_forest(data, [3, 6], [2, 5], max_bins=32, parallelism=2)
    rows = metrics.collect()
    assert len(rows) == 4 and all(r.mse >= 0 for r in rows)
    assert best.getMaxDepth() == min(rows, key=lambda r: r.mse).max_depth


def test_training_features_are_all_continuous(spark):
    """Histogram counts are integers, but the forests must see every feature as continuous."""
    from adlens.operators import clustering as C
    from adlens.plans import catalog as CT
    from conftest import SF_SMALL
    rows = CT._training(spark, SF_SMALL, CT.centres_2d(), 36, C.TWO_D)
    lab = FT.to_labeled(rows, FT.feature_columns(FT.histogram_columns(36)))
    attrs = lab.schema["features"].metadata["ml_attr"]["attrs"]
    assert set(attrs) == {"numeric"} and len(attrs["numeric"]) == 38
