"""Forests grown by tasks: against pyspark.ml, against fits of their own, as nodes, and in the grids and repeats."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

import adlens.operators.forest_table as FO
import adlens.operators.forest_tasks as FK
import adlens.operators.regression as R
from adlens.functions import trees as TR
from adlens.sources.runlog import RunLog

ROWS, BINS = 900, 64


def labeled(df):
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df).select("label", "features", "id")


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(0, ROWS, 1, 3).selectExpr(
        "id", "cast(id * 7919 % 631 AS double) AS a", "cast(id % 11 AS double) AS b", "cast(id % 5 AS double) AS c", "1D AS d",
        "sqrt(id * 7919 % 631) + (id % 5) * (id % 11) + cast(pmod(hash(id), 1000) AS double) / 300 AS label")
    return labeled(df).cache()


@pytest.fixture(scope="module")
def split(data):
    return data.where("id % 10 < 7").drop("id"), data.where("id % 10 >= 7").drop("id")


@pytest.fixture()
def many(monkeypatch):
    """Rows count as many, and no fit of pyspark.ml is made."""
    def none(*args, **kwargs):
        raise AssertionError("a pyspark.ml fit over many rows")
    monkeypatch.setattr(FK, "SMALL_FIT_ROWS", 100)
    monkeypatch.setattr(R, "RandomForestRegressor", none)


@pytest.fixture(scope="module")
def packed(split):
    train, test = split
    cuts = FK.thresholds(train, BINS)
    return FK.Packed(FK.pack(train, cuts), cuts, train.count(), FK.pack(test, cuts))


def near(a, b, *keys):
    a, b = ({tuple(r[k] for k in keys): r["mse"] for r in df.collect()} for df in (a, b))
    return a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a)


@pytest.mark.parametrize("bins", [16, 1024])
def test_one_whole_tree_is_that_of_ml(data, bins):
    """Without draws both solvers give the same tree, with thresholds between all values and between some."""
    train = data.drop("id")
    own = R.fit_forest(train, 1, 6, bins, bootstrap=False, feature_subset="all").transform(data).withColumnRenamed("prediction", "own")
    cuts = FK.thresholds(train, bins)
    assert max(map(len, cuts)) == (15 if bins == 16 else 630) and len(cuts[3]) == 0
    forest = R.fit_forest(FK.Packed(FK.pack(train, cuts), cuts, ROWS), 1, 6, bins, bootstrap=False, feature_subset="all")
    both = forest.transform(own)
    assert both.columns == ["label", "features", "id", "own", "prediction"] and both.count() == ROWS
    assert both.where(F.abs(F.col("own") - F.col("prediction")) > 1e-9).count() == 0


def test_forests_err_like_those_of_ml(split, packed):
    train, test = split
    ml = [R.mse_value(R.fit_forest(train, 20, 8, BINS, s).transform(test)) for s in range(4)]
    own = [R.fit_forest(packed, 20, 8, BINS, s).errors().first()["mse"] for s in range(4)]
    assert len(set(own)) == 4 and np.mean(own) == pytest.approx(np.mean(ml), rel=0.2)


def test_sorted_keys_count_like_a_table(monkeypatch):
    rng = np.random.default_rng(5)
    columns, y = [rng.integers(0, 300, 5000).astype(np.uint16), rng.integers(0, 9, 5000).astype(np.uint8)], rng.normal(size=5000)
    table = list(TR.grow(columns, [300, 9], y, 8, 1, 3, 0))
    monkeypatch.setattr(TR, "CELLS_PER_ROW", 0)
    monkeypatch.setattr(TR, "LEAST_CELLS", 0)
    for a, b in zip(table, TR.grow(columns, [300, 9], y, 8, 1, 3, 0), strict=True):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value)
    assert sum(len(x.value) for x in table) > 100
    assert all(a.rows.sum() >= b.rows.sum() for a, b in zip(table, table[1:]))


def test_cuts_have_near_equal_counts():
    values = np.arange(1000.0)
    got = TR.cuts(values, np.ones(1000, int), 11)
    assert len(got) == 10 and np.abs(np.diff(np.concatenate(([0], got, [1000]))) - 1000 / 11).max() <= 1
    assert TR.cuts(np.array([3.0]), np.array([7]), 8).size == 0
    heavy = TR.cuts(values, np.where(values == 0, 10 ** 6, 1), 11)
    assert len(heavy) <= 10 and heavy[0] == 0.5


def test_the_grid_is_that_of_separate_fits(spark, split, packed, many):
    train, test = split
    trees, depths = [1, 3, 8], [2, 5]
    metrics, models = R.grid_forest(train, test, trees, depths, BINS, 9, keep_models=True, checkpoint_inputs=False)
    assert [(r["num_trees"], r["max_depth"]) for r in metrics.collect()] == [(t, d) for t in trees for d in depths]
    alone = [(t, d, R.mse_value(R.fit_forest(packed, t, d, BINS, 9).transform(test))) for t in trees for d in depths]
    assert near(metrics, spark.createDataFrame(alone, "num_trees int, max_depth int, mse double"), "num_trees", "max_depth")
    assert [(m.getNumTrees, m.getMaxDepth()) for m in models] == [(t, d) for t in trees for d in depths]


def test_nodes_scored_by_joins_agree(spark, split, packed):
    test = split[1]
    forest = R.fit_forest(packed, 5, 6, BINS, 4)
    nodes = FO.forest_nodes(forest, spark).cache()
    assert nodes.count() == forest.totalNumNodes and nodes.select("tree").distinct().count() == 5
    both = FO.score_nodes(forest.transform(test).withColumnRenamed("prediction", "own"), nodes, 6)
    assert both.count() == test.count() and both.where(F.abs(F.col("own") - F.col("prediction")) > 1e-9).count() == 0
    inner = nodes.where("feature IS NOT NULL").alias("p")
    kids = inner.join(nodes.alias("l"), F.expr("p.tree = l.tree AND p.left_node = l.node")).join(nodes.alias("r"), F.expr("p.tree = r.tree AND p.right_node = r.node"))
    assert kids.count() == inner.count() and kids.where("p.rows <> l.rows + r.rows OR p.gain <= 0").count() == 0


def test_many_rows_are_scored_in_runs(split, packed, monkeypatch):
    test = split[1]
    forest = R.fit_forest(packed, 3, 5, BINS, 2)
    whole = forest.transform(test)
    monkeypatch.setattr(FK, "MAX_PACKED_BYTES", 1000)
    parts = forest.transform(test)
    assert parts.count() == test.count() and R.mse_value(parts) == pytest.approx(R.mse_value(whole))


def test_rows_beyond_a_task_are_left_to_ml(split, many, monkeypatch):
    train, test = split
    assert isinstance(R.for_fits(train, test, BINS, {}), FK.Packed)
    monkeypatch.setattr(FK, "MAX_PACKED_BYTES", 1000)
    assert R.for_fits(train, test, BINS, {}) is train


def test_tasks_share_out_the_trees(packed):
    """More tasks than one, whatever Spark makes of a union of single partitions."""
    forest = R.fit_forest(packed, 6, 2, BINS, 1)
    assert forest.nodes().rdd.getNumPartitions() >= min(6, FK.TASKS_PER_CORE * forest.spark.sparkContext.defaultParallelism)


def test_a_row_without_label_is_an_error(data, packed):
    rows = data.withColumn("label", F.when(F.col("id") != 5, F.col("label")))
    with pytest.raises(Exception, match="Labels MUST NOT be Null or NaN"):
        FK.pack(rows, packed.cuts)


def test_no_test_rows_give_no_error(split, many):
    train, test = split
    rows = R.grid_forest(train, test.limit(0), [2], [3, 4], BINS, checkpoint_inputs=False).collect()
    assert len(rows) == 2 and all(np.isnan(r["mse"]) for r in rows)


def test_one_label_gives_single_leaves(data):
    flat = data.drop("id").withColumn("label", F.lit(4.0))
    cuts = FK.thresholds(flat, BINS)
    forest = R.fit_forest(FK.Packed(FK.pack(flat, cuts), cuts, ROWS, FK.pack(flat, cuts)), 3, 5, BINS)
    assert forest.totalNumNodes == 3 and forest.errors([(3, 5), (3, 0)]).where("mse = 0").count() == 2


def test_prefix_grid_resumes_and_is_the_grid(spark, split, many, tmp_table_dir):
    train, test = split
    for stop in (1, None):
        log = RunLog(spark, tmp_table_dir, "num_trees int, max_depth int, mse double")
        out = FO.prefix_grid(train, test, [2, 5], [3, 6], log, BINS, 9, stop_after=stop)
        assert out.count() == (2 if stop else 4)
    assert near(out, R.grid_forest(train, test, [2, 5], [3, 6], BINS, 9, checkpoint_inputs=False), "num_trees", "max_depth")


def test_repeats_keep_the_best(split, many):
    train, test = split
    metrics, best = R.repeat_forest(train, test, [4, 4], [3, 6], BINS, checkpoint_inputs=False, parallelism=2)
    rows = metrics.collect()
    assert len(rows) == 4 and len({r["mse"] for r in rows}) == 4 and [r["seed"] for r in rows] == [100, 101, 102, 103]
    scored = R.residuals(best.transform(test))
    assert scored.count() == test.count() and R.mse_value(scored) == pytest.approx(min(r["mse"] for r in rows))


def test_residuals_of_the_best_repeat(spark, many, monkeypatch):
    """The registered query, with fewer trees, over every test row."""
    from adlens.plans import catalog as CT
    from adlens.plans import flows
    from adlens.session import staging
    from conftest import SF_SMALL
    monkeypatch.setattr(flows, "FINAL_FORESTS", ((3, 3), (4,)))
    with staging(spark):
        rows = CT.forest_residuals(spark, SF_SMALL).collect()
        assert len(rows) == CT._forest_rows(spark, SF_SMALL)[1].count() > 0
        assert all(r["residual"] == r["label"] - r["prediction"] for r in rows) and len({r["prediction"] for r in rows}) > 10


def test_grid_log_of_grown_forests(spark, many, monkeypatch):
    """The registered query, with a smaller grid: every point once, in the order of the depths, all scored."""
    from adlens.plans import catalog as CT
    from adlens.plans import flows
    from adlens.session import staging
    from conftest import SF_SMALL
    monkeypatch.setattr(flows, "FOREST_GRID_36", ((2, 3), (2, 3, 4)))
    with staging(spark):
        rows = sorted(map(tuple, CT.grid_log(spark, SF_SMALL).collect()))
    assert rows == [(i, f"depth-{d}", d, t, 1, True) for i, d in enumerate((2, 3, 4)) for t in (2, 3)]
