"""The node table of a forest, scored by joins, against the model itself."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

import adlens.operators.forest_table as FO
import adlens.operators.regression as R
from adlens.session import checked_broadcast, staging
from adlens.sources import text as TX
from adlens.sources.runlog import RunLog

TREES, DEPTH = 7, 6


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(600).selectExpr("cast(id % 37 AS double) AS a", "cast(id % 11 AS double) AS b", "cast(id % 5 AS double) AS c",
                                     "(id % 37) * 2.0 + (id % 5) * (id % 11) AS label")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).select("label", "features").repartition(2).cache()


@pytest.fixture(scope="module")
def forest(spark, data):
    model = R.fit_forest(data, TREES, DEPTH, 64, 3)
    return model, FO.forest_nodes(model, spark).cache()


def close(df, a, b):
    return df.where(F.abs(F.col(a) - F.col(b)) > 1e-9 * (1 + F.abs(F.col(b)))).count() == 0


def test_nodes(data, forest):
    model, nodes = forest
    assert nodes.count() == model.totalNumNodes
    assert nodes.select("tree").distinct().count() == TREES
    inner = nodes.where("feature IS NOT NULL")
    assert inner.where("left_node IS NULL OR right_node IS NULL OR threshold IS NULL OR gain < 0").count() == 0
    # every node but the roots is the child of exactly one node, which holds its rows
    kids = inner.select("tree", F.explode(F.array("left_node", "right_node")).alias("node"))
    assert kids.distinct().count() == kids.count() == nodes.where("node > 0").count()
    sums = (inner.alias("p").join(nodes.alias("l"), F.expr("p.tree = l.tree AND p.left_node = l.node"))
            .join(nodes.alias("r"), F.expr("p.tree = r.tree AND p.right_node = r.node")))
    assert sums.where("p.rows <> l.rows + r.rows").count() == 0


def test_scores_agree_with_the_model(data, forest):
    model, nodes = forest
    own = model.transform(data).withColumnRenamed("prediction", "own")
    both = FO.score_nodes(own, nodes, DEPTH)
    assert both.count() == data.count() and close(both, "prediction", "own")


def test_shuffled_joins_agree(data, forest, monkeypatch):
    model, nodes = forest
    monkeypatch.setattr(FO, "checked_broadcast", lambda df, **k: checked_broadcast(df, max_bytes=0, **k))
    both = FO.score_nodes(model.transform(data).withColumnRenamed("prediction", "own"), nodes, DEPTH)
    assert close(both, "prediction", "own")


def test_a_prefix_is_a_model_of_its_trees(data, forest):
    model, nodes = forest
    counts = [1, 3, TREES]
    got = {r["num_trees"]: r["mse"] for r in FO.prefix_mse(data, nodes, DEPTH, counts).collect()}
    for t in counts:
        scored = data.select("label", "features")
        for i, tree in enumerate(model.trees[:t]):
            scored = tree.setPredictionCol(f"p{i}").transform(scored)
        mean = sum((F.col(f"p{i}") for i in range(t)), F.lit(0.0)) / t
        assert got[t] == pytest.approx(scored.agg(F.avg((F.col("label") - mean) ** 2)).first()[0])
    assert got[TREES] == pytest.approx(R.mse_value(model.transform(data)))


def test_single_leaf_trees_and_no_rows(spark, data):
    flat = data.withColumn("label", F.lit(4.0))
    nodes = FO.forest_nodes(R.fit_forest(flat, 3, 5), spark)
    assert nodes.count() == 3 and nodes.where("feature IS NULL AND value = 4.0").count() == 3
    assert FO.score_nodes(flat, nodes, 5).where("prediction = 4.0").count() == flat.count()
    assert FO.score_nodes(flat.limit(0), nodes, 5).count() == 0


def test_prefix_grid_resumes(spark, data, tmp_table_dir, monkeypatch):
    fitted = []
    fit = R.fit_forest
    monkeypatch.setattr(R, "fit_forest", lambda *a, **k: fitted.append(a[2]) or fit(*a, **k))
    for stop in (1, None, None):
        log = RunLog(spark, tmp_table_dir, "num_trees int, max_depth int, mse double")
        out = FO.prefix_grid(data, data, [1, 2, 5], [2, 4, 6], log, 64, 3, stop_after=stop)
    assert fitted == [2, 4, 6]  # each depth once
    assert out.count() == 9 and out.select("num_trees", "max_depth").distinct().count() == 9


def test_bucketed_join_has_no_exchange(spark, tmp_table_dir):
    a = spark.range(500).selectExpr("id % 300 AS id", "id AS x")
    b = spark.range(400).selectExpr("id", "id * 2 AS y")
    for name, df in (("bucketed_a", a), ("bucketed_b", b)):
        TX.write_bucketed(df, name, ["id"], 4, path=f"{tmp_table_dir}/{name}")
    try:
        joined = TX.read_table(spark, "bucketed_a").hint("merge").join(TX.read_table(spark, "bucketed_b"), "id")
        counted = TX.read_table(spark, "bucketed_a").groupBy("id").count()
        for df in (joined, counted):
            df.collect()
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, a.join(b, "id").collect()))
        assert counted.count() == 300
    finally:
        for name in ("bucketed_a", "bucketed_b"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_shared_fits_do_not_outlive_staging(spark):
    """A query inside a staging block leaves nothing behind that a later one would read."""
    from adlens.plans import catalog
    from conftest import SF_SMALL
    with staging(spark):
        inside = catalog._forest_rows(spark, SF_SMALL)[1].count()
    assert catalog._forest_rows(spark, SF_SMALL)[1].count() == inside
