"""A fitted forest as a table of nodes, scored by joins.

``forest_nodes`` reads the nodes out of the model's own files, so a forest can be
queried, kept beside other tables and applied where ``pyspark.ml`` models are not
at hand.  ``tree_predictions`` walks every row down every tree, one equi-join on
(tree, node) a level.  ``prefix_mse`` scores the first T trees of one forest for
many T in one pass over the rows: the trees of a forest are drawn independently,
so its first T are a forest of T trees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checked_broadcast, staging_path
from . import regression as R
from .forest_tasks import TaskForest


def forest_nodes(model: RandomForestRegressionModel | TaskForest, spark, path: str | None = None) -> DataFrame:
    """(tree, node, feature, threshold, left_node, right_node, value, rows, gain); leaves have null feature,
    threshold and children.  Rows with ``x[feature] <= threshold`` go left.  The model is saved below ``path``."""
    if isinstance(model, TaskForest):
        return model.nodes()
    path = path or staging_path(spark, "forest")
    model.write().overwrite().save(path)
    n = F.col("nodeData")
    inner = n["leftChild"] >= 0
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"),
        F.when(inner, n["split"]["featureIndex"]).alias("feature"),
        F.when(inner, n["split"]["leftCategoriesOrThreshold"][0]).alias("threshold"),
        F.when(inner, n["leftChild"]).alias("left_node"), F.when(inner, n["rightChild"]).alias("right_node"),
        n["prediction"].alias("value"), n["rawCount"].alias("rows"), F.when(inner, n["gain"]).alias("gain"))


def tree_predictions(rows: DataFrame, nodes: DataFrame, depth: int, features: str = "features") -> DataFrame:
    """``rows`` once for every tree, with ``tree`` and the tree's ``value``.

    ``depth`` is the most levels below the root.  The nodes are broadcast if their
    bytes, measured, are few; else each level is a shuffled join.  A row joins one node of each tree
    a level, so nothing multiplies beyond rows x trees, which is what is asked for.
    """
    trees = nodes.agg((F.max("tree") + 1).alias("n")).first()["n"] or 0
    x = vector_to_array(features) if isinstance(rows.schema[features].dataType, VectorUDT) else F.col(features)
    steps = checked_broadcast(nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "feature", "threshold",
                                           "left_node", "right_node", "value"), name="forest-nodes")
    at = rows.withColumn("_x", x).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))) if trees else F.lit(0)) \
        .withColumn("_node", F.lit(0))
    if not trees:
        return at.limit(0).withColumn("value", F.lit(0.0)).drop("_x", "_node")
    here = (F.col("tree") == F.col("_t")) & (F.col("_node") == F.col("_n"))
    for _ in range(depth):
        left = F.col("_x")[F.col("feature")] <= F.col("threshold")
        to = F.when(F.col("feature").isNull(), F.col("_node")).when(left, F.col("left_node")).otherwise(F.col("right_node"))
        at = at.join(steps, here).withColumn("_node", to).select(*rows.columns, "_x", "tree", "_node")
    return at.join(steps.select("_t", "_n", "value"), here).select(*rows.columns, "tree", "value")


def score_nodes(rows: DataFrame, nodes: DataFrame, depth: int, counts: Sequence[int] | None = None) -> DataFrame:
    """``rows`` with ``prediction``, the mean of all trees, or with ``prediction_T`` of the first T for each of ``counts``.

    The sums of a row are made where its trees were walked, before the shuffle.
    """
    trees = F.count("*")
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    walked = tree_predictions(numbered, nodes, depth)
    if counts is None:
        means = [(F.sum("value") / trees).alias("prediction")]
    else:
        means = [(F.sum(F.when(F.col("tree") < t, F.col("value"))) / F.lit(t)).alias(f"prediction_{t}") for t in counts]
    return walked.groupBy("_row").agg(*[F.first(c).alias(c) for c in rows.columns], *means).drop("_row")


def prefix_mse(rows: DataFrame, nodes: DataFrame, depth: int, counts: Sequence[int], label: str = "label") -> DataFrame:
    """(num_trees, mse) of the forest's first T trees, for every T of ``counts``."""
    scored = score_nodes(rows.select(label, "features"), nodes, depth, counts)
    errors = scored.agg(*[F.avg((F.col(label) - F.col(f"prediction_{t}")) ** 2).alias(f"mse_{t}") for t in counts])
    return errors.select(F.explode(F.array(*[F.struct(F.lit(t).alias("num_trees"), F.col(f"mse_{t}").alias("mse")) for t in counts])).alias("r")).select("r.*")


def prefix_grid(train: DataFrame, test: DataFrame, trees: Sequence[int], depths: Sequence[int], log, max_bins: int = 1024,
                seed: int = 42, stop_after: int | None = None, **options) -> DataFrame:
    """M9 with one forest a depth: the (trees, depth) grid into a run log (``sources.runlog.RunLog``).

    Depths that the log holds are not fitted again.  ``stop_after`` ends the run after so many
    fits.  Returns the log's table.
    """
    rows = R.for_fits(train, test, max_bins, options)

    def one(depth):
        model = R.fit_forest(rows, max(trees), depth, max_bins, seed, **options)
        if isinstance(model, TaskForest):  # its trees are scored while they grow
            return model.errors([(t, depth) for t in trees])
        return prefix_mse(test, forest_nodes(model, train.sparkSession), depth, trees).select(
            "num_trees", F.lit(depth).alias("max_depth"), "mse")

    log.run({f"depth-{d}": d for d in depths}, one, stop_after)
    return log.table()
