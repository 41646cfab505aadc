"""K-means over keyword statistics: fit, sweep over K, restarts, dispersion,
assignment, default cluster, model persistence.

Fits are ``pyspark.ml`` K-means over a distributed DataFrame.  Only model
parameters (<= K centres) and one metric row per fit reach the driver.
Assignment to given centres is a literal column expression
(``functions.vectors.nearest_centre``), never a join.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.errors import AnalysisException
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import centre_coordinate, nearest_centre
from ..session import fit_layout, in_parallel

ONE_D = ("n",)
TWO_D = ("n", "avg_qi")


@dataclass
class ClusterCentres:
    """Centres of a cluster model (ids 0..K-1 unless given)."""

    centres: list[tuple[float, ...]]
    model: KMeansModel | None = field(default=None, repr=False)

    @property
    def k(self) -> int:
        return len(self.centres)

    @property
    def dims(self) -> int:
        return len(self.centres[0])

    def assign(self, features: Sequence[str | Column]) -> Column:
        return nearest_centre(features, self.centres)

    def coordinate(self, cluster_id: str | Column, dim: int) -> Column:
        return centre_coordinate(cluster_id, self.centres, dim)

    def default_cluster(self) -> Column:
        """M6 as a constant expression: the cluster of the zero vector."""
        return nearest_centre([F.lit(0.0)] * self.dims, self.centres)

    def predict(self, point: Sequence[float]) -> int:
        """Nearest centre of one point (driver-side, on model parameters only)."""
        best, best_d = 0, None
        for i, c in enumerate(self.centres):
            d = sum((float(a) - float(b)) ** 2 for a, b in zip(point, c))
            if best_d is None or d < best_d:
                best, best_d = i, d
        return best

    def to_frame(self, spark: SparkSession) -> DataFrame:
        fields = [T.StructField("cluster_id", T.IntegerType(), False)] + [
            T.StructField(f"c{d}", T.DoubleType(), False) for d in range(self.dims)]
        rows = [(i, *map(float, c)) for i, c in enumerate(self.centres)]
        return spark.createDataFrame(rows, T.StructType(fields))


def centres_of(model: KMeansModel | ClusterCentres) -> ClusterCentres:
    """Centres of a fitted ``KMeansModel`` (model kept alongside) or the centres as given."""
    if isinstance(model, ClusterCentres):
        return model
    return ClusterCentres([tuple(float(x) for x in c) for c in model.clusterCenters()], model)


def fixed_centres_1d(k: int = 21, step: float = 25.0, scale: float = 1.0,
                     offset: float = 0.0) -> ClusterCentres:
    """Rule-built 1-D centres ``scale * step * i + offset`` (oracle checks, benchmarks)."""
    return ClusterCentres([(scale * step * i + offset,) for i in range(k)])


def fixed_centres_2d(k: int = 36, per_row: int = 6, scale: float = 1.0,
                     offset: float = 0.0) -> ClusterCentres:
    """Rule-built 2-D centres: a grid of ``c0 = 10.5 + 100 * (i div per_row)``,
    ``c1 = 20.0137 + 2 * (i mod per_row)``; count axis scaled by ``scale``."""
    return ClusterCentres([
        (scale * (10.5 + 100.0 * (i // per_row)) + offset, 20.0137 + 2.0 * (i % per_row))
        for i in range(k)])


def assemble(stats: DataFrame, features: Sequence[str] = ONE_D,
             output: str = "features") -> DataFrame:
    """Statistics -> dense vector column."""
    return VectorAssembler(inputCols=list(features), outputCol=output,
                           handleInvalid="error").transform(stats)


def fit_kmeans(stats: DataFrame, k: int, features: Sequence[str] = ONE_D,
               max_iter: int = 50, seed: int = 42, tol: float = 1e-4) -> ClusterCentres:
    """M1: K-means (k-means||, Euclidean).  ``k == 1`` is the column means."""
    if k < 1:
        raise ValueError("k must be >= 1")
    if k == 1:
        return kmeans_k1(stats, features)
    km = KMeans(k=k, maxIter=max_iter, seed=seed, tol=tol,
                featuresCol="features", predictionCol="cluster_id")
    return centres_of(km.fit(assemble(stats.select(*features), features)))


def kmeans_k1(stats: DataFrame, features: Sequence[str] = ONE_D) -> ClusterCentres:
    """Q18: the single centre is the mean of every feature (one aggregate)."""
    row = stats.agg(*[F.avg(c).alias(c) for c in features]).first()
    return ClusterCentres([tuple(float(row[c]) for c in features)])


def assign_to_centres(df: DataFrame, centres: ClusterCentres | KMeansModel,
                      features: Sequence[str] = ONE_D, output: str = "cluster_id") -> DataFrame:
    """Add the id of the nearest centre."""
    return df.withColumn(output, centres_of(centres).assign(features))


def assign_clusters(stats: DataFrame, model: KMeansModel | ClusterCentres,
                    features: Sequence[str] = ONE_D, output: str = "cluster_id") -> DataFrame:
    """M5 through the model's own ``transform`` when it is a fitted ``KMeansModel``."""
    if isinstance(model, KMeansModel):
        m = model.copy().setPredictionCol(output).setFeaturesCol("features")
        return m.transform(assemble(stats, features)).drop("features")
    return assign_to_centres(stats, model, features, output)


def default_cluster(model: KMeansModel | ClusterCentres) -> int:
    """M6: prediction for the zero vector (count 0, average 0)."""
    if isinstance(model, KMeansModel):
        return int(model.predict(Vectors.dense([0.0] * len(model.clusterCenters()[0]))))
    return model.predict([0.0] * model.dims)


def dispersion(stats: DataFrame, centres: ClusterCentres | KMeansModel,
               features: Sequence[str] = ONE_D, dim: int = 0) -> DataFrame:
    """M4 + A7: mean absolute distance to the assigned centre along ``dim``."""
    c = centres_of(centres)
    cid = c.assign(features)
    x = F.col(features[dim]) if isinstance(features[dim], str) else features[dim]
    return stats.agg(F.avg(F.abs(x - c.coordinate(cid, dim))).alias("dispersion"))


def members_report(stats: DataFrame, centres: ClusterCentres | KMeansModel,
                   features: Sequence[str] = ONE_D, dim: int = 0) -> DataFrame:
    """What the members say of a fit, without its model: one row ``members, clusters, drift, cost, dispersion``.

    ``drift`` is the largest distance of a centre's coordinate from the mean of its members, as a
    share of the coordinate (or of 1, if less); ``cost`` the sum of squared distances to the assigned
    centres, ``dispersion`` the mean absolute distance to them along ``dim``.
    """
    c = centres_of(centres)
    rows = stats.select(*features, c.assign(features).alias("cluster_id"))
    off = [F.col(f) - c.coordinate("cluster_id", i) for i, f in enumerate(features)]
    groups = rows.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("members"), F.sum(sum((x * x for x in off[1:]), off[0] * off[0])).alias("cost"),
        F.sum(F.abs(off[dim])).alias("away"), *[F.avg(f).alias(f"mean_{i}") for i, f in enumerate(features)])
    drifts = [F.abs(F.col(f"mean_{i}") - c.coordinate("cluster_id", i)) / F.greatest(F.lit(1.0), F.abs(c.coordinate("cluster_id", i)))
              for i in range(len(features))]
    return groups.agg(F.sum("members").alias("members"), F.count(F.lit(1)).alias("clusters"),
                      F.max(F.greatest(*drifts) if len(drifts) > 1 else drifts[0]).alias("drift"),
                      F.sum("cost").alias("cost"), (F.sum("away") / F.sum("members")).alias("dispersion"))


def _fit_and_score(stats: DataFrame, k: int, features: Sequence[str], max_iter: int,
                   seed: int, dim: int) -> tuple[ClusterCentres, float, float]:
    t0 = time.perf_counter()
    centres = fit_kmeans(stats, k, features, max_iter=max_iter, seed=seed)
    fit_seconds = time.perf_counter() - t0
    disp = dispersion(stats, centres, features, dim).first()["dispersion"]
    return centres, float(disp) if disp is not None else float("nan"), fit_seconds


K_SWEEP = tuple(range(1, 100, 5))   # fixed values: K = 1, 6, ..., 96


def sweep_k(stats: DataFrame, ks: Iterable[int] = K_SWEEP, features: Sequence[str] = ONE_D,
            max_iter: int = 50, seed: int = 42, dim: int = 0,
            parallelism: int = 1) -> tuple[DataFrame, dict[int, ClusterCentres]]:
    """M2: one fit per K -> metrics ``k, n_centres, dispersion, fit_seconds`` and the fits.

    The statistics are written once as a table so every fit rescans a short lineage.
    """
    ks = list(ks)
    data = fit_layout(stats.select(*features))
    results = in_parallel(lambda k: _fit_and_score(data, k, features, max_iter, seed, dim),
                        ks, parallelism)
    spark = stats.sparkSession
    schema = "k int, n_centres int, dispersion double, fit_seconds double"
    metrics = spark.createDataFrame(
        [(k, r[0].k, r[1], r[2]) for k, r in zip(ks, results)], schema)
    return metrics, {k: r[0] for k, r in zip(ks, results)}


def restart_kmeans(stats: DataFrame, k: int = 21, n: int = 7, features: Sequence[str] = ONE_D,
                   seeds: Sequence[int] | None = None, max_iter: int = 50, dim: int = 0,
                   parallelism: int = 1) -> tuple[DataFrame, list[ClusterCentres]]:
    """M3: ``n`` fits of the same K with different seeds -> metrics and fits."""
    seeds = list(seeds) if seeds is not None else [1000 + i for i in range(n)]
    data = fit_layout(stats.select(*features))
    results = in_parallel(lambda s: _fit_and_score(data, k, features, max_iter, s, dim),
                        seeds, parallelism)
    spark = stats.sparkSession
    schema = "run int, seed long, k int, n_centres int, dispersion double, fit_seconds double"
    metrics = spark.createDataFrame(
        [(i, s, k, r[0].k, r[1], r[2]) for i, (s, r) in enumerate(zip(seeds, results))], schema)
    return metrics, [r[0] for r in results]


def select_best(metrics: DataFrame, by: str, ascending: bool = True) -> DataFrame:
    """O3: the best row of a metrics table."""
    order = F.asc(by) if ascending else F.desc(by)
    return metrics.orderBy(order).limit(1)


# ---- persistence (S4, S5) -------------------------------------------------

def save_model(model: KMeansModel | ClusterCentres, path: str, spark: SparkSession | None = None) -> None:
    """ML writer for fitted models, a centres table for closed-form ones.

    Either replaces everything at ``path``, so an older model never stays.
    """
    if isinstance(model, ClusterCentres) and model.model is not None:
        model = model.model
    if isinstance(model, KMeansModel):
        model.write().overwrite().save(path)
        return
    if spark is None:
        raise ValueError("a SparkSession is needed to save plain centres")
    model.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> ClusterCentres:
    """Load what ``save_model`` wrote; the form is told by the ML metadata."""
    try:
        fitted = not spark.read.text(f"{path}/metadata").isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        fitted = False
    if fitted:
        return centres_of(KMeansModel.load(path))
    df = spark.read.parquet(path).orderBy("cluster_id")
    rows = df.collect()  # <= K rows: model parameters
    return ClusterCentres([tuple(r[f"c{d}"] for d in range(len(df.columns) - 1)) for r in rows])
