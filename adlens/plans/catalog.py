"""Registered queries: ``name -> f(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (through the typed views of
``sources.tables``) over the whole tables.  Derived floating-point columns
are rounded to 6 places so that engines summing in a different order agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clustering as C
from ..operators import features as FT
from ..operators import forest_table as FO
from ..operators import group_lists as GL
from ..operators import keywords as K
from ..operators import regression as R
from ..operators import reported as RP
from ..operators import requests as RQ
from ..operators import sketches as SK
from ..operators import tree_model as TM
from ..sources import tables as TB
from ..sources import incremental as IN
from ..sources import text as TX
from ..sources.runlog import RunLog
from ..session import in_parallel, in_staging, materialize, modified, staging_path
from ..streaming import reported as SW
from ..streaming import responses as SR
from ..streaming import throughput as ST
from . import flows

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Fixed values of the checks: the linear weights of the residual queries, the
# request URL base, the throughput window and its watermark.
FIXED_WEIGHT_IMPRESSION = 0.001
FIXED_WEIGHT_MAX_CPC = 10.0
BASE_URL = RQ.DEFAULT_BASE_URL
WINDOW_SECONDS = 3600
DAY_SECONDS = 24 * 3600
WATERMARK = "1 hour"
TOP_N = 20
SEED = 42
# Independent fits submitted concurrently (each is itself distributed); two at
# a time, with ``regression.MAX_MEMORY_MB`` of node statistics each, fit a
# default 1 GiB driver heap, whose size is not ours to choose.
FIT_PARALLELISM = 2


def query(fn: Query) -> Query:
    """Register a query function under its name."""
    REGISTRY[fn.__name__] = fn
    return fn


def r6(c):
    """Round to 6 decimal places (both engines round the same way)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def centres_1d() -> C.ClusterCentres:
    """Fixed 1-D centres of the checks: ``25 * i``, i = 0..20."""
    return C.fixed_centres_1d(21)


def centres_2d() -> C.ClusterCentres:
    """Fixed 2-D centres of the checks: a 6 x 6 grid, K = 36."""
    return C.fixed_centres_2d(36)


def _kw(spark, sf):
    return TB.keyword_rows(spark, sf)


def _stats(spark, sf):
    return K.keyword_stats(_kw(spark, sf))


# ---- sources -----------------------------------------------------------------

@query
def enabled_keywords(spark, sf):
    """Enabled rows with the normalised keyword and QI as double."""
    return K.keyword_qi(_kw(spark, sf))


@query
def text_scan_roundtrip(spark, sf):
    """Keyword rows written as ';' text and parsed back (fail-fast)."""
    path = staging_path(spark, "keyword-lines")
    TX.write_lines(TX.format_keyword_lines(_kw(spark, sf)), path)
    rows = TX.read_keyword_rows(spark, path)
    return rows.withColumn("quota_impression", F.col("quota_impression").cast("double"))


@query
def history_scan(spark, sf):
    """History rows written as ',' text, parsed with the account exclusion."""
    path = staging_path(spark, "history-lines")
    TX.write_lines(TX.format_history_lines(TB.history_rows(spark, sf)), path)
    rows = TX.read_history_rows(spark, path, excluded_accounts=TB.EXCLUDED_ACCOUNTS)
    h = FT.campaign_history(rows)
    return h.select("client_id", "account_id", r6("label").alias("label"),
                    r6("impression").alias("impression"), r6("max_cpc").alias("max_cpc"))


@query
def field_count_profile(spark, sf):
    """Records per field count (JVM counting) for both record formats."""
    kw = TX.field_count_profile(TX.format_keyword_lines(_kw(spark, sf)), ";")
    hi = TX.field_count_profile(TX.format_history_lines(TB.history_rows(spark, sf)), ",")
    return (kw.select(F.lit("keyword").alias("source"), "n_fields", "n_lines")
            .unionByName(hi.select(F.lit("history").alias("source"), "n_fields", "n_lines")))


@query
def scan_quality(spark, sf):
    """Record counters observed in the pass that parses the keyword records and reduces them."""
    path, seen = staging_path(spark, "observed-lines"), Observation("records")
    TX.write_lines(TX.format_keyword_lines(_kw(spark, sf)), path)
    lines = TX.observe_records(TX.read_lines(spark, path), seen)
    keywords = materialize(K.keyword_counts(TX.parse_keyword_lines(lines))).count()
    m = seen.get
    return spark.createDataFrame([(m["records"], m["short"], m["fewest_fields"], m["most_fields"], keywords)],
                                 "records long, short long, fewest_fields int, most_fields int, keywords long")


# ---- keyword statistics ------------------------------------------------------------

@query
def keyword_counts(spark, sf):
    """A1: occurrences per normalised keyword."""
    return K.keyword_counts(_kw(spark, sf))


@query
def keyword_means(spark, sf):
    """A2: mean quota impression per normalised keyword."""
    return K.keyword_means(_kw(spark, sf)).select("keyword", r6("avg_qi").alias("avg_qi"))


@query
def keyword_stats(spark, sf):
    """Count and mean per keyword in one aggregate."""
    return _stats(spark, sf).select("keyword", "n", r6("avg_qi").alias("avg_qi"))


@query
def keyword_stats_incremental(spark, sf):
    """The statistics of a folder that grows in three steps, files offered again counting once."""
    path = staging_path(spark, "growing")
    for part in range(3):
        mine = _kw(spark, sf).where(F.pmod(F.xxhash64("client_id", "keyword"), F.lit(3)) == part)
        TX.write_lines(TX.format_keyword_lines(mine), f"{path}/step{part}")
    kept = IN.IncrementalKeywordStats(spark, f"{path}/kept")
    steps = [IN.list_files(spark, f"{path}/step{part}") for part in range(3)]
    for offered in (steps[0], steps[0] + steps[1], steps[2] + steps[0]):
        kept.update(offered)
    return kept.stats().select("keyword", "n", r6("avg_qi").alias("avg_qi"))


@query
def top_keywords(spark, sf):
    """O2: the most frequent keywords (top-k report, ties by keyword)."""
    return K.top_keywords(K.keyword_counts(_kw(spark, sf)), TOP_N)


@query
def count_moments(spark, sf):
    """Number of keywords, mean and sample sd of their counts."""
    m = K.count_moments(K.keyword_counts(_kw(spark, sf)))
    return m.select("keywords", r6("mean_n").alias("mean_n"), r6("sd_n").alias("sd_n"))


@query
def standardized_counts(spark, sf):
    """Z-score of each keyword count."""
    z = K.standardize(K.keyword_counts(_kw(spark, sf)), ["n"])
    return z.select("keyword", "n", r6("n_z").alias("n_z"))


@query
def campaign_keyword_groups(spark, sf):
    """A3: keywords grouped per campaign as a distributed multiset."""
    return K.campaign_keyword_groups(_kw(spark, sf))


# ---- clustering with fixed centres ----------------------------------------------------

#: Records per segment in the checks, where campaigns are small.
LIST_SEGMENT = 16


@query
def keyword_lists(spark, sf):
    """A3: each campaign's keywords in record order, in segments."""
    lists = GL.keyword_lists(TB.keyword_rows_in_order(spark, sf), ["order_key"], LIST_SEGMENT)
    return lists.select("client_id", "account_id", "segment", "n", F.array_join("keywords", "|").alias("keywords"))


@query
def assign_clusters_1d(spark, sf):
    """M5: nearest fixed 1-D centre (K=21) per keyword count."""
    return C.assign_to_centres(K.keyword_counts(_kw(spark, sf)), centres_1d(), C.ONE_D)


@query
def assign_clusters_2d(spark, sf):
    """M5: nearest fixed 2-D centre (K=36) per keyword (count, mean)."""
    s = C.assign_to_centres(_stats(spark, sf), centres_2d(), C.TWO_D)
    return s.select("keyword", "n", r6("avg_qi").alias("avg_qi"), "cluster_id")


def _two_rows(stats: DataFrame, per_set) -> DataFrame:
    """One aggregate over the statistics for both centre sets, stacked into rows."""
    sets = [(1, centres_1d(), C.ONE_D), (2, centres_2d(), C.TWO_D)]
    aggs, structs = [], []
    for dims, c, feats in sets:
        a, st = per_set(dims, c, feats)
        aggs += a
        structs.append(st)
    return stats.agg(*aggs).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


@query
def default_cluster(spark, sf):
    """Cluster of the zero vector, and how many keywords share it, per centre set."""
    def per_set(dims, c, feats):
        d = c.default_cluster()
        return ([F.count_if(c.assign(feats) == d).alias(f"in{dims}")],
                F.struct(F.lit(dims).alias("dims"), d.alias("default_cluster"),
                         F.col(f"in{dims}").alias("keywords_in_default")))
    return _two_rows(_stats(spark, sf), per_set)


@query
def dispersion_fixed_centres(spark, sf):
    """Mean |count - assigned centre| for the fixed 1-D and 2-D centres."""
    def per_set(dims, c, feats):
        cid = c.assign(feats)
        dev = F.abs(F.col(feats[0]) - c.coordinate(cid, 0))
        return ([F.avg(dev).alias(f"disp{dims}")],
                F.struct(F.lit(dims).alias("dims"), F.lit(c.k).alias("k"),
                         r6(f"disp{dims}").alias("dispersion")))
    return _two_rows(_stats(spark, sf), per_set)


@query
def kmeans_k1(spark, sf):
    """M1/Q18: K=1 is the mean; its dispersion."""
    counts = K.keyword_counts(_kw(spark, sf))
    c = C.fit_kmeans(counts, 1, C.ONE_D)
    return C.dispersion(counts, c, C.ONE_D).select(
        F.lit(1).alias("k"), F.round(F.lit(c.centres[0][0]), 6).alias("centre_n"),
        r6("dispersion").alias("dispersion"))


# ---- labels, histograms, training rows --------------------------------------------------

def _label_keywords(spark, sf, lookup_case):
    kw = _kw(spark, sf)
    c = centres_2d()
    dictionary = FT.label_dictionary(K.keyword_stats(kw), c, C.TWO_D)
    return FT.label_keywords(kw, dictionary, c.default_cluster(), lookup_case)


@query
def label_keywords_reference(spark, sf):
    """Per-row cluster label, blank-stripped lookup (mixed case misses)."""
    return _label_keywords(spark, sf, "reference")


@query
def label_keywords_normalized(spark, sf):
    """Per-row cluster label, normalised lookup."""
    return _label_keywords(spark, sf, "normalized")


@query
def cluster_histogram_21(spark, sf):
    """A4: per-campaign histogram over 21 clusters (1-D centres)."""
    return FT.campaign_cluster_features(_kw(spark, sf), centres_1d(), 21, C.ONE_D)


@query
def cluster_histogram_36(spark, sf):
    """A5: per-campaign histogram over 36 clusters (2-D centres)."""
    return FT.campaign_cluster_features(_kw(spark, sf), centres_2d(), 36, C.TWO_D)


@query
def campaign_avg_of_avg(spark, sf):
    """Per campaign, the mean of its rows' keyword means (0 on a miss)."""
    a = FT.campaign_avg_of_avg(_kw(spark, sf))
    return a.select("client_id", "account_id", r6("avg_of_avg").alias("avg_of_avg"))


def _training(spark, sf, centres, k, feats):
    rows = flows.campaign_training_rows(_kw(spark, sf), TB.history_rows(spark, sf), centres,
                                        feats, k, excluded_accounts=TB.EXCLUDED_ACCOUNTS)
    return rows


def _rounded_training(df):
    return df.select(*[r6(c).alias(c) if c in ("label", "impression", "max_cpc") else F.col(c)
                       for c in df.columns])


@query
def training_rows_21(spark, sf):
    """History joined with the K=21 histogram."""
    return _rounded_training(_training(spark, sf, centres_1d(), 21, C.ONE_D))


@query
def training_rows_36(spark, sf):
    """History joined with the K=36 histogram."""
    return _rounded_training(_training(spark, sf, centres_2d(), 36, C.TWO_D))


@query
def training_rows_avg_of_avg(spark, sf):
    """History joined with the average-of-average feature."""
    rows = flows.campaign_avg_training_rows(_kw(spark, sf), TB.history_rows(spark, sf),
                                            excluded_accounts=TB.EXCLUDED_ACCOUNTS)
    return rows.select(*[r6(c).alias(c) if c in ("label", "impression", "max_cpc", "avg_of_avg")
                         else F.col(c) for c in rows.columns])


def _fixed_linear():
    return R.LinearModel(["impression", "max_cpc"],
                         [FIXED_WEIGHT_IMPRESSION, FIXED_WEIGHT_MAX_CPC])


@query
def linear_fixed_weights_residuals(spark, sf):
    """Residuals of a fixed linear model on the training rows."""
    pred = R.residuals(_fixed_linear().transform(_training(spark, sf, centres_2d(), 36, C.TWO_D)))
    return pred.select("client_id", "account_id", r6("label").alias("label"),
                       r6("prediction").alias("prediction"), r6("residual").alias("residual"))


@query
def mse_fixed_weights(spark, sf):
    """Mean squared error of a fixed linear model."""
    pred = _fixed_linear().transform(_training(spark, sf, centres_2d(), 36, C.TWO_D))
    return R.mse(pred).select("rows", r6("mse").alias("mse"))


# ---- iterative ML (rows-only checks) ------------------------------------------------

@query
def linear_sgd(spark, sf):
    """M7: 300 full-batch gradient steps; weights and training MSE."""
    rows = materialize(_training(spark, sf, centres_2d(), 36, C.TWO_D))
    cols = FT.feature_columns(FT.histogram_columns(36))
    model = R.fit_linear_sgd(rows, cols)
    train_mse = R.mse_value(model.transform(rows))
    # weights are ~1e-9: shown to 8 significant digits (fixed decimals would zero them)
    return model.weights_frame(spark).select(
        "position", "feature", F.format_string("%.8e", "weight").alias("weight_sci"),
        F.round(F.lit(train_mse), 6).alias("training_mse"),
        F.lit(model.iterations_run).alias("iterations"))


_shared: dict[tuple, object] = {}


def _once(spark, sf, name, make):
    """Fits that several queries report on run once for an application, folder and state of its data.

    What is kept are metric frames, one model and written tables.
    """
    if in_staging():  # what is written now is dropped at the end of the block
        return make()
    key = (spark.sparkContext.applicationId, sf, modified(spark, f"{sf}/lineitem.parquet", f"{sf}/part.parquet"), name)
    if key not in _shared:
        _shared[key] = make()
    return _shared[key]


def _restarts(spark, sf):
    return _once(spark, sf, "restarts", lambda: C.restart_kmeans(
        K.keyword_counts(_kw(spark, sf)), 21, flows.KMEANS_RESTARTS, C.ONE_D, parallelism=FIT_PARALLELISM))


def _sweep(spark, sf):
    return _once(spark, sf, "sweep", lambda: C.sweep_k(
        _stats(spark, sf), C.K_SWEEP, C.TWO_D, max_iter=flows.KMEANS_ITERATIONS, seed=SEED,
        parallelism=FIT_PARALLELISM))


@query
def kmeans_sweep(spark, sf):
    """M1 M2 M4: K-means for K = 1, 6, ..., 96 on (count, mean); dispersion per K."""
    return _sweep(spark, sf)[0].drop("fit_seconds")


@query
def kmeans_invariants(spark, sf):
    """M1 M2: what must hold of every fit of the sweep, whatever the seed.

    Invariants, weaker than values: at most K centres, and a within-cluster sum
    of squares not above that of K = 1; for K = 1 also the exact dispersion.
    """
    metrics, fits = _sweep(spark, sf)
    mean = [F.sum((F.col(x) - F.lit(m)) ** 2) for x, m in zip(C.TWO_D, fits[1].centres[0])]
    most = _stats(spark, sf).agg(sum(mean[1:], mean[0]).alias("cost")).first()["cost"] * (1 + 1e-9)
    disp = {r["k"]: r["dispersion"] for r in metrics.collect()}  # one row per K
    return spark.createDataFrame(
        [(k, c.k <= k, c.model is None or c.model.summary.trainingCost <= most, round(disp[k], 6) if k == 1 else None)
         for k, c in fits.items()],
        "k int, centres_within_k boolean, cost_at_most_k1 boolean, dispersion_k1 double")


@query
def kmeans_restarts(spark, sf):
    """M3: 7 K-means fits at K=21 on counts; dispersion per fit."""
    return _restarts(spark, sf)[0].drop("fit_seconds")


@query
def kmeans_members(spark, sf):
    """M1 M2 M3: every fit of the sweep and of the restarts, held against its members.

    Each centre must be the mean of the keywords nearest to it, the model's cost and the logged
    dispersion what these keywords give.
    """
    stats = materialize(_stats(spark, sf).select("n", F.col("avg_qi").cast("double").alias("avg_qi")))
    (sweep, by_k), (restarts, runs) = _sweep(spark, sf), _restarts(spark, sf)
    # one row per fit
    fits = [("sweep", r["k"], 0, r["dispersion"], by_k[r["k"]], C.TWO_D) for r in sweep.collect()]
    fits += [("restart", r["k"], r["run"], r["dispersion"], runs[r["run"]], C.ONE_D) for r in restarts.collect()]
    found = in_parallel(lambda f: C.members_report(stats, f[4], f[5]).first(), fits, FIT_PARALLELISM)

    def near(x, y):
        return abs(x - y) <= 1e-6 * max(1.0, abs(y))

    rows = [(kind, k, run, m["members"], m["clusters"] <= k, m["drift"] <= 1e-6,
             fit.model is None or near(fit.model.summary.trainingCost, m["cost"]), near(logged, m["dispersion"]))
            for (kind, k, run, logged, fit, _), m in zip(fits, found)]
    return spark.createDataFrame(rows, "fit string, k int, run int, members long, clusters_within_k boolean, "
                                       "centres_are_means boolean, cost_follows boolean, dispersion_follows boolean")


@query
def select_best(spark, sf):
    """O3: the restart with the lowest dispersion."""
    return C.select_best(_restarts(spark, sf)[0], "dispersion").drop("fit_seconds")


@query
def select_best_centres(spark, sf):
    """O3: the fixed centre set with the lowest dispersion."""
    return C.select_best(dispersion_fixed_centres(spark, sf), "dispersion")


@query
def model_roundtrip(spark, sf):
    """Fixed 1-D centres saved over another model, loaded and assigned."""
    counts = K.keyword_counts(_kw(spark, sf))
    path = staging_path(spark, "centres")
    C.save_model(C.fit_kmeans(counts, 3, C.ONE_D, max_iter=2, seed=SEED), path, spark)
    C.save_model(centres_1d(), path, spark)
    return C.assign_to_centres(counts, C.load_model(spark, path), C.ONE_D)


@query
def metrics_log(spark, sf):
    """A metrics table appended to a log row by row, and read back."""
    path = staging_path(spark, "metrics-log")
    metrics = materialize(dispersion_fixed_centres(spark, sf))
    for dims in (1, 2):
        TX.append_metrics(metrics.where(F.col("dims") == dims), path)
    return spark.read.parquet(path)


def _split_bucket():
    """The bucket that deals the training rows out, for the forests too."""
    return R.text_split_bucket(["client_id", "account_id", F.col("impression").cast("long")], SEED)


@query
def split_rows(spark, sf):
    """The side of every training row, from the md5 of its key."""
    keyed = _training(spark, sf, centres_2d(), 36, C.TWO_D).select(
        "client_id", "account_id", F.col("impression").cast("long").alias("impression"), _split_bucket().alias("_bucket"))
    train, test = R.split_by_bucket(keyed)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


# The whole forest work of the original runs: the 12-point grid, three repeats
# of 150 trees at depths 14 and 19, and the residuals of the best of those.
FOREST_BINS = 1024


def _forest_rows(spark, sf):
    def make():
        rows = _training(spark, sf, centres_2d(), 36, C.TWO_D)
        return flows.labeled_split(rows, FT.feature_columns(FT.histogram_columns(36)), SEED, bucket=_split_bucket())
    return _once(spark, sf, "forest-rows", make)


def _fit_rows(spark, sf):
    """What the grids and repeats fit on, and the test rows."""
    train, test = _forest_rows(spark, sf)
    return _once(spark, sf, "fit-rows", lambda: R.for_fits(train, test, FOREST_BINS, {})), test


def _final_forests(spark, sf):
    train, test = _fit_rows(spark, sf)
    return _once(spark, sf, "final-forests", lambda: R.repeat_forest(
        train, test, *flows.FINAL_FORESTS, max_bins=FOREST_BINS, checkpoint_inputs=False,
        parallelism=FIT_PARALLELISM))


@query
def forest_grid(spark, sf):
    """The 12-point forest grid on a stable 70/30 split; test MSE per point."""
    train, test = _fit_rows(spark, sf)
    return R.grid_forest(train, test, *flows.FOREST_GRID_36, FOREST_BINS, SEED, parallelism=FIT_PARALLELISM,
                         checkpoint_inputs=False).drop("fit_seconds")


@query
def forest_repeats(spark, sf):
    """3 x 150 trees at depths 14 and 19, a seed for each run; test MSE per run."""
    return _final_forests(spark, sf)[0].drop("fit_seconds")


@query
def forest_residuals(spark, sf):
    """Residuals of the best final forest on the test rows."""
    _, test = _forest_rows(spark, sf)
    pred = R.residuals(_final_forests(spark, sf)[1].transform(test))
    return pred.select("residual", "label", "prediction")


def _prefix_log(spark, sf):
    """The 12-point grid from one forest a depth, stopped half way and resumed; its log."""
    def make():
        train, test = _fit_rows(spark, sf)
        path = staging_path(spark, "grid-log")
        for stop in (2, None):  # a new log object finds what the stopped run has committed
            log = RunLog(spark, path, "num_trees int, max_depth int, mse double")
            FO.prefix_grid(train, test, *flows.FOREST_GRID_36, log, FOREST_BINS, SEED, stop_after=stop)
        return log
    return _once(spark, sf, "prefix-log", make)


@query
def forest_prefix_grid(spark, sf):
    """Test MSE of the 12-point grid, all tree counts of a depth from one forest and one pass."""
    return _prefix_log(spark, sf).table().select("num_trees", "max_depth", "mse")


@query
def grid_log(spark, sf):
    """What the log of a grid holds that was stopped after two depths and resumed."""
    log = _prefix_log(spark, sf).table()
    return (log.groupBy("progress", "entry", "max_depth", "num_trees")
            .agg(F.count("*").alias("times"), F.min(F.col("mse") > 0).alias("scored")))


def _small_forest(spark, sf):
    train, test = _forest_rows(spark, sf)
    model = _once(spark, sf, "small-forest", lambda: R.fit_forest(train, 20, 9, FOREST_BINS, SEED))
    return model, FO.forest_nodes(model, spark), test


@query
def forest_nodes(spark, sf):
    """Every node of a forest of 20 trees of depth 9, as a table."""
    return _small_forest(spark, sf)[1]


@query
def forest_scored(spark, sf):
    """Test rows scored from the node table, and on how many the model's own prediction and residual agree."""
    model, nodes, test = _small_forest(spark, sf)
    own = R.residuals(model.transform(test)).withColumnRenamed("prediction", "own").withColumnRenamed("residual", "own_residual")
    both = R.residuals(FO.score_nodes(own, nodes, 9))
    near = (F.abs(F.col("prediction") - F.col("own")) <= 1e-9 * F.abs(F.col("own")) + 1e-9) & (
        F.abs(F.col("residual") - F.col("own_residual")) <= 1e-9 * F.abs(F.col("own")) + 1e-9)
    return both.agg(F.count("*").alias("rows"), F.count_if(near).alias("agreeing"))


@query
def forest_exact(spark, sf):
    """M8: deep trees on all rows and features predict the mean of equal rows."""
    rows = materialize(TM.UnitScaleTransformer().transform(_joined(spark, sf)))
    model = R.fit_forest(rows, 3, 30, FOREST_BINS, SEED, "all", bootstrap=False)
    arr = vector_to_array("features")
    return model.transform(rows).select(
        r6("label").alias("label"), r6(arr[0]).alias("age_years"), r6(arr[1]).alias("high_meters"),
        r6("prediction").alias("prediction"))


# ---- id join, unit scaling, decision tree ---------------------------------------------

def _joined(spark, sf):
    """Both inputs through the table scan (S3), as views named like the originals."""
    TB.a_ml(spark, sf).createOrReplaceTempView("a_ml")
    TB.b_ml(spark, sf).createOrReplaceTempView("b_ml")
    return TM.join_on_id(TX.read_table(spark, "a_ml"), TX.read_table(spark, "b_ml"))


@query
def id_join(spark, sf):
    """a_ml JOIN b_ml ON id through the table scan."""
    return _joined(spark, sf)


#: Buckets of the catalogue tables of the checks.
ID_BUCKETS = 8


@query
def id_join_bucketed(spark, sf):
    """The id join over catalogue tables bucketed and sorted by id, without an exchange."""
    names = []
    for name, rows in (("a_ml", TB.a_ml(spark, sf)), ("b_ml", TB.b_ml(spark, sf))):
        path = staging_path(spark, f"bucketed-{name}")
        names.append(f"{name}_{path[-8:]}")
        TX.write_bucketed(rows, names[-1], ["id"], ID_BUCKETS, path=path)
    a, b = (TX.read_table(spark, n) for n in names)
    return TM.join_on_id(a.hint("merge"), b)


@query
def unit_scale(spark, sf):
    """Label and the two scaled features."""
    out = TM.UnitScaleTransformer().transform(_joined(spark, sf))
    arr = vector_to_array("features")
    return out.select(r6("label").alias("label"), r6(arr[0]).alias("age_years"),
                      r6(arr[1]).alias("high_meters"))


@query
def unit_scale_params(spark, sf):
    """Every parameter set, saved with the ML writer and loaded again."""
    path = staging_path(spark, "unit-scale")
    TM.UnitScaleTransformer(inputCol1="high", inputCol2="weight", outputCol1="x", outputCol2="y",
                            labelCol="age", keepScaled=True).write().save(path)
    out = TM.UnitScaleTransformer.load(path).transform(_joined(spark, sf))
    arr = vector_to_array("features")
    return out.select(r6("label").alias("label"), r6("x").alias("x"), r6("y").alias("y"),
                      r6(arr[0]).alias("feature_1"), r6(arr[1]).alias("feature_2"))


@query
def decision_tree_fit(spark, sf):
    """Transformer + depth-30 tree fitted and applied to the same rows."""
    _, pred = TM.fit_tree_pipeline(_joined(spark, sf))
    arr = vector_to_array("features")
    return pred.select(r6("label").alias("label"), r6(arr[0]).alias("age_years"),
                       r6(arr[1]).alias("high_meters"), r6("prediction").alias("prediction"))


# ---- request log --------------------------------------------------------------------

@query
def request_urls(spark, sf):
    """Form-encoded request URL per logged request."""
    return RQ.request_urls(TB.request_log(spark, sf), BASE_URL)


@query
def throughput(spark, sf):
    """R2: successful requests per hour window and the integer rate."""
    return RQ.throughput(TB.request_log(spark, sf), WINDOW_SECONDS)


@query
def throughput_1s(spark, sf):
    """R2: successful requests per second, the width of the original report."""
    return RQ.throughput(TB.request_log(spark, sf), 1)


@query
def throughput_reported(spark, sf):
    """R2: windows of at least a second that run from the previous report, as the original reports."""
    return RP.throughput_reported(TB.request_log(spark, sf), 1)


@query
def throughput_reported_hourly(spark, sf):
    """R2: the same with windows of at least an hour."""
    return RP.throughput_reported(TB.request_log(spark, sf), WINDOW_SECONDS)


@query
def responses_log(spark, sf):
    """Response contents appended to a table, and read back."""
    path = staging_path(spark, "responses")
    log = TB.request_log(spark, sf)
    for failed in (False, True):
        RQ.write_responses(log.where((F.col("status") == RQ.FAILED) == F.lit(failed)), path)
    return spark.read.parquet(path)


@query
def responses_stream(spark, sf):
    """Response contents from a stream, one log entry for a batch; the last batch run again adds nothing."""
    events = TB.table(spark, sf, "events")
    stream = TB.request_log_of(ST.read_stream(ST.stream_session(spark), sf, events.schema, glob="events.parquet"))
    log = RunLog(spark, staging_path(spark, "responses-log"), "visitor_id long, content string")
    SR.run_responses(stream, log)
    SR.response_sink(log)(TB.request_log(spark, sf), 0)  # what a restart does to a batch that was not acknowledged
    return log.table().select("visitor_id", "content")


@query
def throughput_reported_stream(spark, sf):
    """Windows from the previous report, live: what the stream reports, then the flush of what it held back."""
    events, session = TB.table(spark, sf, "events"), ST.stream_session(spark)
    stream = TB.request_log_of(ST.read_stream(session, sf, events.schema, glob="events.parquet"))
    zone = "timestamp_ntz" if isinstance(events.schema["ts"].dataType, T.TimestampNTZType) else "timestamp"
    log = SW.ReportedLog(session, staging_path(session, "reported-log"), 1, WINDOW_SECONDS, zone)
    SW.run_reported(stream, log)
    return log.read().withColumn("closed", F.lit(True)).unionByName(log.flush())


@query
def latency_summary(spark, sf):
    """Count, mean, min, max and exact percentiles of successful latency."""
    s = RQ.latency_summary(TB.request_log(spark, sf))
    return s.select("requests", r6("mean_ms").alias("mean_ms"), "min_ms", "max_ms",
                    r6("p50_ms").alias("p50_ms"), r6("p95_ms").alias("p95_ms"),
                    r6("p99_ms").alias("p99_ms"))


@query
def latency_merged(spark, sf):
    """Hourly sketch states of three batches, one of them given twice, merged to days and to the whole
    log; whether each percentile's exact rank is within the bound."""
    log = TB.request_log(spark, sf)
    zone = "timestamp_ntz" if isinstance(log.schema["ts"].dataType, T.TimestampNTZType) else "timestamp"
    kept = SK.LatencyLog(spark, staging_path(spark, "latency-states"), WINDOW_SECONDS, zone=zone)
    for batch in (0, 1, 1, 2):
        kept.add(f"batch-{batch}", log.where(F.pmod(F.xxhash64("visitor_id", "ts"), F.lit(3)) == batch))
    spans = []
    for name, width in (("day", DAY_SECONDS), ("all", None)):
        spans.append(SK.within_rank_error(log, materialize(kept.report(width)), width).select(
            F.lit(name).alias("span"), "window_start", "window_end", "requests", r6("mean_ms").alias("mean_ms"), "min_ms", "max_ms",
            "p50_ms_within", "p95_ms_within", "p99_ms_within"))
    return spans[0].unionByName(spans[1])


def _stream(spark, sf, width):
    events = TB.table(spark, sf, "events")
    stream = ST.read_stream(ST.stream_session(spark), sf, events.schema, glob="events.parquet")
    out = ST.run_available(ST.throughput_stream(TB.request_log_of(stream), width, WATERMARK),
                           "throughput-stream")
    return spark.read.parquet(out)


@query
def throughput_stream(spark, sf):
    """The throughput per window from a watermarked stream (closed windows)."""
    return _stream(spark, sf, WINDOW_SECONDS)


@query
def throughput_stream_1s(spark, sf):
    """The same per second."""
    return _stream(spark, sf, 1)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword stats -> K-means (K=36, 2-D) -> campaign histogram -> training rows."""
    kw = _kw(spark, sf)
    centres = C.fit_kmeans(K.keyword_stats(kw), 36, C.TWO_D, seed=SEED)
    return flows.campaign_training_rows(kw, TB.history_rows(spark, sf), centres, C.TWO_D, 36,
                                        excluded_accounts=TB.EXCLUDED_ACCOUNTS)
