"""Guarantees that hold beyond the plain results: fits do not depend on the
layout of their input, guards spare the rows they promise to spare, saved
models replace older ones, broadcasts are bounded by bytes, staged tables go."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from adlens import session as S
from adlens.operators import clustering as C
from adlens.operators import features as FT
from adlens.operators import regression as R
from adlens.operators import requests as RQ
from adlens.sources import tables as TB
from adlens.sources import text as TX
from conftest import SF_SMALL, keyword_line, lines_df


def test_forest_and_kmeans_do_not_depend_on_the_layout(spark):
    df = spark.range(6000).select(
        (F.col("id") % 97).cast("double").alias("a"), (F.sqrt(F.col("id")) % 7).alias("b"))
    df = df.withColumn("label", F.col("a") + F.col("b") * F.col("b") + F.pmod(F.hash("a", "b"), F.lit(10)))
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    got = set()
    try:
        for parts, shuffle in ((4, "3"), (16, "40")):
            spark.conf.set("spark.sql.shuffle.partitions", shuffle)
            data = FT.to_labeled(df.repartition(parts), ["a", "b"])
            laid = S.fit_layout(data)
            m = R.grid_forest(laid, laid, [6], [5], max_bins=64, checkpoint_inputs=False).first()["mse"]
            sweep, _ = C.sweep_k(df.repartition(parts).select(F.col("a").alias("n"), F.col("b").alias("avg_qi")),
                                 [5], C.TWO_D, max_iter=5)
            got.add((round(m, 9), round(sweep.first()["dispersion"], 9)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)
    assert len(got) == 1


def test_fit_partitions_follow_the_rows_alone():
    assert [S.fit_partitions(n) for n in (0, 1, 4096, 4097, 10 ** 6, 10 ** 9)] == [1, 1, 1, 2, 64, 4000]


def test_paused_rows_may_be_short_wherever_the_filter_runs(spark, tmp_table_dir):
    short = "c2;a2;;Blue;;paused;"
    rows = TX.parse_keyword_lines(lines_df(spark, [keyword_line(), short]))
    assert rows.count() == 2 and len(rows.collect()) == 2
    cached = rows.cache()
    try:
        assert cached.filter(F.col("state") == "enabled").count() == 1
    finally:
        cached.unpersist()
    rows.write.parquet(tmp_table_dir)
    paused = spark.read.parquet(tmp_table_dir).filter(F.col("state") == "paused").first()
    assert paused.keyword == "Blue" and paused.quota_impression is None
    with pytest.raises(PySparkException):
        TX.parse_keyword_lines(lines_df(spark, ["c2;a2;;Blue;;enabled;"])).collect()
    with pytest.raises(PySparkException):
        TX.parse_keyword_lines(lines_df(spark, ["c2;a2;;Blue"])).collect()


def test_records_of_separators_only_have_no_field(spark):
    prof = TX.field_count_profile(lines_df(spark, [";;;", ";", "", "a;", ";a"]), ";")
    assert {r.n_fields: r.n_lines for r in prof.collect()} == {0: 2, 1: 2, 2: 1}


def test_percentile_names_differ(spark):
    t0 = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(1, "a", t0, float(v), "ok", "x") for v in range(50)],
                                "visitor_id long, search_text string, ts timestamp_ntz, latency_ms double, "
                                "status string, content string")
    cols = RQ.latency_summary(log, (0.07, 0.5, 0.99, 0.999, 0.9999)).columns[4:]
    assert cols == ["p7_ms", "p50_ms", "p99_ms", "p99_9_ms", "p99_99_ms"]


def test_a_saved_model_replaces_the_older_one(spark, tmp_table_dir):
    df = spark.createDataFrame([(float(i),) for i in range(30)], "n double")
    for first, second in ((3, 1), (1, 3), (3, 2)):
        C.save_model(C.fit_kmeans(df, first, C.ONE_D), tmp_table_dir, spark)
        C.save_model(C.fit_kmeans(df, second, C.ONE_D), tmp_table_dir, spark)
        assert C.load_model(spark, tmp_table_dir).k == second
    with pytest.raises(PySparkException):
        C.load_model(spark, tmp_table_dir + "/nothing-here")


def test_rates_are_not_constant(spark):
    rates = {r.rate_per_sec for r in RQ.throughput(TB.request_log(spark, "/root/testdata/sf0.01"), 1).collect()}
    assert len(rates) > 1 and min(rates) >= 1


@pytest.mark.parametrize("values", [
    np.random.default_rng(0).lognormal(3, 2, 20_000),           # all distinct
    np.repeat([1.0, 2.0, 3.0], [9000, 1, 9000]),                # ties across the middle
    np.concatenate([np.full(15_000, 7.0), np.arange(300.0)]),   # one hot value
    np.array([5.0]), np.array([1.0, 2.0])])
def test_exact_quantiles(spark, monkeypatch, values):
    monkeypatch.setattr(RQ, "BRACKET_ROWS", 50)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(4)
    probs = [0.0, 0.01, 0.5, 0.95, 0.999, 1.0]
    got = RQ.exact_quantiles(df, "x", probs)
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(values, p)), rel=1e-12, abs=1e-12)
    assert RQ.exact_quantiles(df.limit(0), "x", [0.5]) == {0.5: None}


def _hinted(df):
    return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()


def test_broadcast_is_bounded_by_bytes(spark):
    few = spark.createDataFrame([("k" * 40_000, 1), ("x", 2)], "keyword string, id int")
    assert not _hinted(S.checked_broadcast(few, max_bytes=30_000))
    assert _hinted(S.checked_broadcast(few, max_bytes=50_000))


def test_staged_tables_go_at_the_end(spark):
    from adlens.plans import flows
    with S.staging(spark) as paths:
        rows = flows.campaign_training_rows(
            TB.keyword_rows(spark, SF_SMALL), TB.history_rows(spark, SF_SMALL), C.fixed_centres_2d(36), C.TWO_D, 36)
        assert rows.count() > 0
        local = [p.removeprefix("file:") for p in paths]
        assert local and all(os.path.isdir(p) for p in local)
    assert not any(os.path.exists(p) for p in local)


def test_a_local_folder_is_refused_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return "file:/tmp/here"

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        S.ensure_checkpoint_dir(Session())


def test_a_shared_file_folder_is_used_on_a_cluster(spark, monkeypatch):
    """A ``file:`` folder that all machines mount holds what executors write; another one is still refused."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:7077")
    kw = spark.createDataFrame([("01", "a1", "red shoes", "enabled", 4.0), ("01", "a1", "Red Shoes", "enabled", 2.0)],
                               "client_id string, account_id string, keyword string, state string, quota_impression double")
    assert [tuple(r) for r in FT.campaign_avg_of_avg(kw).collect()] == [("01", "a1", 1.5)]
    assert S._held[spark.sparkContext.applicationId, S.ensure_checkpoint_dir(spark)]
    monkeypatch.setattr(spark.sparkContext, "getCheckpointDir", lambda: "file:/proc/no-such-folder")
    with pytest.raises(RuntimeError):
        S.staging_path(spark, "lost")


def test_a_folder_that_executors_do_not_share_is_refused_on_a_local_cluster(spark, monkeypatch):
    """Rows written there would be missing from later reads."""
    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[3,2,3000]")
    assert S.ensure_checkpoint_dir(spark).startswith("file:")
    monkeypatch.setattr(S, "_holds_all", lambda spark, folder: False)
    with pytest.raises(RuntimeError):
        S.staging_path(spark, "lost")


@pytest.mark.parametrize("kind", ["spark://somewhere:7077", "local-cluster[3,2,3000]"])
def test_an_unset_folder_lies_in_the_warehouse_on_any_cluster(kind):
    class Context:
        master, folder = kind, None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        sparkContext, conf = Context(), {"spark.sql.warehouse.dir": "hdfs://somewhere/tables"}

    assert S.ensure_checkpoint_dir(Session()) == "hdfs://somewhere/tables/adlens-checkpoints"


def test_an_unset_folder_lies_in_the_warehouse_on_a_cluster():
    class Context:
        master, folder = "spark://somewhere:7077", None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        sparkContext, conf = Context(), {"spark.sql.warehouse.dir": "hdfs://somewhere/tables"}

    assert S.ensure_checkpoint_dir(Session()) == "hdfs://somewhere/tables/adlens-checkpoints"


def test_gram_statistics(spark):
    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((200, 5)), rng.standard_normal(200)
    cols = [f"x{i}" for i in range(5)]
    df = spark.createDataFrame([(float(b), *map(float, a)) for a, b in zip(x, y)], ["label", *cols])
    xtx, xty, n = R.gram_statistics(df, cols)
    assert n == 200 and np.allclose(xtx, x.T @ x, rtol=1e-12) and np.allclose(xty, x.T @ y, rtol=1e-12)
    xtx, xty, n = R.gram_statistics(df.limit(0), cols)
    assert n == 0 and not xtx.any() and not xty.any()
