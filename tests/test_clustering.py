import pytest
from pyspark.ml.clustering import KMeansModel

from adlens.operators import clustering as C
from adlens.operators import features as FT


def stats_df(spark, pts):
    return spark.createDataFrame([(f"k{i}", float(a), float(b)) for i, (a, b) in enumerate(pts)],
                                 "keyword string, n double, avg_qi double")


def test_k1_is_the_mean(spark):
    df = stats_df(spark, [(1, 2), (3, 4), (8, 0)])
    c = C.fit_kmeans(df, 1, C.TWO_D)
    assert c.centres == [(4.0, 2.0)]
    assert C.dispersion(df, c, C.TWO_D).first().dispersion == pytest.approx((3 + 1 + 4) / 3)


def test_fewer_centres_than_k_keeps_k_columns(spark):
    pts = [(i, 0) for i in range(7)] * 3
    df = stats_df(spark, pts)
    c = C.fit_kmeans(df, 20, C.ONE_D, seed=1)
    assert c.k <= 7
    labelled = C.assign_to_centres(df, c, C.ONE_D).selectExpr(
        "'c' as client_id", "'a' as account_id", "cluster_id", "1L as n")
    h = FT.cluster_histogram(labelled, 20)
    assert len(h.columns) == 22


def test_expression_assignment_equals_model_transform(spark):
    pts = [(i * 7 % 50, (i * 13) % 17) for i in range(60)]
    df = stats_df(spark, pts)
    c = C.fit_kmeans(df, 5, C.TWO_D, seed=3)
    assert isinstance(c.model, KMeansModel)
    a = {r.keyword: r.cluster_id for r in C.assign_to_centres(df, c, C.TWO_D).collect()}
    b = {r.keyword: r.cluster_id for r in C.assign_clusters(df, c.model, C.TWO_D).collect()}
    assert a == b
    assert C.default_cluster(c.model) == C.default_cluster(C.ClusterCentres(c.centres))


def test_default_cluster_is_zero_vector_prediction(spark):
    c = C.fixed_centres_2d(36)
    assert C.default_cluster(c) == 0
    df = spark.range(1)
    assert df.select(c.default_cluster().alias("d")).first().d == 0


def test_save_load_same_predictions(spark, tmp_table_dir):
    df = stats_df(spark, [(i, i % 5) for i in range(40)])
    c = C.fit_kmeans(df, 4, C.TWO_D, seed=7)
    C.save_model(c, tmp_table_dir + "/km")
    back = C.load_model(spark, tmp_table_dir + "/km")
    assert back.centres == c.centres
    c1 = C.fit_kmeans(df, 1, C.TWO_D)
    C.save_model(c1, tmp_table_dir + "/k1", spark)
    assert C.load_model(spark, tmp_table_dir + "/k1").centres == c1.centres


def test_sweep_and_select_best(spark):
    df = stats_df(spark, [(i, 0) for i in range(30)])
    metrics, fits = C.sweep_k(df, [1, 3, 6], C.ONE_D, seed=1, parallelism=2)
    rows = {r.k: r for r in metrics.collect()}
    assert set(rows) == {1, 3, 6} and rows[1].dispersion == pytest.approx(7.5)
    assert rows[6].dispersion < rows[1].dispersion
    best = C.select_best(metrics, "dispersion").first()
    assert best.dispersion == min(r.dispersion for r in rows.values())


def test_scale_conf_sizes_partitions():
    from adlens.session import scale_conf
    conf = scale_conf(100e12, 8000)
    assert int(conf["spark.sql.shuffle.partitions"]) > 16000
    assert conf["spark.sql.adaptive.skewJoin.enabled"] == "true"
    small = scale_conf(1e9, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16


def test_keyword_clustering_flow(spark):
    from adlens.plans import flows
    from adlens.sources.tables import keyword_rows
    from conftest import SF_SMALL
    metrics, fits = flows.keyword_clustering(keyword_rows(spark, SF_SMALL), [1, 6], C.TWO_D, max_iter=5)
    rows = {r.k: r for r in metrics.collect()}
    assert set(rows) == {1, 6} and fits[6].k <= 6 and fits[1].k == 1
    assert rows[1].dispersion == pytest.approx(15.143333, abs=1e-5)   # FIXTURES: K=1 at sf0.001


def test_members_report_finds_out_wrong_centres(spark):
    stats = spark.createDataFrame([(float(n), float(q)) for n, q in [(1, 1), (3, 1), (100, 5), (104, 7), (108, 9)]], "n double, avg_qi double")
    good = C.ClusterCentres([(2.0, 1.0), (104.0, 7.0)])
    r = C.members_report(stats, good, C.TWO_D).first()
    assert (r.members, r.clusters, r.drift, r.cost, r.dispersion) == (5, 2, 0.0, 2.0 + 32 + 8, 2.0)
    moved = C.members_report(stats, C.ClusterCentres([(2.0, 1.0), (104.0, 7.7)]), C.TWO_D).first()
    assert moved.drift > 0.05 and moved.cost > r.cost
    fit = C.fit_kmeans(stats, 2, C.TWO_D)
    m = C.members_report(stats, fit, C.TWO_D).first()
    assert m.drift < 1e-9 and abs(m.cost - fit.model.summary.trainingCost) < 1e-6
