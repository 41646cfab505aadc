from pyspark.sql import functions as F

from adlens.operators import clustering as C
from adlens.operators import features as FT
from adlens.operators import keywords as K
from adlens.plans import flows

KW_SCHEMA = "client_id string, account_id string, keyword string, state string, quota_impression double"
H_SCHEMA = "account_id string, client_id string, impression double, quota_impression double, max_cpc double"


def kw(spark, rows):
    return spark.createDataFrame(rows, KW_SCHEMA)


def test_mixed_case_misses_in_reference_mode(spark):
    rows = kw(spark, [("1", "a", "Red Shoes", "enabled", 1.0), ("1", "a", "red shoes", "enabled", 3.0)])
    stats = K.keyword_stats(rows)
    assert [(r.keyword, r.n) for r in stats.collect()] == [("redshoes", 2)]
    dictionary = spark.createDataFrame([("redshoes", 5)], "keyword string, cluster_id int")
    ref = FT.label_keywords(rows, dictionary, 9, "reference")
    got = sorted((r.keyword, r.cluster_id) for r in ref.collect())
    assert got == [("Red Shoes", 9), ("red shoes", 5)]
    norm = FT.label_keywords(rows, dictionary, 9, "normalized")
    assert sorted(r.cluster_id for r in norm.collect()) == [5, 5]


def test_crossed_key_and_dash_strip(spark):
    rows = kw(spark, [("1234", "acc1", "x", "enabled", 1.0)])
    hist = spark.createDataFrame([("acc1", "12-34", 10.0, 2.0, 0.5)], H_SCHEMA)
    centres = C.ClusterCentres([(0.0, 0.0), (100.0, 0.0)])
    tr = flows.campaign_training_rows(rows, hist, centres, C.TWO_D, 2).collect()
    assert len(tr) == 1
    r = tr[0]
    assert (r.client_id, r.account_id, r.label, r.impression, r.max_cpc, r.k0, r.k1) == (
        "1234", "acc1", 2.0, 10.0, 0.5, 1, 0)


def test_label_outside_k_counts_nowhere_and_columns_fixed(spark):
    labelled = spark.createDataFrame([("c", "a", 36, 1), ("c", "a", 0, 2), ("c", "a", -1, 1)],
                                     "client_id string, account_id string, cluster_id int, n long")
    h = FT.cluster_histogram(labelled, 36).collect()[0]
    assert h.k0 == 2 and sum(h[f"k{i}"] for i in range(36)) == 2
    assert len(h) == 2 + 36


def test_one_sided_campaigns_drop_and_n_to_one(spark):
    rows = kw(spark, [("1", "a", "x", "enabled", 1.0), ("2", "b", "y", "enabled", 1.0),
                      ("2", "b", "y", "enabled", 1.0)])
    hist = spark.createDataFrame([
        ("a", "1", 1.0, 1.0, 1.0), ("a", "1", 2.0, 2.0, 2.0), ("a", "1", 3.0, 3.0, 3.0),
        ("z", "9", 1.0, 1.0, 1.0)], H_SCHEMA)
    centres = C.fixed_centres_1d(3)
    tr = flows.campaign_training_rows(rows, hist, centres, C.ONE_D, 3).collect()
    assert len(tr) == 3
    assert {(r.client_id, r.account_id) for r in tr} == {("1", "a")}
    assert len({tuple(r[f"k{i}"] for i in range(3)) for r in tr}) == 1


def test_histogram_rows_sum_to_enabled_rows(spark):
    from adlens.sources.tables import keyword_rows
    from conftest import SF_SMALL
    rows = keyword_rows(spark, SF_SMALL)
    h = FT.campaign_cluster_features(rows, C.fixed_centres_2d(36), 36, C.TWO_D)
    total = h.select(sum(F.col(f"k{i}") for i in range(36)).alias("t"), *FT.CAMPAIGN)
    per = K.enabled_keywords(rows).groupBy(*FT.CAMPAIGN).count()
    diff = total.join(per, FT.CAMPAIGN).filter(F.col("t") != F.col("count")).count()
    assert diff == 0
    assert h.count() == per.count()
    assert K.keyword_counts(rows).agg(F.sum("n")).first()[0] == K.enabled_keywords(rows).count()


def test_avg_of_avg_defaults_to_zero(spark):
    rows = kw(spark, [("1", "a", "Big Hat", "enabled", 4.0), ("1", "a", "big hat", "enabled", 8.0)])
    r = FT.campaign_avg_of_avg(rows, "reference").collect()[0]
    assert r.avg_of_avg == (0.0 + 6.0) / 2
    r = FT.campaign_avg_of_avg(rows, "normalized").collect()[0]
    assert r.avg_of_avg == 6.0


def test_histogram_with_a_hot_keyword_equals_brute_force(spark):
    """One keyword holds a third of all rows; compare with a plain-Python count."""
    import random
    from collections import Counter
    rnd = random.Random(3)
    words = ["Hot Key"] * 600 + [f"kw {rnd.randint(0, 40)}" for _ in range(1200)]
    data = [(str(rnd.randint(0, 9)), f"a{rnd.randint(0, 2)}", w,
             "enabled" if rnd.random() < 0.9 else "paused", float(rnd.randint(1, 50))) for w in words]
    rows = kw(spark, data).repartition(6)
    centres = C.fixed_centres_2d(36)
    got = {(r.client_id, r.account_id): tuple(r[f"k{i}"] for i in range(36))
           for r in FT.campaign_cluster_features(rows, centres, 36).collect()}
    enabled = [d for d in data if d[3] == "enabled"]
    cnt, tot = Counter(), Counter()
    for d in enabled:
        key = d[2].lower().replace(" ", "")
        cnt[key] += 1
        tot[key] += d[4]
    label = {k: centres.predict((cnt[k], tot[k] / cnt[k])) for k in cnt}
    default = centres.predict((0.0, 0.0))
    want = {}
    for d in enabled:
        lk = d[2].replace(" ", "")
        lab = label.get(lk, default)
        h = want.setdefault((d[0], d[1]), [0] * 36)
        h[lab] += 1
    assert got == {k: tuple(v) for k, v in want.items()}


def test_shared_pairs_equal_lazy_plan(spark):
    from adlens.sources.tables import keyword_rows
    from conftest import SF_SMALL
    rows = keyword_rows(spark, SF_SMALL)
    c = C.fixed_centres_1d(21)
    shared = FT.campaign_cluster_features(rows, c, 21, C.ONE_D, share=True)
    lazy = FT.campaign_cluster_features(rows, c, 21, C.ONE_D, share=False)
    assert sorted(map(tuple, shared.collect())) == sorted(map(tuple, lazy.collect()))
    a = FT.campaign_avg_of_avg(rows, share=True).collect()
    b = FT.campaign_avg_of_avg(rows, share=False).collect()
    assert {(r.client_id, r.account_id): round(r.avg_of_avg, 9) for r in a} == \
        {(r.client_id, r.account_id): round(r.avg_of_avg, 9) for r in b}


def test_dictionary_join_without_broadcast_equals_broadcast(spark):
    from adlens.sources.tables import keyword_rows
    from conftest import SF_SMALL
    rows = keyword_rows(spark, SF_SMALL)
    c = C.fixed_centres_2d(36)
    d = FT.label_dictionary(K.keyword_stats(rows), c)
    a = FT.label_keywords(rows, d, c.default_cluster(), "reference")
    b = FT.label_keywords(rows, d, c.default_cluster(), "reference", max_broadcast_bytes=0)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan or "BroadcastHashJoin" in plan  # AQE may still pick either


def test_feature_sets_share_one_pairs_table(spark):
    from adlens.plans import flows
    from adlens.sources import tables as TB
    from conftest import SF_SMALL
    kw, hist = TB.keyword_rows(spark, SF_SMALL), TB.history_rows(spark, SF_SMALL)
    pairs = FT.shared_pairs(kw)
    c = C.fixed_centres_2d(36)
    a = flows.campaign_training_rows(kw, hist, c, C.TWO_D, 36, excluded_accounts=["naccount7"], pairs=pairs)
    b = flows.campaign_training_rows(kw, hist, c, C.TWO_D, 36, excluded_accounts=["naccount7"])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    avg = flows.campaign_avg_training_rows(kw, hist, excluded_accounts=["naccount7"], pairs=pairs)
    assert avg.count() == a.count()
