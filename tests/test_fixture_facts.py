"""The facts FIXTURES.md tabulates for the test tables, recomputed with the engine."""

import pytest
from pyspark.sql import functions as F

from adlens.functions.text import lookup_key
from adlens.operators import clustering as C
from adlens.operators import keywords as K
from adlens.operators import tree_model as TM
from adlens.plans import catalog as CT
from adlens.sources import tables as TB

FACTS = {
    "0.001": dict(rows=6000, enabled=4032, distinct=120, campaigns=70, history=490, training=420,
                  miss_ref=2062, ab=150, hours=531, used=(5, 10),
                  disp=(6.183333, 20.175, 15.143333)),
    "0.01": dict(rows=60000, enabled=39954, distinct=214, campaigns=700, history=4900, training=4200,
                 miss_ref=20406, ab=1500, hours=720, used=(20, 18),
                 disp=(6.369159, 25.518692, 80.236615)),
}


@pytest.mark.parametrize("sf", sorted(FACTS))
def test_fixture_facts(spark, sf):
    want = FACTS[sf]
    d = f"/root/testdata/sf{sf}"
    kw = TB.keyword_rows(spark, d)
    en = K.enabled_keywords(kw)
    stats = K.keyword_stats(kw)
    keys = stats.select(F.col("keyword").alias("k"))
    assert kw.count() == want["rows"] and en.count() == want["enabled"]
    assert stats.count() == want["distinct"]
    assert en.select("client_id", "account_id").distinct().count() == want["campaigns"]
    assert TB.history_rows(spark, d).count() == want["history"]
    assert CT._training(spark, d, CT.centres_2d(), 36, C.TWO_D).count() == want["training"]
    for case, misses in (("reference", want["miss_ref"]), ("normalized", 0)):
        got = en.select(lookup_key("keyword", case).alias("k")).join(keys, "k", "left_anti").count()
        assert got == misses
    assert TM.join_on_id(TB.a_ml(spark, d), TB.b_ml(spark, d)).count() == want["ab"]
    assert TB.table(spark, d, "events").select(F.date_trunc("hour", "ts")).distinct().count() == want["hours"]
    c1, c2 = CT.centres_1d(), CT.centres_2d()
    used = stats.agg(F.countDistinct(c1.assign(C.ONE_D)), F.countDistinct(c2.assign(C.TWO_D))).first()
    assert tuple(used) == want["used"]
    d1 = C.dispersion(stats, c1, C.ONE_D).first()[0]
    d2 = C.dispersion(stats, c2, C.TWO_D).first()[0]
    dk1 = C.dispersion(stats, C.fit_kmeans(stats, 1, C.ONE_D), C.ONE_D).first()[0]
    assert (round(d1, 6), round(d2, 6), round(dk1, 6)) == want["disp"]


def test_top_keywords_at_sf001(spark):
    top = K.top_keywords(K.keyword_counts(TB.keyword_rows(spark, "/root/testdata/sf0.01")), 3).collect()
    assert [(r.keyword, r.n) for r in top] == [("largebolt", 493), ("redplate", 477), ("smallwidget", 477)]
