"""Property tests: engine results against plain-Python brute force on random inputs."""

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from adlens.operators import clustering as C
from adlens.operators import features as FT
from adlens.operators import requests as RQ

KW_SCHEMA = "client_id string, account_id string, keyword string, state string, quota_impression double"

words = st.sampled_from(["red shoe", "Red Shoe", "blue hat", "BlueHat", "x", "big  bag", "Big Bag"])
rows_st = st.lists(
    st.tuples(st.sampled_from(["1", "2", "3"]), st.sampled_from(["a", "b"]), words,
              st.sampled_from(["enabled", "enabled", "paused"]), st.integers(0, 60).map(float)),
    min_size=1, max_size=40)


@settings(max_examples=15, deadline=None)
@given(rows_st, st.sampled_from(["reference", "normalized"]))
def test_histogram_matches_brute_force(spark, data, lookup_case):
    centres = C.ClusterCentres([(0.0, 0.0), (3.0, 20.0), (8.0, 40.0), (1.0, 55.0)])
    got = {(r.client_id, r.account_id): tuple(r[f"k{i}"] for i in range(4))
           for r in FT.campaign_cluster_features(spark.createDataFrame(data, KW_SCHEMA), centres, 4,
                                                 lookup_case=lookup_case, share=False).collect()}
    enabled = [d for d in data if d[3] == "enabled"]
    cnt, tot = Counter(), Counter()
    for d in enabled:
        k = d[2].lower().replace(" ", "")
        cnt[k] += 1
        tot[k] += d[4]
    label = {k: centres.predict((cnt[k], tot[k] / cnt[k])) for k in cnt}
    default = centres.predict((0.0, 0.0))
    want = {}
    for d in enabled:
        key = d[2].replace(" ", "") if lookup_case == "reference" else d[2].lower().replace(" ", "")
        h = want.setdefault((d[0], d[1]), [0] * 4)
        h[label.get(key, default)] += 1
    assert got == {k: tuple(v) for k, v in want.items()}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-5, 30).map(float), min_size=1, max_size=80),
       st.lists(st.floats(0, 1), min_size=1, max_size=4))
def test_exact_quantiles_match_numpy(spark, values, probs):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    got = RQ.exact_quantiles(df, "x", probs)
    for p in probs:
        assert abs(got[p] - float(np.quantile(values, p))) < 1e-9


field_st = st.sampled_from(["", "a", "enabled", "paused", "12", "3.5", "x y", "NaN", "abc"])
line_st = st.lists(field_st, min_size=0, max_size=18).map(lambda fs: ";".join(fs))


@settings(max_examples=25, deadline=None)
@given(st.lists(line_st, min_size=1, max_size=12))
def test_fail_mode_raises_exactly_when_quarantine_finds_bad_lines(spark, lines):
    from pyspark.errors import PySparkException

    from adlens.operators import keywords as K
    from adlens.sources import text as TX
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    good, bad = TX.parse_keyword_lines(df, on_bad="quarantine")
    n_good, n_bad = good.count(), bad.count()
    assert n_good + n_bad == len(lines)
    try:
        K.keyword_means(TX.parse_keyword_lines(df)).collect()
        raised = False
    except PySparkException:
        raised = True
    assert raised == (n_bad > 0)
