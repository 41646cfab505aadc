import datetime as dt
import random

import pytest

from adlens.operators import sketches as SK
from adlens.session import staging_path

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "visitor_id long, ts timestamp_ntz, latency_ms double, status string"


def log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def requests(n, seed=3):
    """Three days, skewed latencies, a value that a third of the requests have, some failed ones."""
    rng = random.Random(seed)
    return [(i, T0 + dt.timedelta(seconds=rng.randrange(3 * 86400)), 7.0 if i % 3 == 0 else rng.expovariate(0.01),
             "error" if i % 50 == 0 else "ok") for i in range(n)]


def test_merged_ranks_are_within_the_bound(spark):
    df = log(spark, requests(30_000)).cache()  # more than a sketch holds
    states = SK.latency_states(df, 3600).cache()
    assert states.count() == 72
    for width, spans in ((86400, 3), (None, 1)):
        merged = SK.report(SK.merge_states(states, width), (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)).cache()
        out = SK.within_rank_error(df, merged, width, (0.25, 0.5, 0.9, 0.99)).collect()
        assert len(out) == spans
        assert all(r[f"{p}_ms_within"] for r in out for p in ("p25", "p50", "p90", "p99"))
        assert all(r.p0_ms == r.min_ms and r.p100_ms == r.max_ms for r in out)
    # a wrong value is found out
    from pyspark.sql import functions as F
    wrong = SK.report(SK.merge_states(states)).withColumn("p95_ms", F.col("p95_ms") * 2)
    r = SK.within_rank_error(df, wrong, None).first()
    assert r.p50_ms_within and not r.p95_ms_within


def test_sketches_are_small(spark):
    one = SK.merge_states(SK.latency_states(log(spark, requests(30_000)), 3600)).first()
    assert one.requests == 29_400 and len(one.sketch) < 100_000 < 8 * one.requests


def test_log_of_batches(spark):
    rows = requests(3000)
    kept = SK.LatencyLog(spark, staging_path(spark, "latency-test"), 3600, zone="timestamp_ntz")
    assert kept.report().collect() == [] and kept.report(86400).collect() == []
    for i in (0, 1, 1, 2, 0):  # batches given again count once, late ones join their windows
        kept.add(f"b{i}", log(spark, rows[i::3]))
    whole = SK.report(SK.merge_states(SK.latency_states(log(spark, rows), 3600), 86400))
    got, want = (sorted((r.window_start, r.window_end, r.requests, r.min_ms, r.max_ms, round(r.mean_ms, 9)) for r in d.collect())
                 for d in (kept.report(86400), whole))
    assert got == want
    with pytest.raises(ValueError):
        kept.report(5400)


def test_odd_rows(spark):
    rows = [(1, T0, None, "ok"), (2, T0, None, "ok"), (3, None, 5.0, "ok"), (4, T0 + dt.timedelta(hours=2), 5.0, "ok"), (5, T0, 9.0, "error")]
    df = log(spark, rows)
    out = {r.window_start: r for r in SK.report(SK.latency_states(df, 3600)).collect()}
    assert out[T0].requests == 2 and out[T0].p50_ms is None and out[T0].mean_ms is None
    assert out[T0 + dt.timedelta(hours=2)].p50_ms == 5.0
    all_ = SK.report(SK.merge_states(SK.latency_states(df, 3600))).first()
    assert (all_.requests, all_.p50_ms, all_.window_start, all_.window_end) == (3, 5.0, T0, T0 + dt.timedelta(hours=3))
    assert SK.latency_states(df.limit(0)).count() == 0
