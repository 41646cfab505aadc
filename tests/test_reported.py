"""Windows from the previous report against the sequential rule."""

import datetime as dt
import random

import numpy as np
import pytest

from adlens.operators import reported as RP

START = dt.datetime(2024, 1, 1)


def plain(micros, width):
    """(start, end, requests, rate) by walking the requests one after the other."""
    out, since, n = [], None, 0
    for t in sorted(micros):
        since = t if since is None else since
        n += 1
        if t - since >= width:
            out.append((since, t, n, n * 1_000_000 // (t - since)))
            since, n = t, 0
    return out


def run(spark, micros, width_seconds, piece_events=16_384, failed=(), ntz=True, parts=3):
    rows = [(START + dt.timedelta(microseconds=t), "ok") for t in micros] + [(START + dt.timedelta(microseconds=t), "error") for t in failed]
    df = spark.createDataFrame(rows, f"ts {'timestamp_ntz' if ntz else 'timestamp'}, status string").repartition(parts)
    out = RP.throughput_reported(df, width_seconds, piece_events=piece_events)
    assert out.schema["window_start"].dataType == df.schema["ts"].dataType
    us = lambda x: round((x - START) / dt.timedelta(microseconds=1))
    return sorted((us(r[0]), us(r[1]), r[2], r[3]) for r in out.collect())


@pytest.mark.parametrize("seed,piece", [(1, 5), (2, 40), (3, 16_384)])
def test_random_logs(spark, seed, piece):
    rnd = random.Random(seed)
    t, micros = 0, []
    for _ in range(600):  # bursts, ties and long gaps
        t += rnd.choice([0, 0, 1, 1000, 30_000, 400_000, 999_999, 1_000_000, 90_000_000])
        micros.append(t)
    assert run(spark, micros, 1, piece) == plain(micros, 1_000_000)


def test_many_levels(spark):
    """More than FANOUT * FANOUT pieces."""
    micros = [i * 700_000 for i in range(5000)]
    assert run(spark, micros, 1, 1) == plain(micros, 1_000_000)


def test_edges(spark):
    assert run(spark, [], 1) == []
    assert run(spark, [5], 1) == []
    assert run(spark, [0, 999_999], 1) == []
    assert run(spark, [0, 1_000_000], 1) == [(0, 1_000_000, 2, 2)]
    # of requests at one time the first reports, the others belong to the next window
    assert run(spark, [0, 1_000_000, 1_000_000, 1_000_000, 2_500_000], 1) == [(0, 1_000_000, 2, 2), (1_000_000, 2_500_000, 3, 2)]
    # failures neither count nor report; the clock starts at the first success
    assert run(spark, [10, 1_500_000], 1, failed=[0, 1_200_000, 9_000_000]) == [(10, 1_500_000, 2, 1)]


def test_timestamps_with_a_zone(spark):
    micros = [0, 400_000, 1_100_000, 3_000_000]
    assert len(run(spark, micros, 1, ntz=False)) == len(plain(micros, 1_000_000))


def test_maps_compose():
    """The map of two pieces is the maps one after the other, from every entry."""
    rng = np.random.default_rng(4)
    for _ in range(50):
        ts = np.unique(rng.integers(0, 400, 60))
        n = rng.integers(1, 4, len(ts))
        cut = ts < 200
        pieces = [RP.piece_map(ts[s], n[s], 30, b) for s, b in ((cut, 0), (~cut, 200)) if s.any()]
        whole = RP.piece_map(ts, n, 30, 0)
        assert RP.compose(pieces, 30, 0) == whole


def test_no_single_task_window(spark):
    df = spark.createDataFrame([(START, "ok")], "ts timestamp_ntz, status string")
    plan = RP.throughput_reported(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
