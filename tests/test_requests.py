import datetime as dt

from adlens.operators import requests as RQ
from adlens.sources import tables as TB
from adlens.streaming import throughput as ST
from conftest import SF_SMALL


def log(spark, rows):
    return spark.createDataFrame(rows, "visitor_id long, search_text string, ts timestamp_ntz, "
                                       "latency_ms double, status string, content string")


def test_url_is_form_encoded_and_id_raw(spark):
    df = log(spark, [(7, 'red shoes ~ {"k": 1}*', dt.datetime(2024, 1, 1), 1.0, "ok", "x")])
    url = RQ.request_urls(df, "http://h/q?t=").first().url
    assert url == "http://h/q?t=red+shoes+%7E+%7B%22k%22%3A+1%7D*&id=7"


def test_throughput_counts_successes_per_window(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = [(1, "a", t0 + dt.timedelta(milliseconds=100 * i), 1.0, "ok", "x") for i in range(25)]
    rows.append((1, "a", t0, 1.0, "error", "x"))
    out = {r.window_start: (r.requests, r.rate_per_sec)
           for r in RQ.throughput(log(spark, rows), 1).collect()}
    assert out == {t0: (10, 10), t0 + dt.timedelta(seconds=1): (10, 10),
                   t0 + dt.timedelta(seconds=2): (5, 5)}


def test_latency_summary(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, "a", t0, float(v), "ok", "x") for v in range(1, 101)] + [(1, "a", t0, 1e9, "error", "x")]
    r = RQ.latency_summary(log(spark, rows)).first()
    assert (r.requests, r.min_ms, r.max_ms, r.mean_ms) == (100, 1.0, 100.0, 50.5)
    assert (r.p50_ms, round(r.p95_ms, 9), round(r.p99_ms, 9)) == (50.5, 95.05, 99.01)
    a = RQ.latency_summary(log(spark, rows), exact=False).first()
    assert (a.p50_ms, a.p95_ms, a.p99_ms) == (50.0, 95.0, 99.0)


def test_exact_quantiles_with_a_hot_value(spark):
    import numpy as np
    vals = [7.0] * 500 + [float(v) for v in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(5)
    got = RQ.exact_quantiles(df, "x", [0.0, 0.1, 0.5, 0.9, 1.0])
    for p, v in got.items():
        assert v == float(np.quantile(vals, p))


def test_latency_by_window(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, "a", t0 + dt.timedelta(minutes=i), float(i), "ok", "x") for i in range(120)]
    out = RQ.latency_by_window(log(spark, rows), 3600).orderBy("window_start").collect()
    assert [r.requests for r in out] == [60, 60]
    assert out[0].max_ms == 59.0 and out[1].min_ms == 60.0


def test_stream_equals_batch_on_closed_windows(spark):
    batch = {(r.window_start, r.requests) for r in
             RQ.throughput(TB.request_log(spark, SF_SMALL), 3600).collect()}
    events = TB.table(spark, SF_SMALL, "events")
    stream = ST.read_stream(spark, SF_SMALL, events.schema, glob="events.parquet")
    out = ST.run_available(ST.throughput_stream(TB.request_log_of(stream), 3600, "1 hour"), "t")
    live = {(r.window_start, r.requests) for r in spark.read.parquet(out).collect()}
    assert live and live <= batch
    assert len(batch) - len(live) <= 2


def test_write_responses_appends(spark, tmp_table_dir):
    df = log(spark, [(1, "a", dt.datetime(2024, 1, 1), 1.0, "ok", "hello")])
    RQ.write_responses(df, tmp_table_dir)
    RQ.write_responses(df, tmp_table_dir)
    assert spark.read.parquet(tmp_table_dir).count() == 2


def test_stream_late_rows_and_restart(spark, tmp_table_dir):
    """Three runs over a growing folder with one checkpoint: rows inside the
    watermark still count, a row for an already-closed window is dropped."""
    schema = ("visitor_id long, search_text string, ts timestamp_ntz, latency_ms double, "
              "status string, content string")
    src, out, ck = tmp_table_dir + "/src", tmp_table_dir + "/out", tmp_table_dir + "/ck"

    def at(h, m):
        return dt.datetime(2024, 1, 1, h, m)

    batches = [
        [at(0, 10), at(0, 20), at(1, 30), at(3, 10)],
        [at(0, 30), at(2, 50), at(3, 20)],      # 00:30 is behind the watermark (02:10)
        [at(5, 30)],
    ]
    for i, times in enumerate(batches):
        spark.createDataFrame([(1, "q", t, 1.0, "ok", "x") for t in times], schema) \
            .write.mode("overwrite").parquet(f"{src}/b{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        ST.run_available(ST.throughput_stream(stream, 3600, "1 hour"), "late", out, ck)
    got = {r.window_start: r.requests for r in spark.read.parquet(out).collect()}
    assert got == {at(0, 0): 2, at(1, 0): 1, at(2, 0): 1, at(3, 0): 2}


def test_exact_quantiles_empty_and_nulls(spark):
    empty = spark.createDataFrame([], "x double")
    assert RQ.exact_quantiles(empty, "x", [0.5]) == {0.5: None}
    df = spark.createDataFrame([(None,), (1.0,), (3.0,)], "x double")
    assert RQ.exact_quantiles(df, "x", [0.5, 1.0]) == {0.5: 2.0, 1.0: 3.0}


def test_stream_runs_with_the_scale_conf_state_store(spark, tmp_table_dir):
    from adlens.session import scale_conf
    s = ST.stream_session(spark)
    key = "spark.sql.streaming.stateStore.providerClass"
    s.conf.set(key, scale_conf(1e12, 8)[key])
    events = TB.table(spark, SF_SMALL, "events")
    stream = ST.read_stream(s, SF_SMALL, events.schema, glob="events.parquet")
    out = ST.run_available(ST.throughput_stream(TB.request_log_of(stream)), "rocks",
                           tmp_table_dir + "/out", tmp_table_dir + "/ck", timeout_seconds=300)
    batch = RQ.throughput(TB.request_log(spark, SF_SMALL), 3600).count()
    got = spark.read.parquet(out).count()
    assert 0 < got <= batch and batch - got <= 2
