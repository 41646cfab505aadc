"""Statistics of a growing folder, the live response log and counters of the scan."""

import pytest
from pyspark.sql import Observation

from adlens.operators import keywords as K
from adlens.sources import incremental as IN
from adlens.sources import text as TX
from adlens.sources.runlog import RunLog
from adlens.streaming import responses as SR
from adlens.streaming import throughput as ST
from conftest import keyword_line, lines_df


def write(spark, folder, lines):
    TX.write_lines(lines_df(spark, lines).coalesce(1), folder)
    return IN.list_files(spark, folder)


def stats(df):
    return {r["keyword"]: (r["n"], round(r["avg_qi"], 9)) for r in df.collect()}


def test_increments_equal_the_full_scan(spark, tmp_table_dir):
    kept = IN.IncrementalKeywordStats(spark, f"{tmp_table_dir}/kept")
    assert kept.stats().collect() == [] and kept.update([]) == 0
    days = [write(spark, f"{tmp_table_dir}/day{d}", [keyword_line(keyword=f"Word {i % 5}", qi=str(i + d), state="enabled" if i % 4 else "paused")
                                                    for i in range(10 * d + 3)]) for d in range(3)]
    assert kept.update(days[0]) == 1 and kept.update(days[0]) == 0
    assert kept.update(days[1] + days[0] + days[1]) == 1
    again = IN.IncrementalKeywordStats(spark, f"{tmp_table_dir}/kept")  # another run
    assert again.update(days[0] + days[2]) == 1
    whole = K.keyword_stats(TX.read_keyword_rows(spark, [f for d in days for f in d]))
    assert stats(again.stats()) == stats(whole) and stats(whole)


def test_a_run_that_dies_between_its_commits_counts_nothing(spark, tmp_table_dir, monkeypatch):
    kept = IN.IncrementalKeywordStats(spark, f"{tmp_table_dir}/kept")
    one = write(spark, f"{tmp_table_dir}/one", [keyword_line(qi="3")])
    two = write(spark, f"{tmp_table_dir}/two", [keyword_line(qi="5")])

    def lost(*_, **__):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(kept.files, "append", lost)
        with pytest.raises(RuntimeError):
            kept.update(one)
    assert stats(kept.stats()) == {}
    assert kept.update(one + two) == 2  # other files in the same step this time
    assert stats(kept.stats()) == {"redshoes": (2, 4.0)}


def test_bad_records_leave_nothing(spark, tmp_table_dir):
    kept = IN.IncrementalKeywordStats(spark, f"{tmp_table_dir}/kept")
    bad = write(spark, f"{tmp_table_dir}/bad", [keyword_line(qi="3"), keyword_line(qi="x")])
    with pytest.raises(Exception):
        kept.update(bad)
    assert kept.files.keys() == set() and stats(kept.stats()) == {}


def test_responses_once(spark, tmp_table_dir):
    def arrive(name, ids):
        spark.createDataFrame([(i, f"c{i}") for i in ids], "visitor_id long, content string").coalesce(1).write.parquet(f"{tmp_table_dir}/in/{name}")

    log = RunLog(spark, f"{tmp_table_dir}/log", "visitor_id long, content string")

    def run():
        stream = ST.read_stream(ST.stream_session(spark, 2), f"{tmp_table_dir}/in/*", log.schema, max_files_per_trigger=1)
        SR.run_responses(stream, log, f"{tmp_table_dir}/checkpoint", timeout_seconds=120)

    arrive("a", range(5))
    arrive("b", range(5, 8))
    run()
    first = sorted(tuple(r) for r in log.table().collect())
    assert len(log.keys()) == 2 and [r[2] for r in first] and len(first) == 8
    SR.response_sink(log)(spark.createDataFrame([(r[2], r[3]) for r in first if r[1] == 1], log.schema), 1)  # batch 1 again
    assert sorted(tuple(r) for r in log.table().collect()) == first
    arrive("c", range(8, 10))
    run()  # restart
    assert sorted(r["visitor_id"] for r in log.table().collect()) == list(range(10))


def test_counters_of_the_scan(spark, tmp_table_dir):
    lines = [keyword_line(qi=str(i)) for i in range(7)] + ["a;b;c", "", ";;;", keyword_line(state="paused", qi="") + "x;y"]
    path = f"{tmp_table_dir}/lines"
    TX.write_lines(lines_df(spark, lines), path)
    seen = Observation("quality")
    parsed = TX.parse_keyword_lines(TX.observe_records(TX.read_lines(spark, path), seen), on_bad="quarantine").good
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan
    assert parsed.count() > 0
    profile = {r["n_fields"]: r["n_lines"] for r in TX.field_count_profile(TX.read_lines(spark, path)).collect()}
    assert seen.get == {"records": sum(profile.values()), "short": sum(n for k, n in profile.items() if k < 16),
                        "fewest_fields": min(profile), "most_fields": max(profile)}
