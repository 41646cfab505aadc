"""A log of grid results that is resumed, and never doubled by a retry."""

import pytest

from adlens.sources.runlog import RunLog

SCHEMA = "num_trees int, mse double"


def rows(spark, *values):
    return spark.createDataFrame(list(values), "num_trees long, mse double")


def read(log):
    return sorted(tuple(r) for r in log.table().collect())


def test_resume(spark, tmp_table_dir):
    made = []

    def make(p):
        made.append(p)
        return rows(spark, (p, p / 2), (p + 1, p / 4))

    points = {f"p{i}": 10 * i for i in range(5)}
    log = RunLog(spark, tmp_table_dir, SCHEMA)
    assert read(log) == [] and log.keys() == set()
    assert log.run(points, make, stop_after=2) == 2
    first = read(log)
    again = RunLog(spark, tmp_table_dir, SCHEMA)  # another run, another object
    assert again.run(points, make) == 3 and again.run(points, make) == 0
    assert made == [0, 10, 20, 30, 40]
    assert read(again) == sorted((f"p{i}", i, n, m) for i in range(5) for n, m in ((10 * i, 5.0 * i), (10 * i + 1, 2.5 * i)))
    assert set(first) <= set(read(again))


def test_failure_and_retry(spark, tmp_table_dir):
    log = RunLog(spark, tmp_table_dir, SCHEMA)

    def broken(p):
        if p == 2:
            raise RuntimeError("executor lost")
        return rows(spark, (p, 1.0))

    with pytest.raises(RuntimeError):
        log.run({"a": 1, "b": 2, "c": 3}, broken)
    assert log.keys() == {"a"}
    assert log.run({"a": 1, "b": 2, "c": 3}, lambda p: rows(spark, (p, 2.0))) == 2
    assert read(log) == [("a", 0, 1, 1.0), ("b", 1, 2, 2.0), ("c", 2, 3, 2.0)]
    log.append("b", rows(spark, (2, 5.0)), 1)  # the same key again replaces its rows
    assert read(log) == [("a", 0, 1, 1.0), ("b", 1, 2, 5.0), ("c", 2, 3, 2.0)]


def test_half_written_entries_do_not_count(spark, tmp_table_dir):
    log = RunLog(spark, tmp_table_dir, SCHEMA)
    log.append("whole", rows(spark, (1, 1.0)))
    rows(spark, (2, 2.0)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{tmp_table_dir}/entry=half")
    assert log.keys() == {"whole"} and read(log) == [("whole", 0, 1, 1.0)]
    assert log.run({"half": 2}, lambda p: rows(spark, (p, 3.0))) == 1
    assert len(read(log)) == 2


def test_keys_are_folder_names(spark, tmp_table_dir):
    with pytest.raises(ValueError):
        RunLog(spark, tmp_table_dir, SCHEMA).append("a/b", rows(spark, (1, 1.0)))
