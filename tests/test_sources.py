import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from adlens.operators import keywords as K
from adlens.sources import text as TX
from conftest import history_line, keyword_line, lines_df


def test_parse_keyword_fields(spark):
    df = TX.parse_keyword_lines(lines_df(spark, [keyword_line(keyword="Red Shoes", qi="12.5")]))
    r = df.first()
    assert (r.client_id, r.account_id, r.keyword, r.state, r.quota_impression) == (
        "c1", "a1", "Red Shoes", "enabled", "12.5")


def test_bad_number_on_paused_row_does_not_fail(spark):
    rows = TX.parse_keyword_lines(lines_df(spark, [
        keyword_line(state="paused", qi="abc"), keyword_line(qi="3")]))
    assert K.keyword_means(rows).first().avg_qi == 3.0


def test_bad_number_on_enabled_row_fails(spark):
    rows = TX.parse_keyword_lines(lines_df(spark, [keyword_line(qi="abc")]))
    with pytest.raises(PySparkException):
        K.keyword_means(rows).collect()


def test_short_line_fails(spark):
    rows = TX.parse_keyword_lines(lines_df(spark, ["a;b;c;d"]))
    with pytest.raises(PySparkException):
        K.keyword_counts(rows).collect()


def test_trailing_empty_field_fails(spark):
    # 15 fields then ';' -> the 16th field is empty and last: it does not exist
    line = keyword_line(qi="")
    assert line.endswith(";")
    rows = TX.parse_keyword_lines(lines_df(spark, [line]))
    with pytest.raises(PySparkException):
        K.keyword_means(rows).collect()


def test_empty_state_is_not_dropped_quietly(spark):
    rows = TX.parse_keyword_lines(lines_df(spark, ["a;b;c;d;;"]))
    with pytest.raises(PySparkException):
        K.keyword_counts(rows).collect()


def test_quarantine_splits_bad_rows(spark):
    lines = [keyword_line(qi="abc"), "a;b;c;d", keyword_line(qi="7"), keyword_line(qi=""),
             "a;b;c;d;;", keyword_line(state="paused", qi="zz")]
    good, bad = TX.parse_keyword_lines(lines_df(spark, lines), on_bad="quarantine")
    assert good.count() == 2
    assert bad.count() == 4
    assert K.keyword_means(good).first().avg_qi == 7.0


def test_quotes_are_plain_characters(spark):
    line = keyword_line(keyword='"q;z"')  # the separator inside quotes still separates
    rows = TX.parse_keyword_lines(lines_df(spark, [line + ";extra"]))
    assert rows.first().keyword == '"q'


def test_only_blank_u0020_is_removed(spark):
    rows = TX.parse_keyword_lines(lines_df(spark, [keyword_line(keyword="A b\tC")]))
    assert K.keyword_counts(rows).first().keyword == "ab\tc"


def test_history_exclusion_happens_before_parsing(spark):
    lines = [history_line(account="bad", impression="oops"), history_line()]
    rows = TX.parse_history_lines(lines_df(spark, lines), excluded_accounts=["bad"])
    from adlens.operators.features import campaign_history
    h = campaign_history(rows).collect()
    assert len(h) == 1 and h[0].client_id == "c1" and h[0].impression == 100.0


def test_history_short_line_fails(spark):
    rows = TX.parse_history_lines(lines_df(spark, ["a1,c-1,x,5"]))
    with pytest.raises(PySparkException):
        rows.collect()


def test_field_count_profile_uses_jvm_counting(spark):
    prof = TX.field_count_profile(lines_df(spark, ["a;b;c", "a;b;;", "a;;b", ""]), ";")
    got = {r.n_fields: r.n_lines for r in prof.collect()}
    assert got == {3: 2, 2: 1, 1: 1}


def test_text_roundtrip_through_files(spark, tmp_table_dir):
    src = spark.createDataFrame(
        [("c1", "a1", "red shoes", "enabled", 3.0), ("c2", "a2", "Blue Hat", "paused", 4.5)],
        "client_id string, account_id string, keyword string, state string, quota_impression double")
    TX.write_lines(TX.format_keyword_lines(src), tmp_table_dir)
    back = TX.read_keyword_rows(spark, tmp_table_dir).withColumn(
        "quota_impression", F.col("quota_impression").cast("double"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, src.collect()))


def test_read_table_and_append_metrics(spark, tmp_table_dir):
    spark.createDataFrame([(1, 2.0)], "id long, age double").createOrReplaceTempView("t_scan")
    assert TX.read_table(spark, "t_scan").first().age == 2.0
    m = spark.createDataFrame([(20, 4, 1.5)], "num_trees int, max_depth int, mse double")
    TX.append_metrics(m, tmp_table_dir)
    TX.append_metrics(m, tmp_table_dir)
    assert spark.read.parquet(tmp_table_dir).count() == 2


def test_bad_number_fails_with_ansi_off(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        rows = TX.parse_keyword_lines(lines_df(spark, [keyword_line(qi="abc")]))
        with pytest.raises(PySparkException):
            K.keyword_means(rows).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


def jvm_split_size(line: str, sep: str) -> int:
    """Python model of java.lang.String.split(sep).length."""
    if line == "":
        return 1
    parts = line.split(sep)
    while parts and parts[-1] == "":
        parts.pop()
    return len(parts)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab; ", max_size=12), min_size=1, max_size=8))
def test_field_count_matches_jvm_split(spark, lines):
    got = [r.n for r in lines_df(spark, lines).select(TX.jvm_field_count(";").alias("n")).collect()]
    assert got == [jvm_split_size(x, ";") for x in lines]


def test_quarantine_equals_fail_mode_on_clean_lines(spark):
    from adlens.sources.tables import keyword_rows
    from conftest import SF_SMALL
    lines = TX.format_keyword_lines(keyword_rows(spark, SF_SMALL))
    strict = TX.parse_keyword_lines(lines)
    good, bad = TX.parse_keyword_lines(lines, on_bad="quarantine")
    assert bad.count() == 0
    assert sorted(map(tuple, strict.collect())) == sorted(map(tuple, good.collect()))
