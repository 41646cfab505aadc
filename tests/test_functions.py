import pytest

from adlens.functions import text as T
from adlens.functions import vectors as V


def test_nearest_centre_ties_go_to_lower_id(spark):
    df = spark.createDataFrame([(5.0,), (0.0,), (10.0,), (7.6,)], "x double")
    got = [r.c for r in df.select(V.nearest_centre(["x"], [(0.0,), (10.0,), (5.0,)]).alias("c")).collect()]
    assert got == [2, 0, 1, 1]
    tie = spark.createDataFrame([(5.0,)], "x double")
    assert tie.select(V.nearest_centre(["x"], [(0.0,), (10.0,)]).alias("c")).first().c == 0


def test_centre_coordinate_and_dimension_check(spark):
    df = spark.createDataFrame([(1,), (0,)], "cid int")
    got = [r.v for r in df.select(V.centre_coordinate("cid", [(1.0, 2.0), (3.0, 4.0)], 1).alias("v")).collect()]
    assert got == [4.0, 2.0]
    with pytest.raises(ValueError):
        V.squared_distance(["a", "b"], [1.0])


def test_text_helpers(spark):
    df = spark.createDataFrame([("Big  Red\tHat", "0-12-3")], "k string, c string")
    r = df.select(T.normalize_keyword("k").alias("n"), T.lookup_key("k", "reference").alias("r"),
                  T.lookup_key("k", "normalized").alias("z"), T.strip_dashes("c").alias("d"),
                  T.campaign_key("c", "k").alias("key")).first()
    assert (r.n, r.r, r.z, r.d) == ("bigred\that", "BigRed\tHat", "bigred\that", "0123")
    assert r.key == "0-12-3_Big  Red\tHat"
    with pytest.raises(ValueError):
        T.lookup_key("k", "other")


def test_strict_double(spark):
    df = spark.createDataFrame([("1.5",), (None,), (" 2 ",), ("NaN",)], "s string")
    got = [r.v for r in df.select(T.strict_double("s").alias("v")).collect()]
    assert got[0] == 1.5 and got[1] is None and got[2] == 2.0 and got[3] != got[3]
