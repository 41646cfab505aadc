import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from adlens.session import local_session
    s = local_session("*", 8)
    yield s


@pytest.fixture()
def tmp_table_dir(spark):
    from adlens.session import staging_path
    return staging_path(spark, "test")


def keyword_line(client="c1", account="a1", keyword="red shoes", state="enabled", qi="10",
                 width=16):
    fields = [""] * width
    fields[0], fields[1], fields[3], fields[5] = client, account, keyword, state
    if width > 15:
        fields[15] = qi
    return ";".join(fields)


def history_line(account="a1", client="c-1", impression="100", qi="5", max_cpc="0.5"):
    fields = ["x"] * 13
    fields[0], fields[1], fields[3], fields[8], fields[12] = account, client, impression, qi, max_cpc
    return ",".join(fields)


def lines_df(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")
