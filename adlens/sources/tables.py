"""Typed inputs derived from the driver's parquet tables.

The engine's operators take typed frames:

* keyword rows  ``client_id, account_id, keyword, state, quota_impression``
* history rows  ``account_id, client_id, impression, quota_impression, max_cpc``
* ``a_ml(id, age)``, ``b_ml(id, weight, high)``
* request log   ``visitor_id, search_text, ts, latency_ms, status, content``

Production data arrives as text (``sources.text``); the test tables are mapped
onto the same shapes here, as plain projections/joins/aggregates that Catalyst
prunes and pushes down into the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The account whose history rows are excluded in the test data.
EXCLUDED_ACCOUNTS = ("naccount7",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keyword_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One keyword record per line item: supplier = client, line number = account."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    joined = li.join(part, li.l_partkey == part.p_partkey, "inner")
    return joined.select(*_keyword_record(), F.col("l_quantity").alias("quota_impression"))


def _keyword_record() -> list:
    """Campaign, keyword and state of a line item and its part."""
    return [
        F.concat(F.lit("0"), F.col("l_suppkey").cast("string")).alias("client_id"),
        F.concat(F.lit("naccount"), F.col("l_linenumber").cast("string")).alias("account_id"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_name"))
        .otherwise(F.concat(F.col("p_brand"), F.lit(" "), F.col("p_type"))).alias("keyword"),
        F.when(F.col("l_returnflag") == "R", F.lit("paused")).otherwise(F.lit("enabled")).alias("state"),
    ]


def keyword_rows_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword records with ``order_key``: line items in the order of their orders."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return li.join(part, li.l_partkey == part.p_partkey, "inner").select(*_keyword_record(), F.col("l_orderkey").alias("order_key"))


def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign history: one row per (line number, supplier, ship year)."""
    li = table(spark, sf_dir, "lineitem")
    return (
        li.groupBy("l_linenumber", "l_suppkey", F.year("l_shipdate").alias("ship_year"))
        .agg(F.sum("l_quantity").alias("impression"),
             F.avg("l_quantity").alias("quota_impression"),
             F.max("l_discount").alias("max_cpc"))
        .select(
            F.concat(F.lit("naccount"), F.col("l_linenumber").cast("string")).alias("account_id"),
            F.concat(F.lit("0-"), F.col("l_suppkey").cast("string")).alias("client_id"),
            "impression", "quota_impression", "max_cpc",
        )
    )


def a_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``a_ml(id, age)`` over ``part``."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").alias("age"))


def b_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``b_ml(id, weight, high)`` over ``customer``."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("weight"),
        (F.lit(150) + F.col("c_custkey") % 50).alias("high"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log over ``events``."""
    return request_log_of(table(spark, sf_dir, "events"))


def request_log_of(events: DataFrame) -> DataFrame:
    """Map the events shape onto the request log (works on streams too)."""
    return events.select(
        F.col("user_id").alias("visitor_id"),
        F.col("props").alias("search_text"),
        F.col("ts"),
        F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        F.col("event_type").alias("content"),
    )
