"""Keyword-level operators: enabled filter, normalisation, counts, means, moments.

All aggregates are hash aggregates with a map-side partial step, so a keyword
holding a large share of the rows is reduced per partition before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ENABLED_STATE, normalize_keyword, strict_double


def enabled_keywords(rows: DataFrame, state: str = ENABLED_STATE) -> DataFrame:
    """Rows whose state is exactly ``state`` (case-sensitive)."""
    return rows.filter(F.col("state") == F.lit(state))


def keyword_qi(rows: DataFrame, state: str = ENABLED_STATE) -> DataFrame:
    """Enabled rows -> normalised keyword + quota impression as double.

    The cast sits above the state filter, so a bad number on a paused row
    never fails the job.
    """
    return enabled_keywords(rows, state).select(
        "client_id", "account_id",
        F.col("keyword").alias("raw_keyword"),
        normalize_keyword("keyword").alias("keyword"),
        strict_double("quota_impression", "quota_impression").alias("quota_impression"),
    )


def keyword_counts(rows: DataFrame, state: str = ENABLED_STATE) -> DataFrame:
    """A1: occurrences per normalised keyword -> ``keyword, n``."""
    return (enabled_keywords(rows, state)
            .groupBy(normalize_keyword("keyword").alias("keyword"))
            .agg(F.count(F.lit(1)).alias("n")))


def keyword_means(rows: DataFrame, state: str = ENABLED_STATE) -> DataFrame:
    """A2: mean quota impression per normalised keyword -> ``keyword, avg_qi``."""
    return (keyword_qi(rows, state).groupBy("keyword")
            .agg(F.avg("quota_impression").alias("avg_qi")))


def keyword_stats(rows: DataFrame, state: str = ENABLED_STATE) -> DataFrame:
    """Count and mean in one aggregate -> ``keyword, n, avg_qi``.

    Equal to pairing A1 and A2 by keyword (both have the same key set).
    """
    return (keyword_qi(rows, state).groupBy("keyword")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("quota_impression").alias("avg_qi")))


def top_keywords(stats: DataFrame, n: int = 20) -> DataFrame:
    """O2: most frequent keywords, ties broken by keyword (a top-k report)."""
    return stats.orderBy(F.desc("n"), F.asc("keyword")).limit(n)


def count_moments(stats: DataFrame, col: str = "n") -> DataFrame:
    """Number of keywords, mean and sample (n-1) standard deviation."""
    return stats.agg(
        F.count(F.lit(1)).alias("keywords"),
        F.avg(col).alias("mean_n"),
        F.stddev_samp(col).alias("sd_n"),
    )


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "_z") -> DataFrame:
    """``(x - mean) / sd`` with the sample standard deviation.

    One aggregate computes the 2 * len(cols) moments; they come back as model
    parameters (a single row) and the scaling is a literal expression.
    """
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}")]
    m = df.agg(*aggs).first()
    out = df
    for c in cols:
        mean, sd = m[f"m_{c}"], m[f"s_{c}"]
        out = out.withColumn(
            c + suffix,
            (F.col(c) - F.lit(mean)) / F.lit(sd) if sd not in (None, 0.0) else F.lit(None).cast("double"))
    return out


def campaign_keyword_groups(rows: DataFrame, state: str = ENABLED_STATE) -> DataFrame:
    """A3: the values grouped under each campaign, as a distributed multiset.

    ``client_id, account_id, keyword, occurrences``: one row per distinct
    (campaign, raw keyword).  The group is never gathered into one array, so a
    campaign holding a large share of the rows stays spread over tasks.
    """
    return (enabled_keywords(rows, state)
            .groupBy("client_id", "account_id", "keyword")
            .agg(F.count(F.lit(1)).alias("occurrences")))
