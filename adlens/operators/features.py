"""Campaign features: keyword labels, cluster histograms, average of averages,
history projection, the history join and training rows.

Plan shape (per campaign features)::

    rows --(partial agg)--> pairs (campaign, raw keyword, n, sum_qi)    [written once]
    pairs --> dictionary: per normalised keyword count/avg -> cluster id (literal centres)
    pairs LEFT JOIN dictionary on lookup key                            (AQE: broadcast if small)
          --> GROUP BY campaign with K conditional sums                 (partial + final)

Rows are reduced to distinct (campaign, keyword) pairs before any join, so a
hot keyword or campaign is already collapsed per map task.  The pairs feed
two branches (dictionary and labels); they are written once as a table in the
shared checkpoint folder so the raw rows are scanned once, not twice (Catalyst
pushes different inferred filters into each branch, so the shuffle would not
be reused).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (ENABLED_STATE, lookup_key, normalize_keyword, strict_double,
                              strip_dashes)
from ..session import MAX_BROADCAST_BYTES, checked_broadcast, write_table
from .clustering import ClusterCentres, TWO_D
from .keywords import enabled_keywords

CAMPAIGN = ["client_id", "account_id"]


def keyword_pairs(rows: DataFrame, state: str = ENABLED_STATE) -> DataFrame:
    """Enabled rows reduced to ``client_id, account_id, keyword (raw), n, sum_qi``."""
    return (enabled_keywords(rows, state)
            .groupBy(*CAMPAIGN, "keyword")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum(strict_double("quota_impression", "quota_impression")).alias("sum_qi")))


def shared_pairs(rows: DataFrame, state: str = ENABLED_STATE, share: bool = True) -> DataFrame:
    """``keyword_pairs``, written once when ``share`` (read by two branches)."""
    pairs = keyword_pairs(rows, state)
    return write_table(pairs, "keyword-pairs") if share else pairs


def stats_from_pairs(pairs: DataFrame) -> DataFrame:
    """``keyword, n, avg_qi`` per normalised keyword, from the pre-aggregated pairs."""
    return (pairs.groupBy(normalize_keyword("keyword").alias("keyword"))
            .agg(F.sum("n").alias("n"), (F.sum("sum_qi") / F.sum("n")).alias("avg_qi")))


def label_dictionary(stats: DataFrame, centres: ClusterCentres,
                     features: Sequence[str] = TWO_D) -> DataFrame:
    """Keyword -> cluster id for every keyword of the statistics."""
    return stats.select("keyword", centres.assign(features).alias("cluster_id"))


def _dict_side(dictionary: DataFrame, value: str,
               max_broadcast_bytes: int | None = MAX_BROADCAST_BYTES) -> DataFrame:
    d = dictionary.select(F.col("keyword").alias("_dict_key"), F.col(value).alias("_dict_value"))
    return d if max_broadcast_bytes is None else checked_broadcast(d, max_broadcast_bytes)


def label_keywords(rows: DataFrame, dictionary: DataFrame, default: Column | int | float,
                   lookup_case: str = "reference", value: str = "cluster_id",
                   state: str = ENABLED_STATE,
                   max_broadcast_bytes: int | None = MAX_BROADCAST_BYTES) -> DataFrame:
    """J2 + P5: every enabled row with its dictionary value, ``default`` on a miss.

    ``client_id, account_id, keyword (raw), <value>``.  A left join, so the
    dictionary may be any size: it is broadcast when its measured size is
    under ``max_broadcast_bytes``, else the join is sort-merge (AQE splits
    skewed partitions).  ``None`` leaves the choice to the optimizer.
    """
    d = _dict_side(dictionary, value, max_broadcast_bytes)
    dflt = default if isinstance(default, Column) else F.lit(default)
    left = enabled_keywords(rows, state).select(
        *CAMPAIGN, "keyword", lookup_key("keyword", lookup_case).alias("_lookup"))
    return (left.join(d, left["_lookup"] == d["_dict_key"], "left")
            .select(*CAMPAIGN, "keyword", F.coalesce("_dict_value", dflt).alias(value)))


def label_pairs(pairs: DataFrame, dictionary: DataFrame, default: Column | int | float,
                lookup_case: str = "reference", value: str = "cluster_id",
                max_broadcast_bytes: int | None = MAX_BROADCAST_BYTES) -> DataFrame:
    """J2 on pre-aggregated pairs: ``client_id, account_id, n, <value>``."""
    d = _dict_side(dictionary, value, max_broadcast_bytes)
    dflt = default if isinstance(default, Column) else F.lit(default)
    left = pairs.withColumn("_lookup", lookup_key("keyword", lookup_case))
    return (left.join(d, left["_lookup"] == d["_dict_key"], "left")
            .select(*CAMPAIGN, "n", F.coalesce("_dict_value", dflt).alias(value)))


def histogram_columns(k: int) -> list[str]:
    """Column names ``k0 .. k{k-1}`` of a K-cluster histogram."""
    return [f"k{i}" for i in range(k)]


def cluster_histogram(labelled: DataFrame, k: int, label: str = "cluster_id",
                      weight: str | None = "n") -> DataFrame:
    """A4/A5: per campaign, how many (enabled) rows fall in each of ``k`` clusters.

    Always ``k`` columns ``k0..k{k-1}``; labels outside ``[0, k)`` count in none.
    One pass with ``k`` conditional sums (partial aggregation on the map side).
    ``weight`` is the row multiplicity of pre-aggregated input (``None`` = 1).
    """
    w = F.col(weight) if weight else F.lit(1).cast("long")
    lab = F.col(label)
    return labelled.groupBy(*CAMPAIGN).agg(
        *[F.sum(F.when(lab == i, w).otherwise(F.lit(0).cast("long"))).alias(f"k{i}")
          for i in range(k)])


def campaign_cluster_features(rows: DataFrame, centres: ClusterCentres, k: int | None = None,
                              features: Sequence[str] = TWO_D, lookup_case: str = "reference",
                              state: str = ENABLED_STATE, pairs: DataFrame | None = None,
                              share: bool = True) -> DataFrame:
    """Keyword statistics -> labels -> per-campaign histogram.

    ``k`` defaults to the number of centres; columns are fixed by ``k``, not by
    how many clusters the model really has.  ``pairs`` may be passed in when
    several feature sets are built from the same rows.
    """
    k = centres.k if k is None else k
    pairs = shared_pairs(rows, state, share) if pairs is None else pairs
    dictionary = label_dictionary(stats_from_pairs(pairs), centres, features)
    labelled = label_pairs(pairs, dictionary, centres.default_cluster(), lookup_case)
    return cluster_histogram(labelled, k)


def campaign_avg_of_avg(rows: DataFrame, lookup_case: str = "reference", default: float = 0.0,
                        state: str = ENABLED_STATE, pairs: DataFrame | None = None,
                        share: bool = True) -> DataFrame:
    """Per campaign, the mean over its enabled rows of the keyword's mean QI.

    A keyword missing from the dictionary (see ``lookup_case``) counts as
    ``default``.  ``client_id, account_id, avg_of_avg``.
    """
    pairs = shared_pairs(rows, state, share) if pairs is None else pairs
    means = stats_from_pairs(pairs).select("keyword", "avg_qi")
    d = _dict_side(means, "avg_qi", MAX_BROADCAST_BYTES)
    left = pairs.withColumn("_lookup", lookup_key("keyword", lookup_case))
    joined = left.join(d, left["_lookup"] == d["_dict_key"], "left")
    v = F.coalesce("_dict_value", F.lit(float(default)))
    return joined.groupBy(*CAMPAIGN).agg(
        (F.sum(v * F.col("n")) / F.sum("n")).alias("avg_of_avg"))


def campaign_history(history: DataFrame, excluded_accounts: Iterable[str] = ()) -> DataFrame:
    """P2 + P6: history keyed like keyword rows -> ``client_id, account_id, label, impression, max_cpc``.

    Dashes are removed from the history client id only; numbers are cast after
    the account exclusion.
    """
    excluded = list(excluded_accounts)
    kept = history.filter(~F.col("account_id").isin(excluded)) if excluded else history
    return kept.select(
        strip_dashes("client_id").alias("client_id"),
        F.col("account_id"),
        strict_double("quota_impression", "quota_impression").alias("label"),
        strict_double("impression", "impression").alias("impression"),
        strict_double("max_cpc", "max_cpc").alias("max_cpc"),
    )


def join_history(history: DataFrame, features: DataFrame) -> DataFrame:
    """Inner equi-join on both key columns (N history rows : 1 campaign)."""
    return history.join(features, CAMPAIGN, "inner")


def feature_columns(extra: Sequence[str]) -> list[str]:
    """Training-row layout: impression, max CPC, then the campaign features."""
    return ["impression", "max_cpc", *extra]


def training_rows(joined: DataFrame, extra: Sequence[str]) -> DataFrame:
    """``client_id, account_id, label, impression, max_cpc, <extra...>``."""
    return joined.select(*CAMPAIGN, "label", *feature_columns(extra))


def to_labeled(df: DataFrame, feature_cols: Sequence[str], label: str = "label",
               output: str = "features", keep: Sequence[str] = ()) -> DataFrame:
    """P10: ``label, features`` (dense vector) for the ML estimators (+ ``keep``)."""
    return VectorAssembler(inputCols=list(feature_cols), outputCol=output,
                           handleInvalid="error").transform(df).select(
        F.col(label).cast("double").alias("label"), output, *keep)
