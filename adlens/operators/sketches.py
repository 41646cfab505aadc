"""Latency figures that are kept per window and merged to wider spans.

A window keeps counts, sum, least, most and a KLL sketch of its latencies.  States of any
windows merge to the state of their union, so a day, a month or the whole log is
reported from the stored states, without another look at the requests, and late requests
are one more state of their window.

A sketch keeps at most some thousands of values.  ``K`` puts its rank error at 0.24 % with
99 % confidence (2.296 / K ** 0.9021, a fact of the KLL sketch); ``RANK_ERROR`` is four times
that, the bound that the checks hold merged sketches to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.runlog import RunLog
from .requests import percentile_name, successful

K, RANK_ERROR = 2048, 0.01

STATE = ("window_start timestamp, window_end timestamp, requests long, measured long, sum_ms double, "
         "min_ms double, max_ms double, sketch binary")


def latency_states(df: DataFrame, width_seconds: int = 3600, ts: str = "ts", k: int = K) -> DataFrame:
    """One state per tumbling window of successful requests, aligned to the epoch.

    ``requests`` counts all of them, ``measured`` those with a latency; requests without a time
    are in no window.
    """
    lat = F.col("latency_ms").cast("double")
    return (successful(df).groupBy(F.window(ts, f"{width_seconds} seconds").alias("w"))
            .agg(F.count(F.lit(1)).alias("requests"), F.count(lat).alias("measured"), F.sum(lat).alias("sum_ms"),
                 F.min(lat).alias("min_ms"), F.max(lat).alias("max_ms"), F.kll_sketch_agg_double(lat, k).alias("sketch"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "requests", "measured", "sum_ms", "min_ms", "max_ms", "sketch"))


def merge_states(states: DataFrame, width_seconds: int | None = None, k: int = K) -> DataFrame:
    """States of wider windows, each a multiple of the stored width; ``None`` gives one state of everything.

    Sketches merge in the tasks that read them, then once more per span.
    """
    merged = [F.sum("requests").alias("requests"), F.sum("measured").alias("measured"), F.sum("sum_ms").alias("sum_ms"),
              F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms"), F.kll_merge_agg_double("sketch", k).alias("sketch")]
    ends = [F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end")]
    if width_seconds is None:
        return states.agg(*ends, *merged).where("requests IS NOT NULL")
    # the span's own ends, also where it has no window at its edges
    return (states.groupBy(F.window("window_start", f"{width_seconds} seconds").alias("w")).agg(*merged)
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *[c for c in ("requests", "measured", "sum_ms", "min_ms", "max_ms", "sketch")]))


def report(states: DataFrame, percentiles: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """The figures of each state: counts, mean, least, most and the sketched percentiles (null without latencies)."""
    quantiles = [F.when(F.col("measured") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))).alias(percentile_name(p))
                 for p in percentiles]
    return states.select("window_start", "window_end", "requests", (F.col("sum_ms") / F.col("measured")).alias("mean_ms"),
                         "min_ms", "max_ms", *quantiles)


def within_rank_error(df: DataFrame, reported: DataFrame, width_seconds: int | None,
                      percentiles: Sequence[float] = (0.5, 0.95, 0.99), error: float = RANK_ERROR, ts: str = "ts") -> DataFrame:
    """``reported`` with ``<percentile>_within``: whether the value's exact rank among the
    requests of its span is within ``error`` of the percentile (a check, which scans the requests).

    A value that repeats has the ranks from the share below it to the share up to it.
    """
    names = [percentile_name(p) for p in percentiles]
    rows = successful(df).where(F.col("latency_ms").isNotNull() & F.col(ts).isNotNull())
    span = F.lit(0) if width_seconds is None else F.window(ts, f"{width_seconds} seconds")["start"]
    rows = rows.select(span.alias("span"), F.col("latency_ms").cast("double").alias("v"))
    wanted = reported.select((F.lit(0) if width_seconds is None else F.col("window_start")).alias("span"), *names)
    counts = [c for n in names for c in (F.count_if(F.col("v") < F.col(n)).alias(f"{n}_below"),
                                         F.count_if(F.col("v") <= F.col(n)).alias(f"{n}_to"))]
    ranks = rows.join(wanted, "span").groupBy("span").agg(F.count(F.lit(1)).alias("n"), *counts)
    flags = [((F.col(f"{n}_below") <= (p + error) * F.col("n")) & (F.col(f"{n}_to") >= (p - error) * F.col("n"))).alias(f"{n}_within")
             for n, p in zip(names, percentiles)]
    own = reported.withColumn("span", F.lit(0) if width_seconds is None else F.col("window_start"))
    return own.join(ranks.select("span", *flags), "span", "left").drop("span")


class LatencyLog:
    """Stored states below ``path``, one entry per batch of the request log; a batch given again replaces its own entry."""

    def __init__(self, spark: SparkSession, path: str, width_seconds: int = 3600, k: int = K, zone: str = "timestamp"):
        self.width, self.k = width_seconds, k
        self.log = RunLog(spark, path, STATE.replace("timestamp", zone))

    def add(self, key: str, batch: DataFrame) -> None:
        """Reduce one batch of requests to states and commit them under ``key``."""
        self.log.append(key, latency_states(batch, self.width, k=self.k), files=None)

    def report(self, width_seconds: int | None = None, percentiles: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
        """The figures per span of ``width_seconds``, or of everything, from the states alone."""
        if width_seconds is not None and width_seconds % self.width:
            raise ValueError(f"{width_seconds} s is no multiple of the stored windows of {self.width} s")
        return report(merge_states(self.log.table(), width_seconds, self.k), percentiles)
