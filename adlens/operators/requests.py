"""Request-log analytics: encoded request URLs, throughput per window, latency.

Request log shape: ``visitor_id, search_text, ts, latency_ms, status, content``;
``status = 'error'`` marks a failed request, which counts in no throughput and
no latency figure.
"""

from __future__ import annotations

from collections.abc import Sequence

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import form_url_encode

DEFAULT_BASE_URL = "http://localhost:8080/search?q="
FAILED = "error"


def successful(df: DataFrame) -> DataFrame:
    """Requests that did not fail."""
    return df.filter(F.col("status") != F.lit(FAILED))


def request_urls(df: DataFrame, base_url: str = DEFAULT_BASE_URL) -> DataFrame:
    """``base + form-encoded search text + '&id=' + visitor id`` (id not encoded)."""
    return df.select(
        "visitor_id",
        F.concat(F.lit(base_url), form_url_encode("search_text"), F.lit("&id="),
                 F.col("visitor_id").cast("string")).alias("url"))


def throughput(df: DataFrame, width_seconds: int = 3600, ts: str = "ts") -> DataFrame:
    """R2: successful requests per tumbling window of ``width_seconds``.

    ``rate_per_sec = requests * 1000 div width_ms`` (integer, as the load
    generator reports it).  Windows are aligned to the epoch rather than to the
    previous report, and empty windows do not appear.
    """
    width_ms = width_seconds * 1000
    return (successful(df)
            .groupBy(F.window(ts, f"{width_seconds} seconds").alias("w"))
            .agg(F.count(F.lit(1)).alias("requests"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "requests",
                    F.expr(f"(requests * 1000) div {width_ms}").alias("rate_per_sec")))


#: Rank error of a sketch, as a share of the rows it sees, and the most rows
#: of a bracket whose values are picked on the driver.
BRACKET_ERROR, BRACKET_ROWS = 1e-4, 50_000


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> dict[float, float | None]:
    """Exact continuous quantiles (linear interpolation between the two
    nearest ranks, as ``percentile`` / ``quantile_cont``) of a numeric column.

    Scans of one column instead of a sort, and no shuffle of its values:

    1. a ``percentile_approx`` sketch of bounded size gives two values around
       every wanted rank;
    2. one aggregate counts the rows below, at, between and above them, which
       either finds the rank at one of the two values (ties of any number) or
       says in which open interval it lies;
    3. the values of intervals of at most ``BRACKET_ROWS`` rows are fetched in
       one job; larger ones go through 1 and 2 again, about ``BRACKET_ERROR``
       as large.  Every round takes two values out, so it ends.
    """
    rows = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    n = rows.count()
    if n == 0:
        return {p: None for p in probs}
    ranks = {r for p in probs for r in (math.floor((n - 1) * float(p)), math.ceil((n - 1) * float(p)))}
    found: dict[int, float] = {}
    # rank -> values it lies strictly between, rows up to the lower one, rows in between
    open_ = {r: (None, None, 0, n) for r in ranks}
    while open_:
        few = {r: x for r, x in open_.items() if x[3] <= BRACKET_ROWS}
        found.update(_values_at(rows, few))
        open_ = {r: x for r, x in open_.items() if r not in few}
        if open_:
            open_ = _narrowed(rows, open_, found)
    out = {}
    for p in probs:
        h = (n - 1) * float(p)
        lo, hi = math.floor(h), math.ceil(h)
        out[p] = found[lo] + (h - lo) * (found[hi] - found[lo])
    return out


def _between(low: float | None, high: float | None):
    """Rows strictly between two values (``None``: unbounded)."""
    c = F.lit(True)
    if low is not None:
        c = c & (F.col("v") > F.lit(low))
    if high is not None:
        c = c & (F.col("v") < F.lit(high))
    return c


def _values_at(rows: DataFrame, few: dict) -> dict[int, float]:
    """The values at the ranks of small intervals, in one job."""
    if not few:
        return {}
    in_ranks = F.array_compact(F.array(*[F.when(_between(x[0], x[1]), F.lit(r)) for r, x in few.items()]))
    values: dict[int, list] = {r: [] for r in few}
    for x in rows.select("v", F.explode(in_ranks).alias("r")).groupBy("r", "v").count().collect():
        values[x["r"]].append((x["v"], x["count"]))
    out = {}
    for r, (_, _, below, _) in few.items():
        at = below
        for v, c in sorted(values[r], key=lambda x: (math.isnan(x[0]), x[0])):
            at += c
            if r < at:
                out[r] = v
                break
    return out


def _narrowed(rows: DataFrame, open_: dict, found: dict[int, float]) -> dict:
    """Smaller intervals around the ranks; ranks that are met go to ``found``."""
    sketches = []
    for r, (low, high, below, inside) in open_.items():
        share = (r - below + 0.5) / inside
        ends = [max(0.0, share - 2 * BRACKET_ERROR), min(1.0, share + 2 * BRACKET_ERROR)]
        sketches.append(F.percentile_approx(F.when(_between(low, high), F.col("v")), F.array(*map(F.lit, ends)),
                                            int(1 / BRACKET_ERROR)).alias(f"s{r}"))
    ends = rows.agg(*sketches).first()
    v, counts = F.col("v"), []
    for r, (low, high, _, _) in open_.items():
        a, b = ends[f"s{r}"]
        counts += [F.count_if(_between(low, a)).alias(f"below{r}"), F.count_if(v == F.lit(a)).alias(f"a{r}"),
                   F.count_if(_between(a, b)).alias(f"mid{r}"), F.count_if(v == F.lit(b)).alias(f"b{r}")]
    c = rows.agg(*counts).first()
    left = {}
    for r, (low, high, below, inside) in open_.items():
        a, b = ends[f"s{r}"]
        steps = [(c[f"below{r}"], None, low, a), (c[f"a{r}"], a, None, None)]
        if a != b:
            steps += [(c[f"mid{r}"], None, a, b), (c[f"b{r}"], b, None, None)]
        steps.append((inside - sum(n for n, *_ in steps), None, b, high))
        at = below
        for n, value, lo, hi in steps:
            if r < at + n:
                if value is not None:
                    found[r] = value
                else:
                    left[r] = (lo, hi, at, n)
                break
            at += n
    return left


def percentile_name(p: float) -> str:
    """``p50_ms``, ``p99_ms``, ``p99_9_ms``, ...: the digits of the percentage."""
    return f"p{100 * float(p):.10g}".replace(".", "_") + "_ms"


def latency_summary(df: DataFrame, percentiles: Sequence[float] = (0.5, 0.95, 0.99),
                    exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """Count, mean, min, max and percentiles of successful-request latency.

    ``exact=True``: percentiles by ``exact_quantiles`` (two scans).
    ``exact=False``: ``percentile_approx`` sketches of bounded size
    (rank error <= n / accuracy), one pass.
    """
    lat = F.col("latency_ms")
    s = successful(df)
    aggs = [F.count(F.lit(1)).alias("requests"), F.avg(lat).alias("mean_ms"),
            F.min(lat).alias("min_ms"), F.max(lat).alias("max_ms")]
    names = [percentile_name(p) for p in percentiles]
    if not exact:
        aggs += [F.percentile_approx(lat, float(p), accuracy).alias(nm)
                 for p, nm in zip(percentiles, names)]
        return s.agg(*aggs)
    q = exact_quantiles(s, "latency_ms", percentiles)
    return s.agg(*aggs).select(
        "*", *[F.lit(q[p]).cast("double").alias(nm) for p, nm in zip(percentiles, names)])


def latency_by_window(df: DataFrame, width_seconds: int = 3600, ts: str = "ts",
                      percentiles: Sequence[float] = (0.5, 0.95, 0.99),
                      accuracy: int = 10_000) -> DataFrame:
    """R4 per tumbling window (the latency log of each reporting interval):
    count, mean, min, max and sketch percentiles per window."""
    lat = F.col("latency_ms")
    names = [percentile_name(p) for p in percentiles]
    aggs = [F.count(F.lit(1)).alias("requests"), F.avg(lat).alias("mean_ms"),
            F.min(lat).alias("min_ms"), F.max(lat).alias("max_ms")]
    aggs += [F.percentile_approx(lat, float(p), accuracy).alias(nm)
             for p, nm in zip(percentiles, names)]
    return (successful(df).groupBy(F.window(ts, f"{width_seconds} seconds").alias("w"))
            .agg(*aggs)
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "requests", "mean_ms", "min_ms", "max_ms", *names))


def write_responses(df: DataFrame, path: str, columns: Sequence[str] = ("visitor_id", "content")) -> None:
    """Append the response contents to a parquet table."""
    df.select(*columns).write.mode("append").parquet(path)
