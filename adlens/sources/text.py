"""Delimited text sources (keyword rows, history rows) and the Hive-style table scan.

Records are one line each, no header, no quoting: a quote is an ordinary
character, a blank line is one empty field.  The CSV reader is deliberately not
used (it turns ``''`` into null, honours quotes and skips blank lines).

Field access follows the JVM ``String.split`` contract of the original jobs:
trailing empty fields do not exist, so a record whose needed field is empty
*and last* is too short.  ``on_bad="fail"`` (default) raises on such records
and on numbers that do not parse -- but only for rows that survive the
record's own filter (enabled state, account exclusion), exactly where the
original jobs would touch the field.  ``on_bad="quarantine"`` returns the
good rows and the bad lines with a reason instead.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ENABLED_STATE, HISTORY_SEPARATOR, KEYWORD_SEPARATOR

# Field positions of the two record formats.
KEYWORD_FIELDS = {"client_id": 0, "account_id": 1, "keyword": 3, "state": 5,
                  "quota_impression": 15}
KEYWORD_MIN_FIELDS = 6       # the state field is read on every record
KEYWORD_ENABLED_MIN_FIELDS = 16
HISTORY_FIELDS = {"account_id": 0, "client_id": 1, "impression": 3,
                  "quota_impression": 8, "max_cpc": 12}
HISTORY_MIN_FIELDS = 1       # the account field is read on every record
HISTORY_KEPT_MIN_FIELDS = 13

KEYWORD_COLUMNS = ["client_id", "account_id", "keyword", "state", "quota_impression"]
HISTORY_COLUMNS = ["account_id", "client_id", "impression", "quota_impression", "max_cpc"]


class Quarantined(NamedTuple):
    """Rows that parsed (``good``) and lines that did not, with a reason (``bad``)."""
    good: DataFrame
    bad: DataFrame


def _fields(sep: str) -> Column:
    return F.split(F.col("value"), sep, -1)


def jvm_field_count(sep: str) -> Column:
    """Number of fields as the JVM split counts them (trailing empties dropped).

    The fields of the one split every record gets, minus the trailing
    separators (each closes one trailing empty field); no second split.
    """
    value = F.col("value")
    kept = F.length(F.rtrim(value, F.lit(sep)))
    # a record of separators only has no field at all; an empty one has one
    return (F.when((kept == 0) & (F.length(value) > 0), F.lit(0))
            .otherwise(F.size(_fields(sep)) - (F.length(value) - kept)))


def _guard(value: Column, ok: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(
        F.raise_error(F.concat(F.lit(message + ": "), F.col("value"))))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per line, column ``value`` (globs and folders allowed)."""
    return spark.read.text(path)


def parse_keyword_lines(lines: DataFrame, on_bad: str = "fail") -> DataFrame | Quarantined:
    """``;`` records -> ``client_id, account_id, keyword, state, quota_impression``.

    All fields stay strings (``quota_impression`` is cast by the operators that
    need it, after the enabled filter).  A row whose state is not the enabled
    one is never too short for its other fields: they are null where missing,
    wherever the filter runs.  An enabled row must have all 16 fields, also for
    consumers that read fewer of them.
    """
    f = _fields(KEYWORD_SEPARATOR)
    n = jvm_field_count(KEYWORD_SEPARATOR)
    pos = KEYWORD_FIELDS
    if on_bad == "fail":
        short = "keyword record has too few fields"
        other = (n >= KEYWORD_MIN_FIELDS) & (F.get(f, pos["state"]) != F.lit(ENABLED_STATE))

        def field(c: str) -> Column:
            value = F.get(f, pos[c])
            if c == "state":
                return _guard(value, n >= KEYWORD_MIN_FIELDS, short)
            return F.when(other, value).otherwise(_guard(value, n >= KEYWORD_ENABLED_MIN_FIELDS, short))

        return lines.select(*[field(c).alias(c) for c in KEYWORD_COLUMNS])
    if on_bad != "quarantine":
        raise ValueError(f"on_bad must be 'fail' or 'quarantine', got {on_bad!r}")
    enabled = f[pos["state"]] == F.lit(ENABLED_STATE)
    reason = (
        F.when(n < KEYWORD_MIN_FIELDS, F.lit("too few fields"))
        .when(enabled & (n < KEYWORD_ENABLED_MIN_FIELDS), F.lit("too few fields"))
        .when(enabled & F.get(f, pos["quota_impression"]).try_cast("double").isNull(),
              F.lit("quota_impression is not a number"))
    )
    tagged = lines.select("value", reason.alias("reason"))
    good = tagged.filter(F.col("reason").isNull()).select(
        *[F.get(_fields(KEYWORD_SEPARATOR), pos[c]).alias(c) for c in KEYWORD_COLUMNS])
    bad = tagged.filter(F.col("reason").isNotNull())
    return Quarantined(good, bad)


def read_keyword_rows(spark: SparkSession, path: str | list[str],
                      on_bad: str = "fail") -> DataFrame | Quarantined:
    """Scan keyword records from text files."""
    return parse_keyword_lines(read_lines(spark, path), on_bad=on_bad)


def parse_history_lines(lines: DataFrame, excluded_accounts: Iterable[str] = (),
                        on_bad: str = "fail") -> DataFrame | Quarantined:
    """``,`` records -> ``account_id, client_id, impression, quota_impression, max_cpc``.

    Accounts in ``excluded_accounts`` are dropped before any other field is
    read, so their bad values never fail the job.
    """
    excluded = list(excluded_accounts)
    f = _fields(HISTORY_SEPARATOR)
    n = jvm_field_count(HISTORY_SEPARATOR)
    pos = HISTORY_FIELDS
    kept = lines
    if excluded:
        kept = lines.filter(~f[pos["account_id"]].isin(excluded))
    if on_bad == "fail":
        short = "history record has too few fields"
        return kept.select(
            f[pos["account_id"]].alias("account_id"),
            *[_guard(f[pos[c]], n >= HISTORY_KEPT_MIN_FIELDS, short).alias(c)
              for c in HISTORY_COLUMNS[1:]],
        )
    if on_bad != "quarantine":
        raise ValueError(f"on_bad must be 'fail' or 'quarantine', got {on_bad!r}")
    numbers = [c for c in HISTORY_COLUMNS if c not in ("account_id", "client_id")]
    not_number = None
    for c in numbers:
        bad_c = F.get(f, pos[c]).try_cast("double").isNull()
        not_number = bad_c if not_number is None else (not_number | bad_c)
    reason = (F.when(n < HISTORY_KEPT_MIN_FIELDS, F.lit("too few fields"))
              .when(not_number, F.lit("a number does not parse")))
    tagged = kept.select("value", reason.alias("reason"))
    good = tagged.filter(F.col("reason").isNull()).select(
        *[F.get(_fields(HISTORY_SEPARATOR), pos[c]).alias(c) for c in HISTORY_COLUMNS])
    bad = tagged.filter(F.col("reason").isNotNull())
    return Quarantined(good, bad)


def read_history_rows(spark: SparkSession, path: str | list[str],
                      excluded_accounts: Iterable[str] = (),
                      on_bad: str = "fail") -> DataFrame | Quarantined:
    """S2 + P2: scan history records, dropping excluded accounts first."""
    return parse_history_lines(read_lines(spark, path), excluded_accounts, on_bad)


def field_count_profile(lines: DataFrame, sep: str = KEYWORD_SEPARATOR) -> DataFrame:
    """How many records have how many fields (JVM counting)."""
    return (lines.groupBy(jvm_field_count(sep).alias("n_fields"))
            .agg(F.count(F.lit(1)).alias("n_lines")))


def observe_records(lines: DataFrame, observation: Observation, sep: str = KEYWORD_SEPARATOR,
                    least: int = KEYWORD_ENABLED_MIN_FIELDS) -> DataFrame:
    """P16 in the pass that reads the records: ``lines`` unchanged; once an action has read them, ``observation.get``
    has ``records``, ``short`` (fewer than ``least`` fields), ``fewest_fields`` and ``most_fields``."""
    n = jvm_field_count(sep)
    return lines.observe(observation, F.count(F.lit(1)).alias("records"), F.count_if(n < least).alias("short"),
                         F.min(n).alias("fewest_fields"), F.max(n).alias("most_fields"))


def _line(cols: dict[int, Column], width: int, sep: str) -> Column:
    parts = [cols.get(i, F.lit("")) for i in range(width)]
    return F.concat_ws(sep, *[p.cast("string") for p in parts])


def format_keyword_lines(rows: DataFrame) -> DataFrame:
    """Typed keyword rows -> ``;`` records (unused positions left empty)."""
    cols = {i: F.col(c) for c, i in KEYWORD_FIELDS.items()}
    return rows.select(_line(cols, KEYWORD_ENABLED_MIN_FIELDS, KEYWORD_SEPARATOR).alias("value"))


def format_history_lines(rows: DataFrame) -> DataFrame:
    """Typed history rows -> ``,`` records (unused positions left empty)."""
    cols = {i: F.col(c) for c, i in HISTORY_FIELDS.items()}
    return rows.select(_line(cols, HISTORY_KEPT_MIN_FIELDS, HISTORY_SEPARATOR).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Write one-column ``value`` lines as text files (replacing the folder)."""
    lines.write.mode("overwrite").text(path)


def read_table(spark: SparkSession, name: str, database: str | None = None) -> DataFrame:
    """S3: a metastore table or view, optionally qualified by database."""
    return spark.table(f"{database}.{name}" if database else name)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append a metrics table (grid results, progress) to a parquet log."""
    metrics.write.mode("append").parquet(path)


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, database: str | None = None,
                   path: str | None = None) -> None:
    """S3: ``df`` as a catalogue table, bucketed and sorted by ``keys`` (replacing it).

    Tables with the same buckets on the join keys join and aggregate without an
    exchange.  ``path`` makes it an external table there; else it lies in the warehouse.  ``database`` is made
    where it is missing.
    """
    spark = df.sparkSession
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    # one task a bucket: else every task writes a file for each of its buckets
    laid = df.repartition(buckets, *keys)
    writer = laid.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(f"{database}.{name}" if database else name)
