"""A3: the keywords of each campaign in the order of their records, as lists of bounded length.

A campaign's list is cut into segments of ``SEGMENT`` records: one row per (campaign,
segment) with its run of keywords.  Positions come from a range partitioning of (campaign,
record order): rows are numbered inside their part of the range, and the parts of one campaign
are added up (one short row per campaign and part).  So a campaign with a third of all
records is many parts and many segments, and no task holds it whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table
from .keywords import ENABLED_STATE

SEGMENT = 1024
CAMPAIGN = ["client_id", "account_id"]


def positions(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``client_id, account_id, keyword, position``: places from 0 in each campaign's list.

    ``order`` names the columns that order the records (nulls first); records equal in all of these go by keyword.
    """
    keys = [*CAMPAIGN, *order, "keyword"]
    ranged = write_table(rows.select(*dict.fromkeys(keys)).repartitionByRange(*keys).withColumn("part", F.spark_partition_id()),
                         "list-parts")
    sizes = ranged.groupBy(*CAMPAIGN, "part").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy(*CAMPAIGN).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"_{c}") for c in CAMPAIGN], F.col("part").alias("_part"),
                          F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    # the campaign may be null in either column
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in CAMPAIGN]
    placed = ranged.join(starts, (F.col("part") == F.col("_part")) & same[0] & same[1])
    inside = Window.partitionBy(*CAMPAIGN, "part").orderBy(*order, "keyword")
    return placed.select(*CAMPAIGN, "keyword", (F.col("start") + F.row_number().over(inside) - 1).alias("position"))


def keyword_lists(rows: DataFrame, order: Sequence[str], segment: int = SEGMENT, state: str | None = ENABLED_STATE) -> DataFrame:
    """``client_id, account_id, segment, n, keywords``: each campaign's raw keywords in record order.

    ``segment`` counts from 0, ``keywords`` has ``segment`` entries (the last one: the rest, ``n``);
    records without a keyword keep their place as null.  ``state=None`` takes all records.
    """
    mine = rows if state is None else rows.where(F.col("state") == F.lit(state))
    runs = (positions(mine, order)
            .groupBy(*CAMPAIGN, F.expr(f"position div {int(segment)}").alias("segment"))
            .agg(F.array_sort(F.collect_list(F.struct("position", "keyword"))).alias("run")))
    return runs.select(*CAMPAIGN, "segment", F.size("run").cast("long").alias("n"), F.col("run.keyword").alias("keywords"))


def list_rows(lists: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Back to one row per record: ``client_id, account_id, position, keyword``."""
    return lists.select(*CAMPAIGN, "segment", F.posexplode("keywords").alias("at", "keyword")).select(
        *CAMPAIGN, (F.col("segment") * segment + F.col("at")).alias("position"), "keyword")
