"""Rows in ascending id order, dealt over many tasks.

The id range is cut at approximate quantiles; every piece is a unit of work
that one task reads in order.  An operator that also needs the row after the
last of a piece gets it as a *lookahead* row: the first row of the next piece
(of the first piece, behind the last) is sent to both.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_order(df: DataFrame, id_col: str, tie_col: str, lookahead: bool = False, pieces: int | None = None) -> DataFrame:
    """``df`` with columns ``_piece`` and ``_ahead`` (1 for a lookahead row),
    each task sorted by piece, lookahead last, id (null first) and ``tie_col``.

    ``pieces`` defaults to four for each shuffle partition.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces or 4 * parts
    # the cuts only balance the work: half a piece of error is good enough
    cuts = sorted(set(df.select(F.col(id_col).cast("double").alias("id")).approxQuantile(
        "id", [i / pieces for i in range(1, pieces)], 0.5 / pieces)))
    rows = df.withColumn("_id", F.coalesce(F.col(id_col).cast("double"), F.lit(float("-inf"))))
    rows = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_id", outputCol="_cut").transform(rows) \
        if cuts else rows.withColumn("_cut", F.lit(0.0))
    rows = rows.withColumn("_cut", F.col("_cut").cast("int")).withColumn("_ahead", F.lit(0))
    if lookahead:
        # at most one row for each piece reaches the driver
        heads = rows.groupBy("_cut").agg(F.min(F.struct(F.col(id_col).isNotNull().alias("some"),
                                                         F.col(id_col).alias("id"))).alias("head")).orderBy("_cut").collect()
        order = [h["_cut"] for h in heads]
        before = spark.createDataFrame(
            [(h["_cut"], h["head"]["id"], order[i - 1]) for i, h in enumerate(heads)],
            "_head_cut int, _head_id long, _before int")
        rows = (rows.join(F.broadcast(before), (F.col("_cut") == F.col("_head_cut"))
                          & F.col(id_col).eqNullSafe(F.col("_head_id")), "left")
                .withColumn("_to", F.explode(F.when(F.col("_head_cut").isNull(), F.array(F.struct(F.col("_cut").alias("p"), F.lit(0).alias("a"))))
                                             .otherwise(F.array(F.struct(F.col("_cut").alias("p"), F.lit(0).alias("a")),
                                                                F.struct(F.col("_before").alias("p"), F.lit(1).alias("a"))))))
                .withColumn("_cut", F.col("_to.p")).withColumn("_ahead", F.col("_to.a"))
                .drop("_to", "_head_cut", "_head_id", "_before"))
    return (rows.drop("_id").withColumnRenamed("_cut", "_piece").repartition(parts, "_piece")
            .sortWithinPartitions("_piece", "_ahead", F.col(id_col).asc_nulls_first(), F.xxhash64(tie_col), tie_col))
