"""Mixing sources to target weights by a low-discrepancy schedule.

Each source is a stream: its documents in a keyed random order, end to end,
again and again, cut into blocks of ``BLOCK`` words.  Slot ``k`` of the mix
maps the golden-ratio point frac((k + 1) / phi) through the cumulative shares
of the sources; the r-th slot of a source takes the r-th block of its stream.
There are as many slots as the targets have blocks, and the blocks that the
slots draw are those that are taken: a source's words depend on the points.
Points are near the shares but not on them, so two rules keep every source
within one block below its target, and never above it: a slot whose source is
at its target (in words; the last block is cut there) is passed over, and a
source that the slots left a whole block or more short, or without any block,
gets its next blocks in the slots behind the last.

Targets: the sources in code point order (null last) weigh 1, 2, 3, repeating,
and share all words; a target stops at ``MAX_REPEAT`` times its source's size
and the excess is shared again by weight.  A stream is thus read at most
``MAX_REPEAT`` times.

Running sums over a source are taken in two steps (256 * 16 hash buckets, then
the rows of one bucket), ranks over the slots likewise (runs of slots), so a
source with a third of all rows is not one task's work.  One row per source is
all that is ever sorted in one place.

Null or wordless texts have size 0 and are not taken; rows of equal id are
separate documents; an empty table gives an empty result; other columns are
ignored by :func:`plan` and kept by :func:`mix_documents`.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table

WORD = "[^\\x20\\x09-\\x0D]+"
BLOCK = 64
MAX_REPEAT = 3
#: Slots whose ranks are counted together.
RUN = 1 << 16
#: Cells of the unit interval in which points meet the sources' shares.
CELLS = 4096
#: Points are integers of this many bits, so that every engine draws the same.
POINT_BITS = 48
_POINTS = 1 << POINT_BITS
#: The golden ratio's fraction of that range; odd, so that no two points are equal.
STEP = (isqrt(5 << 2 * POINT_BITS) - _POINTS) // 2 | 1


def targets(sizes: DataFrame) -> DataFrame:
    """Per source: ``place`` (code point order), ``source_size``, ``target``,
    ``stop`` (the target in whole words) from (source, source_size) rows.

    Sources are filled in the order in which they reach their limit.  With the
    first ones full, the others would stand at words left / weights left; that
    level rises with every source that must be full and falls with every other,
    so the true level is the highest.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("full_at", "place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    everything = F.sum("source_size").over(every)
    weighed = (sizes.withColumn("place", F.row_number().over(order) - 1)
               .withColumn("weight", F.col("place") % 3 + 1)
               .withColumn("limit", F.col("source_size") * MAX_REPEAT)
               .withColumn("full_at", F.col("limit") / F.col("weight"))
               .withColumn("words", everything).withColumn("weights", F.sum("weight").over(every)))
    left = F.col("words") - F.coalesce(F.sum("limit").over(fill), F.lit(0))
    open_ = F.col("weights") - F.coalesce(F.sum("weight").over(fill), F.lit(0))
    level = F.max("level_here").over(every)
    return (weighed.withColumn("level_here", left / open_).withColumn("level", level)
            .withColumn("target", F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")))
            .select("source", "place", "source_size", "target",
                    F.floor(F.col("target") + 0.5).cast("long").alias("stop")))


def positions(df: DataFrame, id_col: str, text_col: str, source_col: str, *carried: str,
              block: int = BLOCK, step: int = STEP) -> tuple[DataFrame, DataFrame]:
    """Every row with ``size`` and ``first``, its place in its source's stream,
    and its source's ``place``, ``source_size``, ``target`` and ``reach``; and
    the schedule by which the source reaches it."""
    key = F.md5(F.col("doc_id").cast("string"))
    rows = (df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"),
                      F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                      *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carried)))
            .withColumn("key", F.coalesce(key, F.lit(""))).withColumn("bucket", F.substring("key", 1, 3)))
    if not carried:
        rows = write_table(rows, "mix-sizes")
    part = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = write_table(part, "mix-buckets")
    goals = write_table(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size"))), "mix-targets")
    slots = write_table(schedule(goals, block, step), "mix-schedule")
    goals = goals.join(reached(goals, slots, block), "place").drop("stop")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    at = (sums.withColumn("bucket_at", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
          .join(goals.withColumnRenamed("source", "_goal"), F.col("source").eqNullSafe(F.col("_goal"))).drop("_goal")
          .withColumnsRenamed({"source": "_goal", "bucket": "_bucket"}))
    inside = (Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(at, F.col("source").eqNullSafe(F.col("_goal")) & (F.col("bucket") == F.col("_bucket")))
              .withColumn("first", F.col("bucket_at") + F.col("ahead"))
              .drop("_goal", "_bucket", "bucket_at", "ahead", "key", "bucket"))
    return placed, slots


def point_of(slots: DataFrame, step: int = STEP) -> DataFrame:
    """``slots`` with ``point``: ``(slot + 1) * step`` modulo 2^48, in factors of 24 bits that a long holds."""
    half = 1 << POINT_BITS // 2
    k = F.col("slot") + 1
    k_high, k_low = F.floor(k / half), k % half
    high = (k_high * (step % half) + k_low * (step // half)) % half
    return slots.withColumn("point", (high * half + k_low * (step % half)) % _POINTS)


def schedule(goals: DataFrame, block: int = BLOCK, step: int = STEP) -> DataFrame:
    """(place, block, slot): the blocks of each stream that are taken, and at which slot."""
    spark = goals.sparkSession
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    share = (goals.select("place", F.ceil(F.col("stop") / block).cast("long").alias("blocks"),
                          F.greatest(F.floor(F.col("stop") / block), F.lit(1)).cast("long").alias("least"))
             .where("blocks > 0").withColumn("slots", F.sum("blocks").over(every))
             .withColumn("high", F.sum("blocks").over(upto)).withColumn("low", F.col("high") - F.col("blocks")))
    share = write_table(share, "mix-shares")
    slots = share.agg(F.max("slots")).first()[0] or 0
    cells = share.select("place", "blocks", *(F.expr(f"cast({c} as decimal(20,0)) * {_POINTS} div slots").alias(c)
                                              for c in ("low", "high")))
    width = _POINTS // CELLS
    cells = cells.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width),
                                                          F.floor((F.col("high") - 1) / width))))
    drawn = (point_of(spark.range(slots).withColumnRenamed("id", "slot"), step).withColumn("cell", F.floor(F.col("point") / width))
             .join(cells, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
             .select("slot", "place", "blocks", F.floor(F.col("slot") / RUN).alias("run")))
    earlier = Window.partitionBy("place").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = write_table(drawn.groupBy("place", "run").agg(F.count("*").alias("n"))
                       .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "mix-runs")
    ranked = (drawn.withColumn("rank", F.row_number().over(Window.partitionBy("place", "run").orderBy("slot")) - 1)
              .join(runs, ["place", "run"]).withColumn("block", F.col("rank") + F.col("before"))
              .where("block < blocks").select("place", "block", "slot"))
    # a few rows a source: no more than its points stray from its share
    short = (share.join(runs.groupBy("place").agg(F.sum("n").alias("hits")), "place", "left")
             .withColumn("hits", F.coalesce("hits", F.lit(0))).where("hits < least")
             .select("place", F.explode(F.sequence(F.col("hits"), F.col("least") - 1)).alias("block"))
             .withColumn("slot", slots - 1 + F.row_number().over(Window.orderBy("block", "place")).cast("long")))
    return ranked.unionByName(short)


def reached(goals: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """(place, reach): the words of its stream that each source's scheduled blocks hold."""
    last = slots.groupBy("place").agg((F.max("block") + 1).alias("taken_blocks"))
    return (goals.select("place", "stop").join(last, "place", "left")
            .select("place", F.least("stop", F.coalesce("taken_blocks", F.lit(0)) * block).alias("reach")))


def pieces(placed: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix: (slot, place, block, doc_id, first, epoch, from_word, words)."""
    once = F.col("first") + F.col("epoch") * F.col("source_size")
    copies = (placed.where("size > 0").select("place", "doc_id", "first", "size", "source_size", "reach",
                                              F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEAT - 1))).alias("epoch"))
              .withColumn("begin", once).where(F.col("begin") < F.col("reach"))
              .withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("reach"))))
    cut = copies.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block),
                                                          F.floor((F.col("end") - 1) / block))))
    lo, hi = F.greatest("begin", F.col("block") * block), F.least("end", (F.col("block") + 1) * block)
    return (cut.join(slots, ["place", "block"])
            .select("slot", "place", "block", "doc_id", "first", "epoch",
                    (lo - F.col("begin")).alias("from_word"), (hi - lo).alias("words")))


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         block: int = BLOCK, step: int = STEP) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken."""
    placed, slots = positions(df, id_col, text_col, source_col, block=block, step=step)
    placed = write_table(placed, "mix-placed")
    taken = (pieces(placed, slots, block).groupBy("place", "doc_id", "first").agg(F.sum("words").alias("taken"))
             .select(*(F.col(c).alias(f"_{c}") for c in ("place", "doc_id", "first")), "taken"))
    # rows without words share their place with the row behind them
    same = ((F.col("place") == F.col("_place")) & (F.col("first") == F.col("_first"))
            & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("size") > 0))
    return placed.join(taken, same, "left").select(
        "doc_id", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  block: int = BLOCK, step: int = STEP) -> DataFrame:
    """``df`` mixed in whole documents: a row for every copy of a document that
    begins in a scheduled block, so each source meets its target up to a block
    and a part of one document; rows of size 0 are kept once."""
    placed, _ = positions(df, id_col, text_col, source_col, *df.columns, block=block, step=step)
    begun = F.ceil((F.col("reach") - F.col("first")) / F.greatest("source_size", F.lit(1)))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.least(begun, F.lit(MAX_REPEAT))).cast("int")
    return (placed.withColumn("copies", copies).where("copies > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select(*(F.col(f"carried_{i}").alias(c) for i, c in enumerate(df.columns))))


#: ``op6_mixing`` in DuckDB: the points that fall to each source say how far into its
#: endless stream it reaches; a row's words are the overlaps of its copies with that.
SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    md5(doc_id::VARCHAR) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS place FROM s),
v AS (SELECT *, place % 3 + 1 AS weight, {MAX_REPEAT} * source_size AS cap FROM w),
f AS (SELECT *, cap / weight AS full_at,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, place
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level_here FROM v),
g AS (SELECT *, least(cap::DOUBLE, weight * (SELECT max(level_here) FROM f)) AS target FROM f),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS stop, ceil(floor(target + 0.5) / {BLOCK})::BIGINT AS blocks FROM g),
c AS (SELECT *, sum(blocks) OVER () AS slots, sum(blocks) OVER (ORDER BY place) AS high FROM b),
k AS (SELECT unnest(range(1, (SELECT max(slots) FROM c)::BIGINT + 1)) AS k),
x AS (SELECT k::HUGEINT * {STEP} % {_POINTS} AS point FROM k),
h AS (SELECT place, count(point) AS hits FROM c LEFT JOIN x
    ON point >= (high - blocks)::HUGEINT * {_POINTS} // slots AND point < high::HUGEINT * {_POINTS} // slots GROUP BY place),
r AS (SELECT c.*, least(stop, {BLOCK} * least(blocks, greatest(hits, stop // {BLOCK}, 1)))::BIGINT AS reach
  FROM c JOIN h USING (place)),
p AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.reach,
    coalesce(sum(d.size) OVER (PARTITION BY r.place ORDER BY d.key, d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  ({' + '.join(f'greatest(0, least(first + {e} * source_size + size, reach) - (first + {e} * source_size))' for e in range(MAX_REPEAT))})::BIGINT AS taken
FROM p
"""
