"""Merkle manifest of a table, level by level with lag and lead windows.

Every row is a leaf, the sha256 of its fields.  The leaves of a group (a
source) ascend by id; every ``FANOUT`` consecutive nodes become their hash until
one, the group's subroot, remains.  The subroots, ordered by group, give the root
in the same way.  A row's proof is what a verifier needs beside the row: on every
level the other nodes of its run of ``FANOUT``.

**Method.**  A node knows its position and the length of its group's level, so its
slot in the run and the length of the run.  Lag and lead columns of the fixed
offsets 1 to ``FANOUT - 1``, masked by slot and run length, are its siblings, and
the row of slot 0 hashes itself with its lead columns into the parent.  Windows
are cut at multiples of ``BLOCK`` positions, which no run crosses, so a group that
holds a third of all rows is many windows.  A level is a sixteenth of the one
below; the levels above the leaves are written as tables.

**Positions** come from a range partitioning by (group, id, leaf): the rank inside
a partition plus the group's rows in earlier partitions.  No group is gathered.

Null fields are ``-`` in the leaf, all others their UTF-8 byte count, ``:`` and the
value.  A null group is a group of its own and stands first; null ids stand first
in their group.  Rows of equal group and id are ordered by leaf, so equal rows
have neighbouring, equal leaves.  A table of one row has its leaf as root and the
hash of nothing as proof; an empty table gives no rows.  Other columns of the
input, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table

FANOUT = 16
#: Positions in one window, a multiple of ``FANOUT``.
BLOCK = 4096
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: One document in so many has its text lower-cased by :func:`tamper_check`.
TAMPER_MOD = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    """Lowercase hex sha256 of a string's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: Sequence[Column]) -> Column:
    """The leaf of a row with these fields."""
    def one(c):
        text = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return digest(F.concat(*map(one, fields)))


def positions(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``nodes`` with ``pos``, the rank from 0 in its ``grp`` by ``keys``, and ``n``, the rows of the group.

    ``keys`` must order all but equal rows.  The ranked rows and their counts by
    (partition, group) are written, so a lost executor changes no position.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in ("grp", *keys)]
    ranked = write_table(
        nodes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("idx", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "merkle-ranked")
    of_group = Window.partitionBy("its_grp")
    before = of_group.orderBy("its_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = write_table(
        ranked.groupBy(F.col("grp").alias("its_grp"), F.col("part").alias("its_part"))
        .agg(F.min("idx").alias("first"), F.count("*").alias("rows"))
        .select("its_grp", "its_part", "first", F.sum("rows").over(of_group).alias("n"),
                F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before")), "merkle-counts")
    return (ranked.join(counts, F.col("grp").eqNullSafe(F.col("its_grp")) & (F.col("part") == F.col("its_part")))
            .withColumn("pos", F.col("idx") - F.col("first") + F.col("before"))
            .drop("its_grp", "its_part", "first", "before", "part", "idx"))


def with_siblings(nodes: DataFrame) -> DataFrame:
    """``nodes(grp, pos, n, digest, ...)`` with ``left`` and ``right``: its run's nodes before and after it, end to end."""
    w = Window.partitionBy("grp", "block").orderBy("pos")
    slot = F.col("pos") % FANOUT
    run = F.least(F.lit(FANOUT), F.col("n") - F.col("pos") + slot)
    lags = [F.when(slot >= k, F.lag("digest", k).over(w)) for k in range(FANOUT - 1, 0, -1)]
    leads = [F.when(slot + k < run, F.lead("digest", k).over(w)) for k in range(1, FANOUT)]
    return (nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))
            .withColumns({"left": F.concat_ws("", *lags), "right": F.concat_ws("", *leads)}).drop("block"))


def parents(nodes: DataFrame) -> DataFrame:
    """The next level: groups of one node are done and have none."""
    first = with_siblings(nodes.where(F.col("n") > 1).select("grp", "pos", "n", "digest")).where(F.col("pos") % FANOUT == 0)
    return first.select("grp", F.floor(F.col("pos") / FANOUT).alias("pos"), F.ceil(F.col("n") / FANOUT).alias("n"),
                        digest(F.concat("digest", "right")).alias("digest"))


def levels(nodes: DataFrame) -> list[DataFrame]:
    """``nodes(grp, pos, n, digest, ...)`` and the levels above, up to the last group's single node."""
    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        out.append(write_table(parents(out[-1]), "merkle-level"))
        most = -(-most // FANOUT)
    return out


def tops(tree: Sequence[DataFrame]) -> DataFrame:
    """(grp, digest) of every group's single node."""
    done = [x.where(F.col("n") == 1).select("grp", "digest") for x in tree]
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def paths(tree: Sequence[DataFrame], above_top: DataFrame) -> DataFrame:
    """The rows of ``tree[0]`` with ``path`` (siblings of every level above them, upwards) and
    what ``above_top(grp, path, ...)`` says of their group, whose path follows."""
    told = [c for c in above_top.columns if c not in ("grp", "path")]
    tip = above_top.select(F.col("grp").alias("up_grp"), F.lit(-1).cast("long").alias("up"), F.col("path").alias("rest"), *told)
    above = tip
    for k in range(len(tree) - 1, -1, -1):
        nodes = with_siblings(tree[k]).withColumn("to", F.when(F.col("n") == 1, F.lit(-1)).otherwise(F.floor(F.col("pos") / FANOUT)).cast("long"))
        step = F.array(F.struct("left", "right"))
        joined = (nodes.join(above, F.col("grp").eqNullSafe(F.col("up_grp")) & (F.col("to") == F.col("up")))
                  .withColumn("path", F.when(F.col("n") == 1, F.col("rest")).otherwise(F.concat(step, "rest")).cast(_PATH)))
        if k == 0:
            return joined.drop("up_grp", "up", "rest", "to", "left", "right")
        above = joined.select(F.col("grp").alias("up_grp"), F.col("pos").alias("up"), F.col("path").alias("rest"), *told).unionByName(tip)


def manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns: Sequence[str] = COLUMNS,
             other: dict[str, Column] | None = None) -> DataFrame:
    """(id, grp, leaf, pos, n, subroot, root, path) of every row of ``df``.

    ``path`` has a (left, right) pair for every level up to the root.  ``other``
    replaces columns to give a second leaf, ``other_leaf``, of the same row; it has
    no part in the tree.
    """
    leaves = write_table(df.select(
        F.col(id_col).alias("id"), F.col(group_col).alias("grp"), leaf([F.col(c) for c in columns]).alias("digest"),
        *([leaf([other.get(c, F.col(c)) for c in columns]).alias("other_leaf")] if other else [])), "merkle-leaves")
    tree = levels(positions(leaves, ["id", "digest", *(["other_leaf"] if other else [])]))
    subroots = write_table(tops(tree), "merkle-subroots")
    over = levels(positions(subroots.select(F.lit(0).alias("grp"), F.col("grp").alias("of"), "digest"), ["of"]))
    root = tops(over).select("grp", F.col("digest").alias("root"), F.array().cast(_PATH).alias("path"))
    ends = write_table(paths(over, root).select(F.col("of").alias("grp"), F.col("digest").alias("subroot"), "root", "path"), "merkle-ends")
    return paths(tree, ends).withColumnRenamed("digest", "leaf")


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings of its path."""
    return F.aggregate(path, start, lambda at, s: digest(F.concat(s["left"], at, s["right"])))


def proof(path: Column) -> Column:
    """The siblings of a path, end to end."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def tamper_check(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``, verified after one document in ``TAMPER_MOD`` was lower-cased.

    (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), the
    first five of the untampered table.  A null id is never tampered with.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_MOD == 0, F.lit(False))
    lowered = F.when(hit, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    rows = manifest(docs, other={"text": lowered})
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", digest(proof(F.col("path"))).alias("proof_sha256"),
                       fold(F.col("other_leaf"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def _sql_leaf(text: str) -> str:
    def one(c):
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    return "sha256(" + " || ".join(one(text if c == "text" else c) for c in COLUMNS) + ")"


_SQL_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))))"""

#: The same in DuckDB: both trees by recursion, the fold step by step.
SQL = f"""
WITH RECURSIVE hit AS (
  SELECT *, CASE WHEN {_SQL_CRC32} % {TAMPER_MOD} = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END AS other FROM documents),
leaves AS (SELECT doc_id, source, {_sql_leaf('text')} AS leaf, {_sql_leaf('other')} AS other_leaf FROM hit),
doc AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, other_leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n FROM leaves),
up AS (
  SELECT 0 AS level, source, pos, n, leaf AS digest FROM doc
  UNION ALL
  SELECT level + 1, source, pos // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(digest, '' ORDER BY pos))
  FROM up WHERE n > 1 GROUP BY level, source, n, pos // {FANOUT}),
subroots AS (
  SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(digest, '' ORDER BY pos))
  FROM top WHERE n > 1 GROUP BY level, n, pos // {FANOUT}),
low AS (
  SELECT level, source, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM up WHERE n > 1
  WINDOW w AS (PARTITION BY level, source, pos // {FANOUT} ORDER BY pos)),
high AS (
  SELECT level, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM top WHERE n > 1
  WINDOW w AS (PARTITION BY level, pos // {FANOUT} ORDER BY pos)),
climb AS (
  SELECT doc_id, source, pos AS row_pos, leaf, 0 AS level, pos, other_leaf AS cur, '' AS proof FROM doc
  UNION ALL
  SELECT c.doc_id, c.source, c.row_pos, c.leaf, c.level + 1, c.pos // {FANOUT}, sha256(x.l || c.cur || x.r), c.proof || x.l || x.r
  FROM climb c JOIN low x ON c.level = x.level AND c.source IS NOT DISTINCT FROM x.source AND c.pos = x.pos),
half AS (
  SELECT c.doc_id, c.source, c.row_pos, c.leaf, s.digest AS subroot, s.pos, c.cur, c.proof
  FROM climb c JOIN up u ON u.n = 1 AND c.source IS NOT DISTINCT FROM u.source AND c.level = u.level
  JOIN subroots s ON c.source IS NOT DISTINCT FROM s.source),
rest AS (
  SELECT doc_id, source, row_pos, leaf, subroot, 0 AS level, pos, cur, proof FROM half
  UNION ALL
  SELECT c.doc_id, c.source, c.row_pos, c.leaf, c.subroot, c.level + 1, c.pos // {FANOUT}, sha256(x.l || c.cur || x.r), c.proof || x.l || x.r
  FROM rest c JOIN high x ON c.level = x.level AND c.pos = x.pos)
SELECT c.doc_id, c.leaf, c.subroot, t.digest AS root, sha256(c.proof) AS proof_sha256, c.cur AS folded_root, c.cur = t.digest AS verified
FROM rest c JOIN top t ON t.n = 1 AND c.level = t.level
"""
