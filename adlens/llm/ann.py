"""Approximate nearest neighbours: a forest of random-projection trees.

A tree halves its points again and again at the median of their projection on
a random direction (the difference of two points' centres).  Trees are fitted,
one task each, on at most ``SAMPLE`` distinct vectors (lowest hash first); every
vector is then sent down every tree, so every row is indexed.  A query searches
all trees through one priority queue: the most promising unvisited branch of
any tree is followed next, until ``LEAVES`` leaves have been opened.  Each leaf
block meets its queries once, scores all its vectors exactly and passes on each
query's best.

Equal vectors are one point of the index (with the few smallest ids that can
matter), so copies never crowd a leaf; a leaf of more than ``BLOCK`` points is
dealt out as several blocks, and so are the queries that visit a leaf beyond
``ASKED``: a task holds one block of each and scores ``SLICE`` queries at a
time, however many vectors and queries meet in a dense region.  The forest is bounded by ``TREES * 2 * SAMPLE /
LEAF`` nodes, and so is its broadcast; the leaf counts that reach the driver
likewise.

Vectors that are null or empty, zero, of another length than most, or that hold
null or non-finite components take no part, neither as queries nor as
candidates; rows with a null id neither.  Rows that repeat an id and its vector
count once.  Fewer candidates than ``k`` give fewer rows; an empty table none.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table

# 288 of at most 16 * 512 leaves.  On vectors without any structure (the worst
# case, and what the synthetic table holds) that finds over nine tenths of the
# true neighbours at every table size, as the number of leaves is bounded.
TREES, LEAF, LEAVES, SAMPLE, BLOCK = 16, 128, 288, 50_000, 4096
#: Queries of a leaf that one task holds, and those it scores at a time.
ASKED, SLICE = 16_384, 256
SEED = 11


@dataclass
class Tree:
    """Inner nodes ``0 .. n - 1``; child ``-1 - i`` is leaf ``i``."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray  # (n, 2): left (margin < 0), right
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row of ``x``, level by level."""
        at = np.zeros(len(x), dtype=np.int64) if len(self.offsets) else np.full(len(x), -1, np.int64)
        while True:
            inner = np.flatnonzero(at >= 0)
            if len(inner) == 0:
                return -1 - at
            node = at[inner]
            margin = np.einsum("ij,ij->i", x[inner], self.normals[node]) - self.offsets[node]
            at[inner] = self.children[node, (margin >= 0).astype(np.int64)]


def fit_tree(x: np.ndarray, seed: int, leaf: int = LEAF) -> Tree:
    """Split until no node has more than ``leaf`` points."""
    rng = np.random.default_rng([SEED, seed])
    normals, offsets, children = [], [], []
    leaves = 0
    todo = [(np.arange(len(x)), None, 0)]
    while todo:
        rows, parent, side = todo.pop()
        if len(rows) <= leaf:
            name = -1 - leaves
            leaves += 1
        else:
            pick = x[rng.choice(rows, min(len(rows), 32), replace=False)]
            a, b = pick[0], pick[1]
            for _ in range(3):  # two centres of a few points
                near = ((pick - a) ** 2).sum(1) < ((pick - b) ** 2).sum(1)
                if near.all() or not near.any():
                    break
                a, b = pick[near].mean(0), pick[~near].mean(0)
            normal = a - b
            size = float(np.sqrt(normal @ normal))
            normal = normal / size if size > 1e-9 else rng.standard_normal(x.shape[1])
            normal = normal.astype(np.float32)
            along = x[rows] @ normal
            cut = np.float32(np.median(along))
            right = along >= cut
            if right.all() or not right.any():
                right = np.zeros(len(rows), dtype=bool)
                right[np.argsort(along, kind="stable")[len(rows) // 2:]] = True
            name = len(offsets)
            normals.append(normal)
            offsets.append(cut)
            children.append([0, 0])
            todo += [(rows[~right], name, 0), (rows[right], name, 1)]
        if parent is not None:
            children[parent][side] = name
    dim = x.shape[1] if x.ndim == 2 else 0
    return Tree(np.array(normals, dtype=np.float32).reshape(len(normals), dim), np.array(offsets, dtype=np.float32),
                np.array(children, dtype=np.int64).reshape(-1, 2), leaves)


def search(forest: list[Tree], q: np.ndarray, leaves: int = LEAVES) -> list[tuple[int, int]]:
    """(tree, leaf) of the most promising leaves of all trees, best first."""
    # projections on all nodes of a tree at once: the queue then only compares
    margins = [t.normals @ q - t.offsets for t in forest]
    queue = [(-np.inf, i, 0 if len(t.offsets) else -1) for i, t in enumerate(forest)]
    heapq.heapify(queue)
    found = []
    while queue and len(found) < leaves:
        bound, tree, node = heapq.heappop(queue)
        while node >= 0:
            m = float(margins[tree][node])
            near, far = (1, 0) if m >= 0 else (0, 1)
            heapq.heappush(queue, (max(bound, abs(m)), tree, int(forest[tree].children[node, far])))
            node = int(forest[tree].children[node, near])
        found.append((tree, -1 - node))
    return found


def _rows(col) -> np.ndarray:
    """A column of equal-length packed vectors as a matrix."""
    raw = col.to_pylist() if isinstance(col, (pa.Array, pa.ChunkedArray)) else list(col)
    return np.frombuffer(b"".join(raw), dtype="<f4").reshape(len(raw), -1)


def points(df: DataFrame, id_col: str, vec_col: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(points: point, ids, packed), (members: vec_id, point): the valid rows.

    A point is a distinct vector, named by its smallest id; ``ids`` are its
    k + 1 smallest.  ``packed`` has the components as little-endian floats.
    """
    v = F.col("vec")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = (df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("vec"))
            .where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda c: c != 0))
            .distinct())
    usual = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("vec") == (usual["n"] if usual else 0))

    def pack(batches):
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<f4")
            flat = (flat + np.float32(0.0)).reshape(len(lists), -1) if len(lists) else flat  # -0.0 is 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in flat], pa.binary())],
                                             ["vec_id", "packed"])

    packed = write_table(rows.mapInArrow(pack, "vec_id long, packed binary"), "ann-rows")
    first = Window.partitionBy("packed").orderBy("vec_id")
    few = packed.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    pts = write_table(few.groupBy("packed").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
                      .select(F.col("ids")[0].alias("point"), "ids", "packed"), "ann-points")
    return pts, packed


def fit_forest(pts: DataFrame, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> list[Tree]:
    """Fit one tree a task on the same bounded sample of the points."""
    spark = pts.sparkSession
    picked = pts.orderBy(F.xxhash64("point"), "point").limit(sample).select("point", "packed").toArrow()
    order = np.argsort(picked.column("point").to_numpy(), kind="stable")
    x = _rows(picked.column("packed"))[order] if len(picked) else np.zeros((0, 0), np.float32)
    if len(x):
        x = x / np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None].astype(np.float32)
    shared = spark.sparkContext.broadcast(x)

    def grow(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                t = fit_tree(shared.value, i, leaf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i]), pa.array([t.normals.astype("<f4").tobytes()], pa.binary()),
                     pa.array([t.offsets.astype("<f4").tobytes()], pa.binary()),
                     pa.array([t.children.astype("<i8").tobytes()], pa.binary()), pa.array([t.leaves])],
                    ["tree", "normals", "offsets", "children", "leaves"])

    rows = (spark.range(trees, numPartitions=trees)
            .mapInArrow(grow, "tree long, normals binary, offsets binary, children binary, leaves long").collect())
    dim = x.shape[1]
    return [Tree(np.frombuffer(bytes(r["normals"]), "<f4").reshape(len(r["offsets"]) // 4, dim),
                 np.frombuffer(bytes(r["offsets"]), "<f4"),
                 np.frombuffer(bytes(r["children"]), "<i8").reshape(-1, 2), r["leaves"])
            for r in sorted(rows, key=lambda r: r["tree"])]


def _unit(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    return wide / np.sqrt((wide * wide).sum(1))[:, None]


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``x`` with the same row of ``y``, in double precision."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def nearest(df: DataFrame, queries, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
            trees: int = TREES, leaf: int = LEAF, leaves: int = LEAVES, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of the rows for
    which ``queries`` (a condition on ``vec_id``) holds, by largest cosine,
    ties to the smaller id."""
    spark = df.sparkSession
    pts, members = points(df, id_col, vec_col, k)
    forest = spark.sparkContext.broadcast(fit_forest(pts, trees, leaf, sample))

    def index(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            x = _unit(_rows(b.column(1))).astype(np.float32)
            at = np.concatenate([t.leaf_of(x) for t in forest.value])
            n = len(forest.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(n), len(x))), pa.array(at), pa.concat_arrays([b.column(0)] * n)],
                ["tree", "leaf", "point"])

    def visit(batches):
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                q = _unit(np.frombuffer(raw, "<f4")[None])[0].astype(np.float32)
                seen = np.array(search(forest.value, q, leaves), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seen[:, 0]), pa.array(seen[:, 1]), pa.array(np.full(len(seen), p))],
                    ["tree", "leaf", "point"])

    asked = members.where(queries).select("vec_id", "packed")
    asked_points = asked.groupBy("packed").agg(F.min("vec_id").alias("query"))
    asked_points = write_table(asked_points.select("query", "packed"), "ann-queries")
    placed = write_table(pts.select("point", "packed").mapInArrow(index, "tree long, leaf long, point long"), "ann-index")
    wanted = write_table(asked_points.select("query", "packed").repartition(F.col("query"))
                         .mapInArrow(visit, "tree long, leaf long, point long").withColumnRenamed("point", "query"), "ann-visits")

    # one row per leaf that holds more than a block, of points or of queries: bounded like the forest
    def dealt(rows, most, name):
        return F.broadcast(rows.groupBy("tree", "leaf").count().where(F.col("count") > most)
                           .select("tree", "leaf", F.ceil(F.col("count") / most).cast("int").alias(name)))

    def spread(rows, key):
        """Every row in one block of its own side (``own``) and with each block of the other side."""
        own, other = ("blocks", "parts") if key == "point" else ("parts", "blocks")
        return (rows.join(blocks, ["tree", "leaf"], "left").join(parts, ["tree", "leaf"], "left")
                .withColumn(own[:-1], F.pmod(F.xxhash64(key), F.coalesce(own, F.lit(1))).cast("long"))
                .withColumn(other[:-1], F.explode(F.sequence(F.lit(0).cast("long"), (F.coalesce(other, F.lit(1)) - 1).cast("long"))))
                .drop("blocks", "parts"))

    blocks, parts = dealt(placed, BLOCK, "blocks"), dealt(wanted, ASKED, "parts")
    left = spread(placed.join(wanted.select("tree", "leaf").distinct(), ["tree", "leaf"], "left_semi"), "point").join(
        pts.select("point", "packed"), "point")
    right = spread(wanted, "query").join(asked_points, "query")

    def rerank(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        """Each query's best k + 1 points of the block, ties all."""
        none = pd.DataFrame({"query": [], "point": [], "score": []}).astype(
            {"query": "int64", "point": "int64", "score": "float64"})
        if len(here) == 0 or len(there) == 0:
            return none
        x, y = _rows(here["packed"]), _rows(there["packed"])
        points_, queries_ = here["point"].to_numpy(), there["query"].to_numpy()
        unit, n = _unit(x).T, min(k + 1, len(x))
        out = []
        for at in range(0, len(y), SLICE):
            some = y[at:at + SLICE]
            rough = _unit(some) @ unit
            floor = np.partition(rough, len(x) - n, axis=1)[:, len(x) - n] - 1e-9
            q, p = np.nonzero(rough >= floor[:, None])
            out.append(pd.DataFrame({"query": queries_[at + q], "point": points_[p], "score": cosine(some[q], x[p])}))
        return pd.concat(out)

    keys = ["tree", "leaf", "block", "part"]
    scored = (left.groupBy(*keys).cogroup(right.groupBy(*keys))
              .applyInPandas(rerank, "query long, point long, score double"))
    best = scored.groupBy("query", "point").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    best = best.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k + 1)
    found = (best.join(pts.select("point", "ids"), "point")
             .select("query", "score", F.explode("ids").alias("vec_id")))
    by_rank = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    # an own row can take one place of k + 1
    found = found.withColumn("n", F.row_number().over(by_rank)).where(F.col("n") <= k + 1).drop("n")
    of = asked.withColumnRenamed("vec_id", "query_id").join(asked_points, "packed").select("query_id", "query")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (of.join(found, "query").where(F.col("vec_id") != F.col("query_id"))
            .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
