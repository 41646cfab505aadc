"""Forests of deep trees over many rows, each tree grown by one task that holds the rows as bins.

``pyspark.ml`` grows as many nodes a pass as their statistics have room for.  Deep trees over many rows
have millions of nodes, and every pass reads all rows.  Here the rows are binned once (``pack``), each task reads them
and grows trees of its own, and rows are scored while their tree grows: what leaves a task are sums of
predictions, whatever the nodes.  A forest is its recipe (``TaskForest``): the packed rows, seed, trees and depth
give the same trees again (``functions.trees``), so none is stored and a forest contains its smaller ones.

A task holds the rows it trains on, so this is for rows whose bins stay below ``MAX_PACKED_BYTES``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import trees as TR
from ..session import write_table

#: Rows up to which a ``pyspark.ml`` fit is taken, and bytes of packed rows up to which a task holds them.
SMALL_FIT_ROWS, MAX_PACKED_BYTES = 16_384, 256 << 20
#: Tasks of a forest for each core, so that a slow one does not hold up the others.
TASKS_PER_CORE = 2

_BLOCKS = "part int, seq int, rows int, label array<double>, row array<bigint>, bins array<binary>"


def thresholds(df: DataFrame, max_bins: int, features: str = "features") -> list[np.ndarray]:
    """The cuts of every feature (``trees.cuts``) over all rows; a feature's distinct values meet in one task."""
    width = len(df.select(_array(df, features).alias("x")).first()["x"])

    def walk(batches):
        import pyarrow as pa
        at, values, counts = None, [], []

        def done():
            t = TR.cuts(np.concatenate(values), np.concatenate(counts), max_bins)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([t.tolist()], pa.list_(pa.float64()))], ["f", "cuts"])
        for b in batches:
            f, v, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for i, j in zip(s := [0, *(np.flatnonzero(np.diff(f)) + 1), len(f)], s[1:]):
                if i == j:
                    continue
                if values and f[i] != at:
                    yield done()
                    values, counts = [], []
                at = int(f[i])
                values.append(v[i:j])
                counts.append(n[i:j])
        if values:
            yield done()

    found = (df.select(F.posexplode(_array(df, features)).alias("f", "v")).groupBy("f", "v").agg(F.count("*").alias("n"))
             .repartition(width, "f").sortWithinPartitions("f", "v").mapInArrow(walk, "f int, cuts array<double>"))
    by = {r["f"]: np.array(r["cuts"], dtype=np.float64) for r in found.collect()}
    return [by[f] for f in range(width)]


def _array(df: DataFrame, features: str):
    return vector_to_array(features) if isinstance(df.schema[features].dataType, VectorUDT) else F.col(features)


def packed_bytes(rows: int, cuts: Sequence[np.ndarray]) -> int:
    """Bytes of so many packed rows: their bins and label."""
    return rows * (8 + sum(np.dtype(TR.bin_type(t)).itemsize for t in cuts))


def pack(df: DataFrame, cuts: Sequence[np.ndarray], features: str = "features", label: str | None = "label", row: str | None = None) -> DataFrame:
    """Rows in blocks of columns, written once: their place (partition and batch), labels, ids and bins."""
    y = F.lit(0.0) if label is None else F.col(label).cast("double")
    y = F.when(y.isNull() | F.isnan(y), F.raise_error(F.lit("Labels MUST NOT be Null or NaN"))).otherwise(y)

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        for seq, b in enumerate(batches):
            n = b.num_rows
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, len(cuts))
            bins = [c.tobytes() for c in TR.binned(x, cuts)]
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([n], pa.int32()),
                *(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), b.column(i)) for i in (0, 1)),
                pa.array([bins], pa.list_(pa.binary()))], ["part", "seq", "rows", "label", "row", "bins"])

    got = df.select(y.alias("label"), (F.lit(0) if row is None else F.col(row)).cast("long").alias("row"), _array(df, features).alias("x"))
    return write_table(got.mapInArrow(blocks, _BLOCKS), "forest-rows")


@dataclass
class Packed:
    """Training rows, and test rows if any, as blocks."""
    table: DataFrame
    cuts: list[np.ndarray] = field(repr=False)
    rows: int
    test: DataFrame | None = None


def pack_for(train: DataFrame, test: DataFrame | None, max_bins: int, feature_subset: str = "auto", features: str = "features",
             label: str = "label") -> Packed | None:
    """The rows packed if trees are to be grown by tasks; None if the rows are few, too many for a task, or have categories."""
    if TR.subset_size(feature_subset, 1, 1) is None or _categories(train.schema[features].metadata):
        return None
    rows = train.count()
    if rows <= SMALL_FIT_ROWS:
        return None
    cuts = thresholds(train, max_bins, features)
    if packed_bytes(rows + (0 if test is None else test.count()), cuts) > MAX_PACKED_BYTES:
        return None
    return Packed(pack(train, cuts, features, label), cuts, rows, None if test is None else pack(test, cuts, features, label))


def _categories(metadata: dict) -> bool:
    return bool(set(metadata.get("ml_attr", {}).get("attrs", {})) & {"nominal", "binary"})


@dataclass
class TaskForest:
    """A forest: which trees of which depth grow from which rows."""
    packed: Packed = field(repr=False)
    num_trees: int
    depth: int
    seed: int
    feature_subset: str = "auto"
    bootstrap: bool = True
    rate: float = 1.0
    features: str = "features"
    label: str = "label"

    @property
    def getNumTrees(self) -> int:  # noqa: N802 - as pyspark.ml names it
        return self.num_trees

    def getMaxDepth(self) -> int:  # noqa: N802
        return self.depth

    @property
    def spark(self):
        return self.packed.table.sparkSession

    def _grown(self, columns, bins, y, tree):
        subset = TR.subset_size(self.feature_subset, len(columns), self.num_trees)
        return TR.grow(columns, bins, y, self.depth, subset, self.seed, tree, self.bootstrap, self.rate)

    def _tasks(self, test: DataFrame | None, run, schema: str) -> DataFrame:
        """``run(trees, train, test)`` once for each task's trees, over all blocks; every task reads the written blocks itself."""
        tasks = min(self.num_trees, TASKS_PER_CORE * self.spark.sparkContext.defaultParallelism)
        ends = [i * self.num_trees // tasks for i in range(tasks + 1)]
        blocks, types = self.packed.table.withColumn("kind", F.lit(0)), [TR.bin_type(t) for t in self.packed.cuts]
        if test is not None:
            blocks = blocks.unionByName(test.withColumn("kind", F.lit(1)))
        blocks = blocks.select("kind", "part", "seq", "rows", F.when(F.col("kind") == 0, F.col("label")).alias("label"), "bins").coalesce(1)

        def of(first: int, end: int):
            def task(batches):
                yield from run(range(first, end), *_unpacked(batches, types))
            return blocks.mapInArrow(task, schema)
        # parts that all have a single partition are laid into one by Spark 4.1's union; one without rows and with two keeps them apart
        out = self.spark.range(0, 2, 1, 2).mapInArrow(lambda batches: iter(()), schema)
        for first, end in zip(ends, ends[1:]):
            out = out.unionAll(of(first, end))
        return out

    def scores(self, test: DataFrame, points: Sequence[tuple[int, int]]) -> DataFrame:
        """(part, seq, num_trees, depth, prediction) of the blocks of ``test`` by the first trees, cut at a depth, for each
        (trees, depth) of ``points``; one growth serves them all."""
        counts, depths = sorted({t for t, _ in points}), sorted({d for _, d in points})
        if counts[-1] > self.num_trees or depths[-1] > self.depth:
            raise ValueError(f"{points} go beyond the {self.num_trees} trees of depth {self.depth}")
        bins, wanted, grown = [len(t) + 1 for t in self.packed.cuts], set(points), self._recipe()

        def run(trees, train, blocks):
            import pyarrow as pa
            columns, y, _ = train
            mean = y.mean() if len(y) else 0.0
            test_columns, _, places = blocks
            n, sums = int(places[:, 2].sum()), {}
            for tree in trees:
                if tree >= counts[-1]:
                    break
                upto = next(c for c in counts if tree < c)
                for depth, value in TR.score(grown._grown(columns, bins, y - mean, tree), test_columns, n, depths):
                    if (upto, depth) not in sums:
                        sums[upto, depth] = np.zeros(n)
                    sums[upto, depth] += value + mean
            ends = np.cumsum(places[:, 2])
            for (upto, depth), s in sums.items():
                for (part, seq, rows), end in zip(places, ends):
                    yield pa.RecordBatch.from_arrays([
                        *(pa.array([int(v)], pa.int32()) for v in (part, seq, depth, upto, trees[0])),
                        pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), pa.array(s[end - rows:end]))],
                        ["part", "seq", "depth", "upto", "first", "sums"])

        def added(table):
            import pyarrow as pa
            rows = sorted(zip(*(table.column(c).to_pylist() for c in ("upto", "first")), range(table.num_rows)))
            total, out = 0.0, []
            part, seq, depth = (table.column(c)[0].as_py() for c in ("part", "seq", "depth"))
            sums = table.column("sums").combine_chunks()
            for c in counts:
                for upto, _, i in rows:
                    if upto == c:
                        total = total + sums[i].values.to_numpy()
                if (c, depth) in wanted:
                    out.append((c, total / c))
            return pa.table({
                "part": pa.array([part] * len(out), pa.int32()), "seq": pa.array([seq] * len(out), pa.int32()),
                "num_trees": pa.array([c for c, _ in out], pa.int32()), "depth": pa.array([depth] * len(out), pa.int32()),
                "prediction": pa.array([p for _, p in out], pa.list_(pa.float64()))})

        parts = self._tasks(test, run, "part int, seq int, depth int, upto int, first int, sums array<double>")
        return parts.groupBy("part", "seq", "depth").applyInArrow(added, "part int, seq int, num_trees int, depth int, prediction array<double>")

    def _recipe(self) -> TaskForest:
        """Without the tables, as tasks take it."""
        return replace(self, packed=None)

    def errors(self, points: Sequence[tuple[int, int]] | None = None) -> DataFrame:
        """(num_trees, max_depth, mse) on the packed test rows, by default of the whole forest."""
        points = [(self.num_trees, self.depth)] if points is None else points
        test = self.packed.test.select("part", "seq", "label")
        both = self.scores(self.packed.test, points).join(test, ["part", "seq"])
        square = F.aggregate(F.zip_with("label", "prediction", lambda y, p: (y - p) * (y - p)), F.lit(0.0), lambda a, x: a + x)
        found = (both.groupBy("num_trees", F.col("depth").alias("max_depth"))
                 .agg((F.sum(square) / F.sum(F.size("label"))).alias("mse")))
        wanted = self.spark.createDataFrame(sorted(set(points)), "num_trees int, max_depth int")
        return wanted.join(found, ["num_trees", "max_depth"], "left")  # without test rows the errors are null

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``, in as many runs as keep its packed rows below the bound."""
        numbered = write_table(df.withColumn("_row", F.monotonically_increasing_id()), "forest-scored")
        runs = max(1, -(-packed_bytes(numbered.count(), self.packed.cuts) // MAX_PACKED_BYTES))
        parts = []
        for i in range(runs):
            test = pack(numbered.where(F.pmod("_row", F.lit(runs)) == i), self.packed.cuts, self.features, None, "_row")
            found = self.scores(test, [(self.num_trees, self.depth)]).join(test.select("part", "seq", "row"), ["part", "seq"])
            parts.append(found.select(F.explode(F.arrays_zip("row", "prediction")).alias("r")).select(F.col("r.row").alias("_row"), "r.prediction"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return numbered.join(out, "_row").drop("_row")

    def nodes(self) -> DataFrame:
        """All nodes, as ``forest_table.forest_nodes`` gives them."""
        bins, cuts, grown = [len(t) + 1 for t in self.packed.cuts], self.packed.cuts, self._recipe()

        def run(trees, train, _):
            import pyarrow as pa
            columns, y, _ = train
            mean = y.mean() if len(y) else 0.0
            for tree in trees:
                first = 0
                for level in grown._grown(columns, bins, y - mean, tree):
                    leaf, n = level.feature < 0, len(level.value)
                    at = [0.0 if f < 0 else cuts[f][c] for f, c in zip(level.feature, level.cut)]
                    left = first + n + level.child
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, tree, np.int32)), pa.array(np.arange(first, first + n, dtype=np.int32)),
                        pa.array(level.feature.astype(np.int32), mask=leaf), pa.array(np.array(at), mask=leaf),
                        pa.array(left.astype(np.int32), mask=leaf), pa.array((left + 1).astype(np.int32), mask=leaf),
                        pa.array(level.value + mean), pa.array(level.rows.astype(np.int64)), pa.array(level.gain, mask=leaf)],
                        ["tree", "node", "feature", "threshold", "left_node", "right_node", "value", "rows", "gain"])
                    first += n

        return self._tasks(None, run, "tree int, node int, feature int, threshold double, left_node int, right_node int, value double, rows long, gain double")

    @property
    def totalNumNodes(self) -> int:  # noqa: N802
        return self.nodes().count()


def _unpacked(batches, types):
    """Training and test rows of all blocks in the order of their places: columns, labels and (part, seq, rows)."""
    sides = ([], [])
    for b in batches:
        kind, part, seq, rows = (b.column(i).to_numpy() for i in range(4))
        for i in range(b.num_rows):
            label = b.column(4)[i].values
            columns = [np.frombuffer(c.as_buffer(), t).copy() for c, t in zip(b.column(5)[i].values, types)]
            sides[kind[i]].append(((part[i], seq[i], rows[i]), columns, None if label is None else label.to_numpy().copy()))
    out = []
    for kind, blocks in enumerate(sides):
        blocks.sort(key=lambda x: x[0][:2])
        columns = []
        for f, t in enumerate(types):  # a column's pieces go once it is whole
            columns.append(np.concatenate([b[1][f] for b in blocks] or [np.zeros(0, t)]))
            for b in blocks:
                b[1][f] = None
        y = np.concatenate([b[2] for b in blocks] or [np.zeros(0)]) if kind == 0 else None
        out.append((columns, y, np.array([b[0] for b in blocks], np.int64).reshape(-1, 3)))
        blocks.clear()
    return out
