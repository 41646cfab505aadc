"""Session helpers.

The library never owns the session in production: the caller builds it and
the cluster names a shared folder in ``spark.checkpoint.dir``.  ``local_session``
is only for tests and the local benchmark.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str | None = None) -> SparkSession:
    """A local session tuned for small data: AQE on, UI off, UTC clock."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("adlens")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def scale_conf(input_bytes: float, total_cores: int, shuffle_ratio: float = 0.1,
               target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Session settings for a large run, derived from the input size.

    * scan splits of ``target_partition_bytes`` (column-pruned parquet reads
      stay well inside one executor core's memory share);
    * initial shuffle partitions sized for the largest expected shuffle
      (``shuffle_ratio`` of the input: pairs are pre-aggregated before any
      shuffle), at least 2 waves of the cluster, AQE coalescing the rest;
    * AQE skew-join splitting on, so a key holding a large share of a join
      side is split across tasks.

    The caller applies them when building its session; the library never
    changes the settings of a session it is given.
    """
    shuffle_bytes = input_bytes * shuffle_ratio
    partitions = max(2 * total_cores, int(shuffle_bytes // target_partition_bytes) + 1)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only where it is unset.

    On a cluster the folder must be shared storage, named by the cluster in
    ``spark.checkpoint.dir``; where that is unset it lies in the warehouse, and
    only a ``local`` master falls back to a private temporary folder.  A
    ``file:`` folder may be a mount that all machines have, so on a cluster it
    is tried out (``_holds_all``) and refused where it does not hold what the
    executors write.  Executors of a ``local-cluster`` master are processes of
    their own: a path may mean another folder to each of them.
    """
    sc = spark.sparkContext
    one_process = sc.master.partition("[")[0] == "local"
    current = sc.getCheckpointDir()
    if not current:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not one_process:
            configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/adlens-checkpoints"
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="adlens-ckpt-"))
        current = sc.getCheckpointDir()
    if not one_process and current.startswith("file:"):
        refused = f"the checkpoint folder {current} is local to each executor; name a shared one"
        try:
            held = _holds_all(spark, current)
        except Exception as e:  # noqa: BLE001 - whatever keeps the folder from being used
            raise RuntimeError(refused) from e
        if not held:
            raise RuntimeError(refused)
    return current


#: Tasks that try a folder out, at most.
TRIED_BY = 256
_held: dict[tuple[str, str], bool] = {}


def _holds_all(spark: SparkSession, folder: str) -> bool:
    """Whether all rows that executors write below ``folder`` are found there (tried once an application)."""
    sc = spark.sparkContext
    tasks = max(2, min(sc.defaultParallelism, TRIED_BY))
    key = (sc.applicationId, folder)
    if key not in _held:
        path = f"{folder.rstrip('/')}/adlens-staging/tried-{uuid.uuid4().hex}"
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        _held[key] = spark.read.parquet(path).count() == tasks
        _drop(spark, path)
    return _held[key]


def _drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_staged: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/adlens-staging/{name}-{uuid.uuid4().hex}"
    mine = _staged.get()
    if mine is not None:
        mine.append(path)
    return path


def in_staging() -> bool:
    """Whether the caller is inside a ``staging`` block."""
    return _staged.get() is not None


def modified(spark: SparkSession, *paths: str) -> tuple:
    """Bytes and time of change of files or folders, to tell whether data are still the same."""
    out = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        out.append((fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()) if fs.exists(p) else None)
    return tuple(out)


@contextmanager
def staging(spark: SparkSession):
    """Drop the tables staged inside the block at its end.

        with staging(spark):
            flows.campaign_training_rows(...).write.parquet(target)

    Frames made inside read those tables, so write or collect results before
    the block ends.  Without the block staged tables stay (a returned lazy
    frame still needs them) and the folder ``adlens-staging`` is the caller's
    to purge.
    """
    mine: list[str] = []
    token = _staged.set(mine)
    try:
        yield mine
    finally:
        _staged.reset(token)
        for path in mine:
            _drop(spark, path)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` once as a table in the shared folder.

    For inputs that are scanned many times: a lost executor costs a re-read of
    the table, not the whole lineage.  The plan runs once, under AQE.
    """
    return write_table(df, "materialized")


#: Rows per partition of a fit input, and the partitions up to which small
#: inputs are spread; beyond, a partition takes ``FIT_ROWS_LARGE`` rows.
FIT_ROWS, FIT_SPREAD, FIT_ROWS_LARGE = 4096, 64, 250_000


def fit_partitions(rows: int) -> int:
    """Partitions of a fit input: a function of its row count alone."""
    return max(1, min(-(-rows // FIT_ROWS), FIT_SPREAD), -(-rows // FIT_ROWS_LARGE))


def fit_layout(df: DataFrame) -> DataFrame:
    """``df`` written once and laid out for an iterative fit.

    Bagging and k-means|| draw per partition, so a fit's result depends on
    which rows stand where.  Here that follows from the rows alone: their
    number gives the partitions, a hash of all columns the partition, and all
    columns the order, whatever the cores, the session or the input's layout.
    """
    # not above: they bring pandas, and Python workers that import this module would hold it
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import VectorUDT
    out = materialize(df)
    keys = [vector_to_array(f.name) if isinstance(f.dataType, VectorUDT) else F.col(f.name) for f in out.schema.fields]
    return out.repartition(fit_partitions(out.count()), *keys).sortWithinPartitions(*keys)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    For intermediates read by several branches of a plan: one pass computes
    them, readers get column pruning, and the planner sees the real size.
    """
    path = staging_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


#: Bytes up to which a lookup table is broadcast: the sum of its strings and
#: of 16 bytes for every other value, so long keywords count in full.
MAX_BROADCAST_BYTES = 64 << 20


def checked_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES,
                      name: str = "lookup") -> DataFrame:
    """Broadcast ``df`` only when its bytes are proven few.

    The frame is written once (``write_table``) and its bytes are summed over
    the written rows, so the join reads exactly the rows measured.  Above the
    bound there is no hint and the join stays a (skew-aware) sort-merge join.
    Deciding before the join avoids shuffling the large side only to learn at
    runtime that the small side could have been broadcast.
    """
    small = write_table(df, name)
    size = F.lit(0).cast("long")
    for c, kind in small.dtypes:
        size = size + (F.coalesce(F.octet_length(c), F.lit(0)) if kind == "string" else F.lit(16)) + F.lit(16)
    measured = small.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(small) if measured <= max_bytes else small


def in_parallel(fn: Callable[[Any], Any], items: Iterable[Any], parallelism: int) -> list[Any]:
    """``[fn(x) for x in items]``, ``parallelism`` at a time (each submits Spark jobs)."""
    if parallelism <= 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return [f.result() for f in [pool.submit(copy_context().run, fn, x) for x in items]]
