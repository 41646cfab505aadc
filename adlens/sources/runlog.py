"""A run log that a stopped run resumes and a retry does not double.

The log is a folder with one parquet folder per key, ``entry=<key>``.  An entry is
written whole and counts once its commit marker stands, so a run that dies while writing
leaves nothing that readers see, and writing a key again replaces its rows.
``progress`` numbers the keys in the order of the run's plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class RunLog:
    """Rows of ``schema`` by key, below ``path`` (a folder that all machines see)."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self._full = T.StructType([T.StructField("entry", T.StringType()), T.StructField("progress", T.IntegerType()), *self.schema.fields])

    def _entry(self, key: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9._-]+", key):
            raise ValueError(f"keys are letters, digits, '.', '_' and '-': {key!r}")
        return f"{self.path}/entry={key}"

    def keys(self) -> set[str]:
        """Keys that are committed."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/entry=*/_SUCCESS"))
        return {s.getPath().getParent().getName().removeprefix("entry=") for s in found or []}

    def append(self, key: str, rows: DataFrame, progress: int = 0, files: int | None = 1) -> None:
        """Commit the rows of ``key``; rows of an earlier commit are replaced, so a retry adds nothing.

        Few rows go to one file; ``files=None`` leaves large ones in as many as they have partitions."""
        wanted = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        out = rows.select(F.lit(progress).cast("int").alias("progress"), *wanted)
        ((out.coalesce(files) if files else out)
         .write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(self._entry(key)))

    def entry(self, key: str) -> DataFrame:
        """The rows of one key; none if it is not committed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._entry(key)}/_SUCCESS")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._entry(key))

    def drop(self, key: str) -> None:
        """Remove the rows of one key."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._entry(key))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def table(self, among: set[str] | None = None) -> DataFrame:
        """``entry, progress`` and the logged columns of all committed keys, or of those ``among`` the given ones."""
        done = sorted(self.keys() if among is None else self.keys() & among)
        if not done:
            return self.spark.createDataFrame([], self._full)
        names = self._full.names
        return (self.spark.read.schema(T.StructType(self._full.fields)).option("basePath", self.path)
                .parquet(*[self._entry(k) for k in done]).select(*names))

    def run(self, points: Mapping[str, Any], make: Callable[[Any], DataFrame], stop_after: int | None = None) -> int:
        """Make and commit the points that are not yet in the log, in order; returns how many.

        ``stop_after`` ends after so many, as a run that is stopped and started again would."""
        done, made = self.keys(), 0
        for i, (key, point) in enumerate(points.items()):
            if key in done:
                continue
            if made == stop_after:
                break
            self.append(key, make(point), i)
            made += 1
        return made
