"""Keyword statistics that follow a growing folder.

Each update reads only files that no earlier update has read, reduces them to one
partial state per keyword (count and sum, which add up), and commits the states
and then the list of files under one key.  States count once their file list is
committed, so a run that dies in between leaves nothing behind, its files are read
again, and a file that is offered twice counts once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keywords import keyword_qi
from .runlog import RunLog
from .text import read_keyword_rows


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Full paths of the data files directly below ``folder`` (names that begin with '_' or '.' are none)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    return sorted(s.getPath().toString() for s in found if s.isFile() and s.getPath().getName()[0] not in "_.")


class IncrementalKeywordStats:
    """Keyword statistics of all files seen so far, kept below ``path`` (a shared folder).

    One writer at a time; any number of readers.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.files = RunLog(spark, f"{path.rstrip('/')}/files", "file string")
        self.states = RunLog(spark, f"{path.rstrip('/')}/states", "keyword string, n long, sum_qi double")

    def update(self, files: Iterable[str]) -> int:
        """Add files of keyword records; returns how many were new."""
        offered = self.spark.createDataFrame([(f,) for f in dict.fromkeys(files)], "file string")
        # the list of files stays on the cluster; only new names come back
        new = sorted(r["file"] for r in offered.join(self.files.table(), "file", "left_anti").collect())
        if not new:
            return 0
        key = hashlib.md5("\n".join(new).encode()).hexdigest()
        rows = keyword_qi(read_keyword_rows(self.spark, new))
        self.states.append(key, rows.groupBy("keyword").agg(F.count("*").alias("n"), F.sum("quota_impression").alias("sum_qi")), files=None)
        self.files.append(key, self.spark.createDataFrame([(f,) for f in new], "file string"))
        return len(new)

    def stats(self) -> DataFrame:
        """``keyword, n, avg_qi`` over all committed files, from the states alone."""
        committed = self.files.table().select("entry").distinct()
        return (self.states.table().join(committed, "entry", "left_semi").groupBy("keyword")
                .agg(F.sum("n").alias("n"), (F.sum("sum_qi") / F.sum("n")).alias("avg_qi")))
