"""R3 as the load generator reports it: live windows that run from the previous report.

The rule has one clock for the whole log, so a stateful operator would put every request in one task.  Here
a micro-batch is reported as a batch is (``operators.reported``: pieces of time in parallel), and what goes
from batch to batch is the state behind it: when the next report is due, the previous report and the
requests since.  Requests younger than ``delay`` before the latest one are held back, counted by
microsecond, and join the next batch; older ones are closed.  A request that comes later than that is in no
window; the state counts it as late.

A batch commits its reports, its held requests and last its state under its batch id.  Each reads only the
entries of the batch before, so a batch that is run again after a failure replaces its own entries with the
same ones, and reports without a committed state are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reported as RP
from ..session import staging, staging_path, write_table
from ..sources.runlog import RunLog


class ReportedLog:
    """Reports, held requests and states below ``path`` (a folder that all machines see).

    ``zone`` is the type of the log's times, read in the time zone of ``spark``."""

    def __init__(self, spark: SparkSession, path: str, width_seconds: float = 1, delay_seconds: float = 3600,
                 zone: str = "timestamp_ntz", piece_events: int = RP.PIECE_EVENTS):
        self.spark, self.zone, self.piece_events = spark, zone, piece_events
        self.width, self.delay = (int(round(x * 1_000_000)) for x in (width_seconds, delay_seconds))
        self._reports = RunLog(spark, f"{path}/reports", "start long, end long, requests long")
        self._held = RunLog(spark, f"{path}/held", "t long, n long")
        self._states = RunLog(spark, f"{path}/states", "at long, since long, pending long, horizon long, late long")

    def sink(self, ts: str = "ts") -> Callable[[DataFrame, int], None]:
        """The function for ``foreachBatch``."""
        def write(batch: DataFrame, batch_id: int) -> None:
            key, before = f"batch-{batch_id}", f"batch-{batch_id - 1}"
            state, held = None, None
            if batch_id:
                state = self._states.entry(before).first()
                if state is None:
                    raise RuntimeError(f"{before} is not in the log; its checkpoint belongs to another log")
                held = self._held.entry(before).select("t", "n")
            with staging(self.spark):
                self._write(RP.request_times(batch, ts), held, state, key, batch_id)
            if batch_id > 1:
                self._held.drop(f"batch-{batch_id - 2}")
        return write

    def _write(self, times: DataFrame, held: DataFrame | None, state, key: str, batch_id: int) -> None:
        spark = self.spark
        new = spark.read.schema("t long, n long").parquet(_written(times))
        horizon, late = (state["horizon"], state["late"]) if state else (None, 0)
        if horizon is not None:
            late += new.where(F.col("t") < horizon).agg(F.sum("n")).first()[0] or 0
            new = new.where(F.col("t") >= horizon)
        latest = new.agg(F.max("t")).first()[0]
        if latest is not None:
            horizon = max(horizon if horizon is not None else latest - self.delay, latest - self.delay)
        every = write_table((new.unionByName(held) if held is not None else new).groupBy("t").agg(F.sum("n").alias("n")), "reported-times")
        closed = every.where(F.col("t") < F.lit(horizon).cast("long"))
        clock = (state["at"], state["since"], state["pending"]) if state and state["at"] is not None else None
        found, clock = RP.reports(closed, self.width, clock, self.piece_events)
        self._reports.append(key, found, batch_id, files=None)
        self._held.append(key, every.where(F.coalesce(F.col("t") >= F.lit(horizon).cast("long"), F.lit(True))), batch_id, files=None)
        row = (*(clock or (None, None, None)), horizon, late)
        self._states.append(key, spark.createDataFrame([row], self._states.schema), batch_id)

    def _last(self) -> str | None:
        done = self._states.keys()
        return max(done, key=lambda k: int(k.removeprefix("batch-"))) if done else None

    def late(self) -> int:
        """Requests that came behind the delay and are in no window."""
        last = self._last()
        return self._states.entry(last).first()["late"] if last else 0

    def read(self) -> DataFrame:
        """``window_start, window_end, requests, rate_per_sec`` of the reports so far."""
        return RP.windows(self._reports.table(self._states.keys()), self.zone)

    def flush(self) -> DataFrame:
        """The windows that the held requests close (``closed``) and the open last one, which no request has
        reported (its ``window_end`` is the last request).  Nothing is written: the stream may go on."""
        last = self._last()
        if last is None:
            return RP.windows(self._reports.table(), self.zone).withColumn("closed", F.lit(True))
        state, held = self._states.entry(last).first(), self._held.entry(last).select("t", "n")
        clock = (state["at"], state["since"], state["pending"]) if state["at"] is not None else None
        found, clock = RP.reports(held, self.width, clock, self.piece_events)
        end = held.agg(F.max("t")).first()[0]  # the latest request is always held
        out = RP.windows(found, self.zone).withColumn("closed", F.lit(True))
        if not clock or not clock[2]:
            return out
        rest = self.spark.createDataFrame([(clock[1], end, clock[2])], "start long, end long, requests long")
        return out.unionByName(RP.windows(rest, self.zone).withColumn("closed", F.lit(False)))


def _written(times: DataFrame) -> str:
    """The micro-batch, read once: a frame of it must not outlive the batch."""
    path = staging_path(times.sparkSession, "reported-batch")
    times.write.parquet(path)
    return path


def run_reported(stream: DataFrame, log: ReportedLog, checkpoint: str | None = None, ts: str = "ts",
                 timeout_seconds: float | None = None) -> None:
    """Report everything that is available now; with the same checkpoint and log a later run goes on."""
    query = (stream.writeStream.foreachBatch(log.sink(ts))
             .option("checkpointLocation", checkpoint or staging_path(stream.sparkSession, "reported-checkpoint"))
             .trigger(availableNow=True).start())
    if timeout_seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_seconds):
        query.stop()
        raise TimeoutError(f"reports still running after {timeout_seconds} s")
