"""Live throughput with Structured Streaming.

A file source over a folder of parquet request logs, an event-time watermark
and a tumbling window, append mode: a window is emitted once the watermark
passes its end, so late rows within the watermark still count and state for
closed windows is dropped.  The sink is a parquet folder with its own
checkpoint in the shared checkpoint folder, so a restarted query resumes
exactly where it stopped.

The aggregation keeps its state in ``spark.sql.shuffle.partitions``
partitions of the session that starts it, fixed at the first start (and kept
in its checkpoint; AQE does not re-partition streaming state).
``stream_session`` gives a session sharing the context with its own count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.requests import successful
from ..session import staging_path


def throughput_stream(stream: DataFrame, width_seconds: int = 3600,
                      watermark: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Streaming frame: ``window_start, window_end, requests, rate_per_sec``.

    ``withWatermark`` needs a TIMESTAMP column; a TIMESTAMP_NTZ input is cast
    (session time zone) and the window bounds are cast back.
    """
    ts_type = stream.schema[ts].dataType
    ntz = isinstance(ts_type, T.TimestampNTZType)
    tz = stream.sparkSession.conf.get("spark.sql.session.timeZone", "UTC")
    utc = tz in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")
    s = stream
    if ntz:
        # read the wall clock as UTC, whatever the session time zone
        wall = F.col(ts) if utc else F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(ts))
        s = stream.withColumn(ts, wall.cast("timestamp"))
    width_ms = width_seconds * 1000
    out = (successful(s.withWatermark(ts, watermark))
           .groupBy(F.window(ts, f"{width_seconds} seconds").alias("w"))
           .agg(F.count(F.lit(1)).alias("requests")))
    start, end = F.col("w.start"), F.col("w.end")
    if ntz:
        start, end = start.cast("timestamp_ntz"), end.cast("timestamp_ntz")
        if not utc:
            start = F.convert_timezone(F.lit(tz), F.lit("UTC"), start)
            end = F.convert_timezone(F.lit(tz), F.lit("UTC"), end)
    return out.select(start.alias("window_start"), end.alias("window_end"), "requests",
                      F.expr(f"(requests * 1000) div {width_ms}").alias("rate_per_sec"))


def stream_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session sharing ``spark``'s context, with its own state-partition count.

    The window counts of the throughput stream are bounded by the open windows,
    not by the data, so as many state partitions as cores are enough; the
    caller's session and its settings stay untouched.
    """
    s = spark.newSession()
    n = state_partitions or spark.sparkContext.defaultParallelism
    s.conf.set("spark.sql.shuffle.partitions", str(n))
    return s


def read_stream(spark: SparkSession, folder: str, schema: T.StructType,
                glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet file source over ``folder`` (optionally only files matching ``glob``)."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(folder)


def run_available(result: DataFrame, name: str, output: str | None = None,
                  checkpoint: str | None = None, timeout_seconds: float | None = None) -> str:
    """Run a streaming frame over everything available now, into a parquet folder.

    Returns the output folder; read it back with ``spark.read.parquet``.  A
    failed query raises; with ``timeout_seconds`` a query still running then
    is stopped and ``TimeoutError`` raised (it resumes from its checkpoint).
    """
    spark = result.sparkSession
    base = staging_path(spark, name)
    output = output or f"{base}/out"
    checkpoint = checkpoint or f"{base}/checkpoint"
    q = (result.writeStream.format("parquet").outputMode("append")
         .option("path", output).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    if timeout_seconds is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout_seconds):
        q.stop()
        raise TimeoutError(f"stream {name} still running after {timeout_seconds} s")
    return output
