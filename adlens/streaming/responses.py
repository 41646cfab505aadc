"""R5 live: the response log, each micro-batch written once.

Every batch is an entry of a run log under its batch id, committed as a whole.  A
batch that Structured Streaming runs again after a failure replaces its own entry, so
the log holds each response once although the sink itself only promises "at least once".
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ..session import staging_path
from ..sources.runlog import RunLog


def response_sink(log: RunLog, columns: Sequence[str] = ("visitor_id", "content")) -> Callable[[DataFrame, int], None]:
    """The function for ``foreachBatch``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        log.append(f"batch-{batch_id}", batch.select(*columns), batch_id, files=None)
    return write


def run_responses(stream: DataFrame, log: RunLog, checkpoint: str | None = None, timeout_seconds: float | None = None) -> None:
    """Write everything that is available now to the log; with the same checkpoint a later run goes on."""
    query = (stream.writeStream.foreachBatch(response_sink(log, log.schema.names))
             .option("checkpointLocation", checkpoint or staging_path(stream.sparkSession, "responses-checkpoint"))
             .trigger(availableNow=True).start())
    if timeout_seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_seconds):
        query.stop()
        raise TimeoutError(f"responses still running after {timeout_seconds} s")
