"""R2 as the load generator reports it: every window runs from the previous report.

The first successful request starts the clock.  A request reports when at least
``width`` has passed since the last report (or the start); the report counts the
requests since then, itself included, and their rate.  Requests after the last
report are in no window, as they never were.

The rule looks sequential, since a report depends on the one before it.  Here it
is a composition of maps:

1. *Pieces.*  Time is cut into pieces of equal length, at least one width each.  For
   every request of a piece, the last report that a report there leads to *within* the piece follows by
   pointer doubling over "first request at least one width later".
2. *Maps.*  A report before the piece is due less than a width after the piece begins, so it can only fall on
   the requests of the piece's first width or on the one behind them.  The piece's map takes each
   of these entries to the time the next report is due after the piece, and the requests
   counted since.
3. *Composition.*  ``FANOUT`` neighbouring maps become one, of the same form, level by level up to a
   single map; then the start is handed down: each level tells its children when the next
   report is due as they begin.
4. *Reports.*  Each piece follows its own entry.

A task holds one piece or ``FANOUT`` maps.  Requests of one microsecond are counted before any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_table
from .requests import successful

#: Distinct request times in a piece, on average, and maps that are composed at a time.
PIECE_EVENTS, FANOUT = 16_384, 64

_MAP = "id long, entries array<long>, due array<long>, tail array<long>, total long"
_STATE = "id long, at long, since long, pending long"


def _last(after: np.ndarray) -> np.ndarray:
    """For links to later places (len(after): none), the last place of each place's chain."""
    n = len(after)
    jump = np.append(np.where(after < n, after, np.arange(n)), n)
    while True:
        further = jump[jump]
        if (further == jump).all():
            return jump[:n]
        jump = further


def piece_map(ts: np.ndarray, n: np.ndarray, width: int, begins: int) -> tuple[list, list, list, int]:
    """Entries of a piece, when the report after it is due, and the requests since the last one in it."""
    last = _last(np.searchsorted(ts, ts + width))
    before = np.cumsum(n) - n
    total = int(n.sum())
    few = min(int(np.searchsorted(ts, begins + width)) + 1, len(ts))
    due, tail = ts[last[:few]] + width, total - before[last[:few]] - 1
    return ts[:few].tolist(), due.tolist(), tail.tolist(), total


def compose(maps: list[tuple], width: int, begins: int) -> tuple[list, list, list, int]:
    """One map of neighbouring ones, in order of time."""
    # entries of the first map, and the first request behind it
    ts = np.asarray(maps[0][0], np.int64)
    if len(maps) > 1 and not (len(ts) and ts[-1] >= begins + width):
        ts = np.append(ts, np.int64(maps[1][0][0]))
    due, tail = ts.copy(), np.zeros(len(ts), np.int64)
    for entries, next_due, next_tail, total in maps:
        at = np.searchsorted(np.asarray(entries, np.int64), due)
        hit = at < len(entries)
        at = np.where(hit, at, 0)
        due = np.where(hit, np.asarray(next_due, np.int64)[at], due)
        tail = np.where(hit, np.asarray(next_tail, np.int64)[at], tail + total)
    return ts.tolist(), due.tolist(), tail.tolist(), int(sum(m[3] for m in maps))


def follow(ts: np.ndarray, n: np.ndarray, width: int, at: int, since: int, pending: int) -> Iterator[tuple[int, int, int]]:
    """(report, previous report, requests) of a piece that begins with a report due ``at`` the given time."""
    before = np.cumsum(n) - n
    counted = -pending
    i = int(np.searchsorted(ts, at))
    while i < len(ts):
        upto = int(before[i]) + 1
        yield int(ts[i]), since, upto - counted
        counted, since = upto, int(ts[i])
        i = int(np.searchsorted(ts, since + width))


#: (report due, previous report, requests since) in microseconds.
State = tuple[int, int, int]


def request_times(df: DataFrame, ts: str = "ts") -> DataFrame:
    """(t, n): successful requests by microsecond."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return successful(df).where(F.col(ts).isNotNull()).groupBy(micros.alias("t")).agg(F.count("*").alias("n"))


def windows(found: DataFrame, zone: str) -> DataFrame:
    """Reports in microseconds as ``window_start, window_end, requests, rate_per_sec``."""
    return found.select(F.timestamp_micros("start").cast(zone).alias("window_start"), F.timestamp_micros("end").cast(zone).alias("window_end"),
                        "requests", F.expr("(requests * 1000000) div nullif(end - start, 0)").alias("rate_per_sec"))


def throughput_reported(df: DataFrame, width_seconds: float = 1, ts: str = "ts",
                        piece_events: int = PIECE_EVENTS) -> DataFrame:
    """``window_start, window_end, requests, rate_per_sec`` of every report.

    ``window_start`` is the previous report (the first request for the first window), ``window_end`` the
    request that reports; ``rate_per_sec = requests * 1000 div elapsed ms`` with the elapsed time
    in microseconds.  Failed requests and null times count nowhere.  Of requests at
    one time the first reports and the others belong to the next window.  An empty log
    and one without a report give no rows.
    """
    zone = "timestamp_ntz" if isinstance(df.schema[ts].dataType, T.TimestampNTZType) else "timestamp"
    times = write_table(request_times(df, ts), "request-times")
    return windows(reports(times, int(round(width_seconds * 1_000_000)), None, piece_events)[0], zone)


def reports(times: DataFrame, width: int, state: State | None = None,
            piece_events: int = PIECE_EVENTS) -> tuple[DataFrame, State | None]:
    """(start, end, requests) of every report of the ``times``, a written table of (t, n), and the state behind them.

    ``state`` is that behind all requests before these; without one the first of these starts the clock.
    """
    first, last, many = times.agg(F.min("t"), F.max("t"), F.count("*")).first()
    empty = first is None
    first, last, many = first or 0, last or 0, many or 1
    length = max(width, -(-(last - first + 1) * piece_events // many))
    placed = times.withColumn("id", F.floor((F.col("t") - first) / F.lit(length)).cast("long"))

    def one_map(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        found = piece_map(rows["t"].to_numpy(), rows["n"].to_numpy(), width, first + key[0] * length)
        return pd.DataFrame([(key[0], *found)], columns=["id", "entries", "due", "tail", "total"])

    levels = [write_table(placed.groupBy("id").applyInPandas(one_map, _MAP), "report-maps")]
    count, span = (last - first) // length + 1, length
    while count > 1:
        span *= FANOUT
        levels.append(write_table(levels[-1].withColumn("up", F.floor(F.col("id") / FANOUT).cast("long")).groupBy("up")
                                  .applyInPandas(_composed(width, first, span), _MAP), "report-maps"))
        count = -(-count // FANOUT)

    # the first request starts the clock
    start = state or (first + width, first, 0)
    states = times.sparkSession.createDataFrame([(0, *start)], _STATE)
    for maps in levels[-2::-1]:
        states = write_table(maps.withColumn("up", F.floor(F.col("id") / FANOUT).cast("long")).groupBy("up")
                             .cogroup(states.groupBy("id")).applyInPandas(_handed(width), _STATE), "report-states")

    def followed(key: tuple, rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        out = []
        if len(state) and len(rows):
            s = state.iloc[0]
            out = list(follow(rows["t"].to_numpy(), rows["n"].to_numpy(), width, int(s["at"]), int(s["since"]), int(s["pending"])))
        return pd.DataFrame(out, columns=["end", "start", "requests"], dtype="int64")

    found = placed.groupBy("id").cogroup(states.groupBy("id")).applyInPandas(followed, "end long, start long, requests long")
    return found, state if empty else _behind(levels[-1], start, width)


def _behind(whole: DataFrame, start: State, width: int) -> State:
    """The state behind the one map of all pieces."""
    entry = F.expr(f"size(filter(entries, e -> e < {start[0]}))")
    due, tail, total = whole.select(F.get("due", entry), F.get("tail", entry), "total").first()
    return (start[0], start[1], start[2] + total) if due is None else (due, due - width, tail)


def _composed(width: int, first: int, span: int):
    """One map of the maps of ``span`` microseconds."""
    def composed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        found = compose(list(zip(rows["entries"], rows["due"], rows["tail"], rows["total"])), width, first + key[0] * span)
        return pd.DataFrame([(key[0], *found)], columns=["id", "entries", "due", "tail", "total"])
    return composed


def _handed(width: int):
    """States of the maps below a state, in order of time."""
    def handed(key: tuple, maps: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(state) and len(maps):
            at, since, pending = (int(state.iloc[0][c]) for c in ("at", "since", "pending"))
            for m in maps.sort_values("id").itertuples():
                out.append((m.id, at, since, pending))
                i = int(np.searchsorted(np.asarray(m.entries, np.int64), at))
                if i < len(m.entries):
                    at, pending = int(m.due[i]), int(m.tail[i])
                    since = at - width
                else:
                    pending += m.total
        return pd.DataFrame(out, columns=["id", "at", "since", "pending"], dtype="int64")
    return handed
