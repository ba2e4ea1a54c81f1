"""The same operators on streams: late copies, closed traces, sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.operators.redelivery import plain_id


def once(spans: DataFrame, time: str = "received_at", late: str = "1 day") -> DataFrame:
    """A stream of spans with each (trace_id, span_id) once among copies that come within late of each other.

    State is kept for that long and no longer, so it is bounded by the arrivals of late.
    """
    x = spans.withColumns({"trace_id": plain_id("trace_id"), "span_id": plain_id("span_id")})
    return x.withWatermark(time, late).dropDuplicatesWithinWatermark(["trace_id", "span_id"])


def windowed(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, end, by, n): counts per tumbling window; what comes after the watermark is left out."""
    x = events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"))
    return x.select("window.start", "window.end", by, "n")


def sessions(events: DataFrame, time: str, by: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(start, end, by, n): runs of events with no gap as long as gap."""
    x = events.withWatermark(time, late).groupBy(F.session_window(time, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return x.select("session_window.start", "session_window.end", by, "n")


CLOSED = "trace_id string, spans bigint, first_us bigint, last_us bigint, errors bigint, late bigint"
STATE = "spans bigint, first_us bigint, last_us bigint, errors bigint, closed boolean, late bigint"


def closed_traces(spans: DataFrame, time: str = "received_at", late: str = "10 minutes", idle_ms: int = 1_800_000) -> DataFrame:
    """(trace_id, spans, first_us, last_us, errors, late): a trace comes out once, when nothing has come for idle_ms of
    event time; spans of a trace that is out already come out as late ones. State holds sums only, whatever a trace's size.
    spans: trace_id, time, error.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first, last, errors, closed, behind = state.get if state.exists else (0, None, None, 0, False, 0)
        if state.hasTimedOut:
            if closed:
                state.remove()
                return
            state.update((n, first, last, errors, True, 0))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 10 * idle_ms)
            yield pd.DataFrame([(key[0], n, first, last, errors, 0)], columns=["trace_id", "spans", "first_us", "last_us", "errors", "late"])
            return
        new = 0
        for f in frames:
            us = f["_us"]
            new += len(f)
            first = int(min(us.min(), first)) if first is not None else int(us.min())
            last = int(max(us.max(), last)) if last is not None else int(us.max())
            errors += int(f["_error"].sum())
        if closed:
            state.update((n + new, first, last, errors, True, behind + new))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 10 * idle_ms)
            yield pd.DataFrame([(key[0], n + new, first, last, errors, behind + new)], columns=["trace_id", "spans", "first_us", "last_us", "errors", "late"])
            return
        state.update((n + new, first, last, errors, False, 0))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, last // 1000 + idle_ms))

    x = spans.withWatermark(time, late).select(plain_id("trace_id").alias("trace_id"), time, F.unix_micros(F.col(time).cast("timestamp")).alias("_us"), F.coalesce("error", F.lit(False)).alias("_error"))
    return x.where("trace_id is not null").groupBy("trace_id").applyInPandasWithState(step, CLOSED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
