"""Stateful streams: windows anchored at a key's first event, and once-only processing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key long, event_id long, at long, allowed boolean, remaining int"


def take(times: list[int], start: int | None, used: int, most: int, span: int) -> tuple[list[tuple[bool, int]], int | None, int]:
    """Decisions for events in order: a window opens at the first event after the last one closed."""
    out = []
    for t in times:
        if start is None or t >= start + span:
            start, used = t, 0
        used += 1
        out.append((used <= most, max(0, most - used)))
    return out, start, used


def limited(events: DataFrame, most: int, span: int) -> DataFrame:
    """Batch form over (key, event_id, at in seconds): each event with its decision. The events of a key are taken in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, used = None, None, 0
        for pdf in batches:
            rows = []
            for k, e, t in zip(pdf["key"], pdf["event_id"], pdf["at"], strict=True):
                if k != key:
                    key, start, used = k, None, 0
                [(ok, left)], start, used = take([t], start, used, most, span)
                rows.append((k, e, t, ok, left))
            yield pd.DataFrame(rows, columns=["key", "event_id", "at", "allowed", "remaining"])

    return events.select("key", "event_id", "at").repartition("key").sortWithinPartitions("key", "at", "event_id").mapInPandas(run, OUT)


def limited_stream(events: DataFrame, most: int, span: int, late: str = "10 minutes") -> DataFrame:
    """The same over a stream of (key, event_id, at in seconds since 1970, above 0): state is a start and a count for each key.

    Time is that of the events. Within a batch a key's events are taken in order. A window's state goes when the
    watermark, ``late`` behind the latest event, has passed its end: a pause of the stream closes no window. Events later
    than the watermark are not decided; one that is older than its key's window, but not that late, counts in it.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        done, start, used = take(rows["at"].tolist(), start, used, most, span)
        yield pd.DataFrame({"key": rows["key"], "event_id": rows["event_id"], "at": rows["at"], "allowed": [d[0] for d in done], "remaining": [d[1] for d in done]})
        state.update((int(start), int(used)))
        state.setTimeoutTimestamp(max((int(start) + span) * 1000, state.getCurrentWatermarkMs() + 1))

    timed = events.select("key", "event_id", "at").withColumn("time", F.timestamp_seconds("at")).withWatermark("time", late)
    return timed.groupBy("key").applyInPandasWithState(run, OUT, "start long, used int", "append", GroupStateTimeout.EventTimeTimeout)


def once(stream: DataFrame, key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """Each key once, with state bounded by a watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
