"""Sliding-log admission of events per key.

An event is admitted while fewer than ``limit`` admitted events lie within the
window before it; denied events are not counted. A key's state is at most
``limit`` times.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESULT = "key string, event_id long, at long, admitted boolean, retry_after long"


def admit(times: Iterable[int], kept: deque, limit: int, window_ms: int) -> Iterator[tuple[bool, int]]:
    """(admitted, seconds to wait) of each time in ascending order; ``kept`` is the state."""
    for t in times:
        while kept and kept[0] <= t - window_ms:
            kept.popleft()
        if len(kept) < limit:
            kept.append(t)
            yield True, 0
        else:
            yield False, max(1, -(-(kept[0] + window_ms - t) // 1000))


def _decide(rows: pd.DataFrame, kept: deque, limit: int, window_ms: int) -> pd.DataFrame:
    rows = rows.sort_values(["at", "event_id"], kind="stable")
    said = list(admit(rows["at"].tolist(), kept, limit, window_ms))
    return rows[["key", "event_id", "at"]].assign(admitted=[a for a, _ in said], retry_after=[r for _, r in said])


def chunked(events: DataFrame, window_ms: int, parts: int = 8) -> DataFrame:
    """Events (key, at, ...) with ``chunk``: between two chunks of a key lies a gap longer than the window.

    Time is cut into bins, ``parts`` to a window; where as many bins in a row have no event, nothing that was admitted
    before still counts. Only the bins that hold events, not the events, are put in order by key.
    """
    width = max(1, -(-window_ms // parts))
    rows = events.withColumn("bin", F.floor(F.col("at") / width))
    order = Window.partitionBy("key").orderBy("bin")
    bins = rows.select("key", "bin").distinct()
    gap = F.coalesce((F.col("bin") - F.lag("bin").over(order) > parts).cast("long"), F.lit(0))
    bins = bins.withColumn("gap", gap).withColumn("chunk", F.sum("gap").over(order)).select(F.col("key").alias("of_key"), F.col("bin").alias("of_bin"), "chunk")
    return rows.join(bins, F.col("key").eqNullSafe(F.col("of_key")) & (F.col("bin") == F.col("of_bin"))).drop("bin", "of_key", "of_bin")


def admissions(events: DataFrame, limit: int = 5, window_ms: int = 3_600_000) -> DataFrame:
    """(key, event_id, at, admitted, retry_after) of a table (key, event_id, at in ms).

    A key is cut into chunks at its gaps, which are decided apart from each other; rows of a chunk stream through one
    task in order, which holds ``limit`` times. Events of one key without any gap follow from each other and stay
    together.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, kept = None, deque()
        for b in batches:
            said = []
            for key, chunk, at in zip(b["key"].tolist(), b["chunk"].tolist(), b["at"].tolist(), strict=True):
                if own != (key, chunk):  # rows come chunk by chunk, in order; most chunks are of few events
                    own, kept = (key, chunk), deque()
                said.extend(admit((at,), kept, limit, window_ms))
            yield b[["key", "event_id", "at"]].assign(admitted=[a for a, _ in said], retry_after=[r for _, r in said])

    rows = events.select(F.col("key").cast("string").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col("at").cast("long").alias("at"))
    rows = chunked(rows.filter("at is not null"), window_ms)
    return rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "at", "event_id").mapInPandas(run, RESULT)


STATE = "kept array<long>, times array<long>, ids array<long>"


def admission_stream(events: DataFrame, limit: int = 5, window_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """The same for a stream (key, event_id, ts): decisions in event time, whatever batch an event comes in.

    Events wait in the key's state until the watermark has passed them; then they are decided in order, so a
    replay gives what ``admissions`` gives. Events later than ``late`` are dropped by the watermark. A timer in
    event time decides waiting events and drops a key's state once its window has passed.
    """

    def step(key, frames, state) -> Iterator[pd.DataFrame]:
        kept, times, ids = (list(x) for x in state.get) if state.exists else ([], [], [])
        for f in () if state.hasTimedOut else frames:
            times += f["at"].tolist()
            ids += f["event_id"].tolist()
        now = state.getCurrentWatermarkMs()
        waiting = sorted(zip(times, ids, strict=True))
        ready = [x for x in waiting if x[0] <= now]
        waiting = waiting[len(ready) :]
        kept = deque(kept)
        if ready:
            yield _decide(pd.DataFrame({"key": [key[0]] * len(ready), "event_id": [i for _, i in ready], "at": [t for t, _ in ready]}), kept, limit, window_ms)
        ends = ([waiting[0][0] + 1] if waiting else []) + ([kept[-1] + window_ms] if kept else [])
        if not ends or (not waiting and max(ends) <= now):
            if state.exists:
                state.remove()
            return
        state.update((list(kept), [t for t, _ in waiting], [i for _, i in waiting]))
        state.setTimeoutTimestamp(max(now + 1, min(ends) if waiting else max(ends)))

    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select(F.col("key").cast("string").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.unix_millis("ts").alias("at"), "ts")
    return rows.groupBy("key").applyInPandasWithState(step, RESULT, STATE, "append", "EventTimeTimeout")
