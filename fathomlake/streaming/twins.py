"""Structured Streaming forms of the stateful batch operators; each gives what its batch twin gives.

State is kept by key and expires by event time, so it is bounded by the keys that are active within the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_counts(events: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """(window, key, n) of UTC days, closed once the watermark has passed them."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 day"), key).agg(F.count("*").alias("n"))


def first_seen(rows: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def _folded(events: DataFrame, key: str, time: str, tie: str, state_type: str, step, seconds: int, late: str, only: bool) -> DataFrame:
    """step(state or None, seconds) -> (state, value) over a key's events in order; state leaves after `seconds` without any."""
    names = [key, time, tie]
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    out = ", ".join(f"{n} {kinds[n]}" for n in names) + ", value boolean"

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = pd.concat(list(batches)).sort_values([time, tie], ignore_index=True)
        kept = state.get if state.exists else None
        values = []
        stamps = own[time].astype("datetime64[us]").astype("int64") / 1e6
        for s in stamps:
            kept, value = step(kept, s)
            values.append(value)
        state.update(kept)
        state.setTimeoutTimestamp(max(int((stamps.iloc[-1] + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        own["value"] = values
        yield own.loc[own["value"] if only else slice(None), [*names, "value"]]

    rows = events.select(*names).withWatermark(time, late)
    return rows.groupBy(key).applyInPandasWithState(run, out, state_type, "append", GroupStateTimeout.EventTimeTimeout)


def fixed_window(events: DataFrame, key: str, time: str, tie: str, limit: int, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """(key, time, tie, value): whether a window that opens with a key's first event, and anew after `seconds`, admits each event."""

    def step(state, s):
        opened, n = state if state and s - state[0] < seconds else (s, 0)
        return (opened, n + 1), n + 1 <= limit

    return _folded(events, key, time, tie, "opened double, n int", step, seconds, late, False)


def greedy_spacing(events: DataFrame, key: str, time: str, tie: str, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """(key, time, tie, value): events kept when one is skipped within `seconds` of its key's last kept one."""

    def step(state, s):
        keep = state is None or s - state[0] >= seconds
        return ((s,) if keep else state), keep

    return _folded(events, key, time, tie, "kept double", step, seconds, late, True)


def free_retries(events: DataFrame, key: str, time: str, tie: str, seconds: int = 60, free: int = 3, late: str = "10 minutes") -> DataFrame:
    """(key, time, tie, value): whether an event is a free retry; a free retry does not move the window."""

    def step(state, s):
        if state and s - state[0] < seconds and state[1] < free:
            return (state[0], state[1] + 1), True
        return (s, 0), False

    return _folded(events, key, time, tie, "opened double, n int", step, seconds, late, False)
