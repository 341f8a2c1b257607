"""Counters, quotas and retry windows as batch operators; their streaming twins are in fathomlake.streaming.

What depends on the order of events is a window where a window can say it, and else a fold over one key's events in
time order. A key's events are cut where none follows for as long as the window lasts: nothing carries over such a gap,
so the pieces are folded apart, and a piece is as long as a key goes on without a pause.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def daily_usage(events: DataFrame, key: str, time: str) -> DataFrame:
    """(day, key, count): one counted use for each event."""
    return events.groupBy(F.to_date(time).alias("day"), key).agg(F.count("*").alias("n"))


def usage_matrix(events: DataFrame, provider: str, bucket: str, buckets: list[str], cap: int, time: str) -> DataFrame:
    """Per day and provider the uses in each bucket side by side, in all, and whether four fifths of the cap are spent."""
    counts = events.groupBy(F.to_date(time).alias("day"), provider).pivot(bucket, buckets).count().na.fill(0, buckets)
    total = sum((F.col(b) for b in buckets[1:]), F.col(buckets[0]))
    return counts.withColumn("used", total).withColumn("alert", F.col("used") * 5 >= F.lit(cap) * 4)


def carry_over(usage: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    """Counters of a key that moved are added, day by day, to those of the key it moved to; `moves` is (from_key, to_key)."""
    moved = usage.join(moves.withColumnRenamed("from_key", key), key, "left")
    return moved.groupBy("day", F.coalesce("to_key", key).alias(key)).agg(F.sum("n").alias("n"))


def saturating(events: DataFrame, keys: list[str], time: str, tie: str, cap: int) -> DataFrame:
    """Each event with whether a daily counter with a cap admits it, and the counter after it; what is refused isn't counted."""
    w = Window.partitionBy(F.to_date(time), *keys).orderBy(time, tie)
    nth = F.row_number().over(w)
    return events.withColumn("admitted", nth <= cap).withColumn("counter", F.least(nth, F.lit(cap)))


def _in_order(events: DataFrame, keys: list[str], time: str, tie: str, step, first, inputs: list[str], column: str) -> DataFrame:
    """A boolean for each event: step(state, *inputs) -> (state, value), over each group's events in order, from the first state.

    Partitions hold whole groups, sorted; only the running state goes from batch to batch, so a long group needs no memory.
    """
    schema = T.StructType([*events.schema.fields, T.StructField(column, T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, state = None, first
        for batch in batches:
            out = []
            names = (batch[k].astype(object).where(batch[k].notna(), None) for k in keys)  # so that a null key equals itself
            for own, values in zip(zip(*names), zip(*(batch[c] for c in inputs))):
                if own != group:
                    group, state = own, first
                state, value = step(state, *values)
                out.append(value)
            batch[column] = out
            yield batch[schema.names]

    return events.repartition(*keys).sortWithinPartitions(*keys, time, tie).mapInPandas(run, schema)


def _folded(events: DataFrame, key: str, time: str, tie: str, step, column: str, gap: int) -> DataFrame:
    """A boolean for each event of a key in order: step(state, seconds) -> (state, value), from nothing after a gap."""
    w = Window.partitionBy(key).orderBy(time, tie)
    since = (F.unix_micros(F.col(time)) - F.unix_micros(F.lag(time).over(w))) / 1e6
    pieces = events.withColumn("cut_", F.when(since >= gap, 1).otherwise(0)).withColumn("piece_", F.sum("cut_").over(w)).drop("cut_")
    pieces = pieces.withColumn("seconds_", F.unix_micros(F.col(time)) / 1e6)
    return _in_order(pieces, [key, "piece_"], time, tie, step, None, ["seconds_"], column).drop("piece_", "seconds_")


def fixed_window(events: DataFrame, key: str, time: str, tie: str, limit: int, seconds: int = 60) -> DataFrame:
    """Whether a window that opens with a key's first event, and again after `seconds`, admits each event."""

    def step(state, s):
        opened, n = state if state and s - state[0] < seconds else (s, 0)
        return (opened, n + 1), n + 1 <= limit

    return _folded(events, key, time, tie, step, "admitted", seconds)


def greedy_spacing(events: DataFrame, key: str, time: str, tie: str, seconds: int = 60) -> DataFrame:
    """Events of a key that are kept when one is skipped within `seconds` of the last kept one."""

    def step(state, s):
        keep = state is None or s - state >= seconds
        return (s if keep else state), keep

    return _folded(events, key, time, tie, step, "kept", seconds).where("kept").drop("kept")


def free_retries(events: DataFrame, key: str, time: str, tie: str, seconds: int = 60, free: int = 3) -> DataFrame:
    """Whether an event is a free retry: within `seconds` of the one that opened the window, at most `free` times.

    A free retry does not move the window; the one after the last free one counts and opens it anew.
    """

    def step(state, s):
        if state and s - state[0] < seconds and state[1] < free:
            return (state[0], state[1] + 1), True
        return (s, 0), False

    return _folded(events, key, time, tie, step, "free_retry", seconds)


def running_budget(events: DataFrame, time: str, tie: str, cost: str, scope: list[str]) -> DataFrame:
    """Each event with what its scope and day have spent up to and with it."""
    w = Window.partitionBy(F.to_date(time), *scope).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("spent", F.sum(cost).over(w))


def admitted_spend(events: DataFrame, scope: str, time: str, tie: str, cost: str, cap: float) -> DataFrame:
    """Whether each event of a scope and day fits the cap beside what was admitted before; refused ones spend nothing."""

    def step(spent, c):
        ok = spent + c <= cap
        return (spent + c if ok else spent), ok

    return _in_order(events.withColumn("day_", F.to_date(time)), [scope, "day_"], time, tie, step, 0.0, [cost], "admitted").drop("day_")


def share_limited(events: DataFrame, keys: list[str], time: str, tie: str, cap: str, share: str) -> DataFrame:
    """Whether each event of a day fits its share of its provider's cap beside what was admitted before; refused ones don't count.

    The limit is the whole cap at a share of 1, else that part of it, one at least; no cap (null) admits all without
    counting them, a cap of 0 admits none.
    """
    limit = F.when(F.col(cap) == 0, 0).when(F.col(share) < 1, F.greatest(F.lit(1), F.floor(F.col(cap) * F.col(share)))).otherwise(F.col(cap))
    rows = events.withColumns({"day_": F.to_date(time), "limit_": F.coalesce(limit, F.lit(-1)).cast("long")})

    def step(used, most):
        if most < 0:
            return used, True
        return (used + 1, True) if used < most else (used, False)

    return _in_order(rows, ["day_", *keys], time, tie, step, 0, ["limit_"], "admitted").drop("day_", "limit_")


def spaced_starts(events: DataFrame, key: str, time: str, tie: str, micros: int = 1_000_000) -> DataFrame:
    """When each event may start if a key's starts are `micros` apart at least: at its time, or that long after the start before it.

    The start of event k is the latest, over the events j up to it, of time j and k - j gaps: a running maximum.
    """
    w = Window.partitionBy(key).orderBy(time, tie)
    k = F.row_number().over(w)
    slack = F.unix_micros(F.col(time)) - k * F.lit(micros)
    rows = events.withColumn("k_", k).withColumn("slack_", slack)
    latest = F.max("slack_").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("start", F.timestamp_micros(latest + F.col("k_") * F.lit(micros))).drop("k_", "slack_")


def first_marks(events: DataFrame, query: str, stage: str, time: str) -> DataFrame:
    """Milliseconds from a query's first event to the first of each stage."""
    firsts = events.groupBy(query, stage).agg(F.min(time).alias("at_"))
    start = F.min("at_").over(Window.partitionBy(query))
    return firsts.select(query, stage, ((F.unix_micros("at_") - F.unix_micros(start)) / 1000).cast("long").alias("ms"))


def sse_rows(frames: Iterator[str]) -> list[tuple[int, str, str]]:
    """(sequence, event, data) of complete server-sent-event frames; what follows the last blank line is left."""
    out = []
    for k, frame in enumerate("".join(frames).replace("\r\n", "\n").split("\n\n")[:-1]):
        fields = [line.partition(":") for line in frame.split("\n")]
        event = next((v.strip() for f, _, v in fields if f == "event"), "message")
        data = "\n".join(v.removeprefix(" ") for f, _, v in fields if f == "data")
        out.append((k, event, data))
    return out
