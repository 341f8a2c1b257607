"""Streams that revise what they have given, and joins with what arrives late; each agrees with its batch twin.

transformWithState needs the RocksDB provider of state stores; a cluster keeps its checkpoints in a shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def settled_verdicts(nodes: DataFrame, card: str, index: str, says: str, payload: str, time: str, tie: str) -> DataFrame:
    """(card, index, payload, retracted): the last node of every slot of a card; one that says yes is retracted if another slot says no.

    says is 'yes', 'no' or anything else, which takes no side; a retracted node has no payload.
    """
    w = Window.partitionBy(card, index).orderBy(F.desc(time), F.desc(tie))
    last = nodes.withColumn("nth_", F.row_number().over(w)).where("nth_ = 1")
    negative = F.max(F.coalesce(F.col(says) == "no", F.lit(False))).over(Window.partitionBy(card))
    retracted = negative & F.coalesce(F.col(says) == "yes", F.lit(False))
    return last.withColumn("retracted", retracted).select(card, index, F.when(~F.col("retracted"), F.col(payload)).alias(payload), "retracted")


class _Verdicts(StatefulProcessor):
    """Holds the last node of every slot of a card and what was last given of it; gives a row for each slot that shows something else now."""

    def __init__(self, card: str, index: str, says: str, payload: str, time: str, tie: str, seconds: int):
        self.columns, self.seconds = (card, index, says, payload, time, tie), seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot long", "stamp long, tie long, says string, payload string, given string, retracted boolean, revision int")
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        card, index, says, payload, time, tie = self.columns
        slots = {k[0]: list(v) for k, v in self.slots.iterator()} if self.slots.exists() else {}
        latest = 0
        for batch in rows:
            stamps = batch[time].astype("datetime64[us]").astype("int64")
            for slot, said, shown, stamp, t in zip(batch[index], batch[says], batch[payload], stamps, batch[tie]):
                latest = max(latest, int(stamp))
                old = slots.get(int(slot))
                if old is None or (int(stamp), int(t)) >= (old[0], old[1]):
                    slots[int(slot)] = [int(stamp), int(t), said, shown, *(old[4:] if old else (None, None, 0))]
        negative = any(v[2] == "no" for v in slots.values())
        out = []
        for slot, v in sorted(slots.items()):
            retracted = negative and v[2] == "yes"
            shown = None if retracted else v[3]
            if v[6] == 0 or (v[4], v[5]) != (shown, retracted):
                v[4:] = [shown, retracted, v[6] + 1]
                out.append((key[0], slot, shown, retracted, v[6]))
            self.slots.updateValue((slot,), tuple(v))
        until = max(self.until.get()[0] if self.until.exists() else 0, latest // 1000 + self.seconds * 1000)
        self.until.update((until,))
        self.handle.registerTimer(until)
        yield pd.DataFrame(out, columns=[card, index, payload, "retracted", "revision"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.until.exists() or expiredTimerInfo.getExpiryTimeInMs() >= self.until.get()[0]:
            self.slots.clear()
            self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def revised_verdicts(nodes: DataFrame, card: str, index: str, says: str, payload: str, time: str, tie: str, seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """(card, index, payload, retracted, revision) of a stream of nodes: rows are given anew when a later node of the card changes what they show.

    The row with the highest revision is what settled_verdicts gives, in whatever order the nodes come within the
    watermark. A card's state leaves when it has had no node for `seconds`.
    """
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    out = f"{card} {kinds[card]}, {index} long, {payload} string, retracted boolean, revision int"
    rows = nodes.select(card, index, says, payload, time, tie).withWatermark(time, late)
    return rows.groupBy(card).transformWithStateInPandas(_Verdicts(card, index, says, payload, time, tie, seconds), out, "Update", "eventtime")


def late_content(results: DataFrame, contents: DataFrame, key: str, shown: str, arrived: str, early: str = "30 seconds", budget: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """Results with the contents of their key that arrive from `early` before to `budget` after they are shown; a result without any stays, with nulls.

    The same declaration serves batches and streams: with streams on both sides, each has a watermark and the interval
    bounds what is held of either; a result without content is given once no content can come any more. The columns of
    the contents but its key and time follow those of the results.
    """
    left = results.withWatermark(shown, late) if results.isStreaming else results
    right = contents.withWatermark(arrived, late) if contents.isStreaming else contents
    right = right.withColumnRenamed(key, "content_key_")
    near = (F.col(key) == F.col("content_key_")) & (F.col(arrived) >= F.col(shown) - F.expr(f"INTERVAL {early}")) & (F.col(arrived) <= F.col(shown) + F.expr(f"INTERVAL {budget}"))
    return left.join(right, near, "left_outer").drop("content_key_")
