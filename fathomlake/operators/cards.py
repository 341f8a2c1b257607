"""Streams of card nodes: flattening, the last node of a slot, and what need not be sent again."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flatten_nodes(cards: DataFrame, card: str, body: str) -> DataFrame:
    """(card, path, depth, type, payload) of every node of nested JSON cards; children are recursive, so a small Python walk per card.

    A body that is no JSON, or null, has no nodes. Paths are indices joined by dots.
    """

    def walk(nodes: list, path: tuple) -> Iterator[tuple]:
        for i, node in enumerate(nodes):
            if isinstance(node, dict):
                at = (*path, i)
                own = {k: v for k, v in node.items() if k not in ("children", "tabs")}
                yield ".".join(map(str, at)), len(at), str(node.get("type")), json.dumps(own, sort_keys=True, ensure_ascii=False)
                yield from walk(node.get("children") or [], at)
                for t, tab in enumerate(node.get("tabs") or []):
                    yield from walk(tab.get("children") or [], (*at, f"t{t}"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch[card], batch[body]):
                try:
                    nodes = json.loads(text)
                except (TypeError, ValueError):
                    continue
                rows += [(key, *r) for r in walk(nodes if isinstance(nodes, list) else [nodes], ())]
            yield pd.DataFrame(rows, columns=[card, "path", "depth", "type", "payload"])

    kind = cards.schema[card].dataType.simpleString()
    return cards.select(card, body).mapInPandas(run, f"{card} {kind}, path string, depth int, type string, payload string")


def last_per_slot(nodes: DataFrame, card: str, slot: str, seq: str, payload: str) -> DataFrame:
    """The node that each slot ends with, in the order in which slots were first shown."""
    last = nodes.groupBy(card, slot).agg(F.max_by(payload, seq).alias(payload), F.min(seq).alias("first_seq"))
    return last.withColumn("shown", F.row_number().over(Window.partitionBy(card).orderBy("first_seq", slot))).drop("first_seq")


def changed_only(nodes: DataFrame, card: str, slot: str, seq: str, payload: str) -> DataFrame:
    """Nodes that differ from the one before in their slot."""
    before = F.lag(payload).over(Window.partitionBy(card, slot).orderBy(seq))
    return nodes.withColumn("same_", F.col(payload).eqNullSafe(before) & before.isNotNull()).where(~F.col("same_")).drop("same_")


def first_seen(rows: DataFrame, scope: str, key: str, position: str) -> DataFrame:
    """The first row of each key in its scope."""
    w = Window.partitionBy(scope, key).orderBy(position)
    return rows.withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")
