"""Rows about one name into the persons they are about: components under refusals, weak rows, qualified clusters."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomlake.operators import entities

#: Signals of a scope that a task holds at once; a scope that may have more is dealt out by its signals.
SCOPE_SIGNALS = 200_000


def refusing_signals(rows: DataFrame, scope: str, row: str, shared: str, refusals: list[str]) -> DataFrame:
    """(scope, row, signal): rows that have a signal in common share a word and don't refuse one another.

    `shared` is an array of words; two rows may join if they have a word in common and, for each array in `refusals`,
    one of them has none or both have a value in common. A signal is a word, a pair of classes (which refusals a row
    has values for) and the values of those that both classes have: all rows of its one class then agree with all of
    the other, so the signal stands for all pairs without making them. It is kept if both classes have a row.
    """
    k = len(refusals)
    held = sum((F.when(F.size(c) > 0, 1 << i).otherwise(0) for i, c in enumerate(refusals)), F.lit(0))
    said = rows.select(scope, row, *refusals, held.alias("own_"), F.explode(F.array_distinct(shared)).alias("word_"))
    # The classes that a word's rows have: 2^k at most, so other classes make no rows; a word that one row has joins nothing.
    there = said.groupBy(scope, "word_").agg(F.collect_set("own_").alias("there_"), F.count("*").alias("rows_")).where("rows_ > 1").drop("rows_")
    out = said.hint("merge").join(there.hint("merge"), [scope, "word_"]).withColumn("other_", F.explode("there_")).drop("there_")
    out = out.withColumn("both_", F.col("own_").bitwiseAND(F.col("other_")))
    for i, c in enumerate(refusals):
        values = F.when(F.col("both_").bitwiseAND(F.lit(1 << i)) > 0, F.col(c)).otherwise(F.array(F.lit("")))
        out = out.withColumn(f"value_{i}_", F.explode(values))
    low, high = F.least("own_", "other_"), F.greatest("own_", "other_")
    signal = F.to_json(F.struct("word_", low.alias("low"), high.alias("high"), *(f"value_{i}_" for i in range(k))))
    out = out.select(scope, row, signal.alias("signal"), (F.col("own_") == low).alias("is_low_"), (F.col("own_") == high).alias("is_high_"))
    met = out.groupBy(scope, "signal").agg(F.bool_or("is_low_").alias("a_"), F.bool_or("is_high_").alias("b_")).where("a_ AND b_").select(scope, "signal")
    return out.select(scope, row, "signal").hint("merge").join(met.hint("merge"), [scope, "signal"], "left_semi")


def compatible_clusters(rows: DataFrame, scope: str, row: str, shared: str, refusals: list[str]) -> DataFrame:
    """(scope, row, cluster) of the rows that have a word in `shared`: components over all pairs that share a word and don't refuse one another.

    Rows that say the same stand for each other, so copies cost one row; a cluster is named by its smallest row. A scope
    is joined as one fold over its rows, so these are shuffled once. Scopes that may have more than SCOPE_SIGNALS are
    dealt out by their signals instead; their number is broadcast, one for that many signals at most.
    """
    arrays = [F.array_sort(F.coalesce(F.col(c), F.array().cast("array<string>"))).alias(c) for c in (shared, *refusals)]
    own = rows.select(scope, row, *arrays).where((F.size(shared) > 0) & F.col(scope).isNotNull())
    most = F.size(shared).cast("double")
    for c in refusals:
        most = most * (F.greatest(F.size(c), F.lit(1)) + 1)
    large = entities.settled(own.groupBy(scope).agg(F.sum(most).alias("n_")).where(F.col("n_") > SCOPE_SIGNALS).select(scope))
    if large.isEmpty():
        return folded_clusters(own, scope, row, shared, refusals)
    large = F.broadcast(large)
    folded = folded_clusters(own.join(large, scope, "left_anti"), scope, row, shared, refusals)
    return folded.unionByName(dealt_clusters(own.join(large, scope, "left_semi"), scope, row, shared, refusals))


def dealt_clusters(own: DataFrame, scope: str, row: str, shared: str, refusals: list[str]) -> DataFrame:
    """(scope, row, cluster) in scopes of any size: rows meet by refusing_signals, in rounds."""
    keys = [scope, shared, *refusals]
    kinds = own.groupBy(*keys).agg(F.min(row).alias("first_"))
    signals = refusing_signals(kinds, scope, "first_", shared, refusals)
    alone = kinds.select(scope, "first_", F.lit(None).cast("string").alias("signal"))
    found = entities.clusters(signals.unionByName(alone), scope, "first_", "signal")
    return own.hint("merge").join(kinds, keys).select(scope, row, "first_").hint("merge").join(found, [scope, "first_"]).select(scope, row, "cluster")


def folded_clusters(own: DataFrame, scope: str, row: str, shared: str, refusals: list[str]) -> DataFrame:
    """(scope, row, cluster) in scopes that a task can hold: a fold over partitions sorted by scope.

    What a row says travels as one text. Within a scope, rows of a text are one, and texts join by the signals of
    refusing_signals.
    """
    said = F.to_json(F.struct(F.col(shared).alias("shared"), F.array(*refusals).alias("refusals")))
    schema = own.select(scope, row, F.col(row).alias("cluster")).schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(1 << 12)
        def read(text: str) -> tuple[list, list, int]:
            x = json.loads(text)
            return [w for w in dict.fromkeys(x["shared"]) if w is not None], x["refusals"], sum(1 << i for i, v in enumerate(x["refusals"]) if v)

        @lru_cache(1 << 12)
        def signals(text: str, other: int) -> list[tuple]:
            words, values, held = read(text)
            agreed = product(*(dict.fromkeys(v) if held & other & 1 << i else ("",) for i, v in enumerate(values)))
            return [(min(held, other), max(held, other), w, *a) for a in agreed for w in words]

        def joined(kinds: dict) -> dict:
            kinds = {t: first for t, first in kinds.items() if first is not None}
            classes = {read(t)[2] for t in kinds}
            sides: dict[tuple, tuple[list, list]] = {}
            for t in kinds:
                held = read(t)[2]
                for other in classes:
                    for s in signals(t, other):
                        low, high = sides.setdefault(s, ([], []))
                        if held <= other:
                            low.append(t)
                        if held >= other:
                            high.append(t)
            above = {t: t for t in kinds}

            def top(t: str) -> str:
                while above[t] != t:
                    above[t] = t = above[above[t]]
                return t

            for low, high in sides.values():
                if low and high:
                    a = top(low[0])
                    for t in low[1:] + high:
                        b = top(t)
                        if kinds[b] < kinds[a]:
                            a, b = b, a
                        above[b] = a
            return {t: kinds[top(t)] for t in kinds}

        arrow, current, done = None, None, []
        held: list[tuple] = []
        kinds: dict = {}

        def close() -> None:
            found = joined(kinds)
            done.extend((current, r, found[t]) for r, t in held if t in found)
            held.clear()
            kinds.clear()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), arrow)], names=schema.names)
            done.clear()
            return out

        for batch in batches:
            arrow = [batch.schema.types[0], batch.schema.types[1], batch.schema.types[1]]
            for s, r, t in zip(*(c.to_pylist() for c in batch.columns)):
                if s != current:
                    close()
                    current = s
                held.append((r, t))
                first = kinds.get(t)
                if first is None or (r is not None and r < first):
                    kinds[t] = r
            if len(done) >= 10_000:
                yield given()
        close()
        if done:
            yield given()

    return entities.spread(own.select(scope, row, said.alias("said_")), scope).sortWithinPartitions(scope).mapInArrow(fold, schema)


def attach_weak(strong: DataFrame, weak: DataFrame, scope: str, row: str) -> DataFrame:
    """Strong members and the rows that carry nothing but the name: these join the largest cluster of their scope (the one with the smallest row on ties), or form one."""
    sizes = strong.groupBy(scope, "cluster").agg(F.count("*").alias("n_"), F.min(row).alias("first_"))
    top = sizes.groupBy(scope).agg(F.min_by("cluster", F.struct(-F.col("n_"), "first_")).alias("top_"))
    first = weak.groupBy(scope).agg(F.min(row).alias("own_"))
    home = first.join(top, scope, "left").select(scope, F.coalesce("top_", "own_").alias("cluster"))
    return strong.select(scope, row, "cluster").unionByName(weak.select(scope, row).hint("merge").join(home, scope).select(scope, row, "cluster"))


def merge_qualified(members: DataFrame, scope: str, row: str, words: str, qualifying: str) -> DataFrame:
    """(scope, row, cluster): a cluster whose page carries a qualifier takes in clusters without one, if half of their rows have one of its words.

    `words` is a row's words, `qualifying` the words that a qualified page stands for (null or empty on others); a
    cluster's are those of its first such row. Clusters are tried by size, then by smallest row, and each is taken once;
    two clusters with qualifiers are two persons.
    """
    sizes = members.groupBy(scope, "cluster").agg(F.count("*").alias("n_"), F.min(row).alias("first_"), F.min_by(qualifying, F.when(F.size(qualifying) > 0, F.col(row))).alias("q_"))
    takers = sizes.where(F.size("q_") > 0).select(scope, F.col("cluster").alias("into_"), F.struct(-F.col("n_"), "first_").alias("order_"), F.explode(F.array_distinct("q_")).alias("word_"))
    open_ = sizes.where(F.coalesce(F.size("q_"), F.lit(0)) <= 0).select(scope, "cluster", "n_")
    carried = members.join(open_, [scope, "cluster"]).select(scope, "cluster", "n_", row, F.explode(F.array_distinct(words)).alias("word_"))
    hits = carried.join(takers, [scope, "word_"]).select(scope, "cluster", "n_", row, "into_", "order_").distinct()
    enough = hits.groupBy(scope, "cluster", "n_", "into_", "order_").agg(F.count("*").alias("c_")).where("c_ * 2 >= n_")
    moves = enough.groupBy(scope, "cluster").agg(F.min_by("into_", "order_").alias("into_"))
    return members.join(moves, [scope, "cluster"], "left").select(scope, row, F.coalesce("into_", "cluster").alias("cluster"))


def described(members: DataFrame, scope: str, kinds: dict[str, str]) -> DataFrame:
    """Per cluster its size and, for each array column, the value that most rows have: the shortest, then the first by name on ties."""
    out = members.groupBy(scope, "cluster").agg(F.count("*").alias("n_rows"))
    for c, name in kinds.items():
        counts = members.select(scope, "cluster", F.explode(c).alias("v_")).groupBy(scope, "cluster", "v_").agg(F.count("*").alias("c_"))
        best = counts.groupBy(scope, "cluster").agg(F.min_by("v_", F.struct(-F.col("c_"), F.length("v_"), "v_")).alias(name))
        out = out.join(best, [scope, "cluster"], "left")
    return out


def ranked(members: DataFrame, scope: str, row: str) -> DataFrame:
    """Clusters of a scope from the largest, the one with the smallest row first on ties."""
    sizes = members.groupBy(scope, "cluster").agg(F.count("*").alias("n_rows"), F.min(row).alias("first_row"))
    return sizes.withColumn("nth", F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("n_rows"), "first_row")))
