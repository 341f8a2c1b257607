"""Rows into entities: shared signals join rows, components are entities, and the largest decide."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomlake.functions.text import deletions, within_one_edit


def settled(df: DataFrame) -> DataFrame:
    """Computed once: by checkpoint where the session has a folder for it, else kept by the executors."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


#: Rows that a task sorts or groups at once, where partitions grow in number with the rows.
TASK_ROWS = 500_000


def spread(df: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """Rows dealt by keys to as many partitions as keep a task to TASK_ROWS of them, or of those of `like`; not fewer than the session's own."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-(df if like is None else like).count() // TASK_ROWS)), *keys)


def clusters(signals: DataFrame, scope: str, row: str, signal: str) -> DataFrame:
    """(scope, row, cluster): rows of a scope joined by chains of shared signals; a cluster is named by its smallest row.

    Each round takes the smallest label over a row's signals and back, as two aggregations, so a signal that many rows
    share costs a row each, not a pair each; then the label of that label, so that labels travel twice as far with each
    round. Rounds end when no label changes, however long the chains. Both sides of each join grow with the rows, and
    their sizes are taken for far too small behind explodes, so none is broadcast.
    """
    labels = signals.select(scope, row).distinct().withColumn("cluster", F.col(row))
    shared = signals.select(scope, row, signal).where(F.col(signal).isNotNull()).distinct()
    edges = settled(shared.hint("merge").join(shared.groupBy(scope, signal).count().where("count > 1").drop("count"), [scope, signal], "left_semi"))
    linked = settled(edges.select(scope, row).distinct().withColumn("cluster", F.col(row)))
    while True:
        low = edges.hint("merge").join(linked, [scope, row]).groupBy(scope, signal).agg(F.min("cluster").alias("low_"))
        near = edges.hint("merge").join(low, [scope, signal]).groupBy(scope, row).agg(F.min("low_").alias("near_"))
        jump = linked.select(scope, F.col(row).alias("near_"), F.col("cluster").alias("beyond_"))
        step = linked.hint("merge").join(near, [scope, row]).hint("merge").join(jump, [scope, "near_"]).select(scope, row, F.col("cluster").alias("before_"), F.least("near_", "beyond_").alias("cluster"))
        step = settled(step)
        done = step.where("cluster < before_").isEmpty()
        linked.unpersist()
        linked = step.drop("before_") if done else settled(step.drop("before_"))
        if done:
            edges.unpersist()
            return labels.hint("merge").join(linked.withColumnRenamed("cluster", "low_"), [scope, row], "left").select(scope, row, F.coalesce("low_", "cluster").alias("cluster"))


def leading_choices(members: DataFrame, scope: str, cluster: str, weight: str, share: float = 0.5, most: int = 5) -> DataFrame:
    """Per scope the heaviest cluster and those with at least `share` of its weight, at most `most`."""
    weights = members.groupBy(scope, cluster).agg(F.round(F.sum(weight), 6).alias("weight"), F.count("*").alias("n_rows"))
    w = Window.partitionBy(scope)
    ranked = weights.withColumns({"top_": F.max("weight").over(w), "nth": F.row_number().over(w.orderBy(F.desc("weight"), cluster))})
    return ranked.where((F.col("weight") >= F.lit(share) * F.col("top_")) & (F.col("nth") <= most)).drop("top_")


def drop_covered(names: DataFrame, scope: str, name: str, position: str) -> DataFrame:
    """Names whose words are not all words of a longer name of the same scope.

    Names of a scope with the same words stand for each other, so each set of words is compared once, however many names
    have it; sets meet on the rarest word of the shorter one. A name without words stays.
    """
    w = names.withColumn("words_", F.array_sort(F.array_distinct(F.filter(F.split(F.lower(name), "[^\\p{L}\\p{N}]+"), lambda x: x != ""))))
    sets = settled(w.select(scope, "words_").distinct())
    posted = sets.select(scope, "words_", F.explode("words_").alias("word_"))
    counts = posted.groupBy(scope, "word_").agg(F.count("*").alias("n_"))
    rarest = posted.join(counts, [scope, "word_"]).groupBy(scope, "words_").agg(F.min(F.struct("n_", "word_"))["word_"].alias("word_"))
    longer = posted.select(F.col(scope).alias("scope_b"), F.col("words_").alias("words_b"), F.col("word_").alias("word_b"))
    more = (F.size("words_b") > F.size("words_")) & (F.size(F.array_except("words_", "words_b")) == 0)
    covered = rarest.join(longer, (F.col(scope) == F.col("scope_b")) & (F.col("word_") == F.col("word_b")) & more, "left_semi")
    return w.join(covered.select(scope, "words_"), [scope, "words_"], "left_anti").select(*names.columns)


def nearest_spelling(typed: DataFrame, words: DataFrame, word: str, count: str) -> DataFrame:
    """Per typed word the most frequent known word exactly one edit away (the first by name on ties).

    Both sides are filed under their deletions of one character, so only words that share one are compared.
    """
    keyed = typed.select("typed", F.explode(deletions(F.col("typed"))).alias("key_")).distinct()
    known = words.select(word, count, F.explode(deletions(F.col(word))).alias("key_")).distinct()
    pairs = keyed.join(known, "key_").select("typed", word, count).distinct().where(within_one_edit(F.col("typed"), F.col(word)))
    w = Window.partitionBy("typed").orderBy(F.desc(count), word)
    return pairs.withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")


def longer_forms(names: DataFrame, scope: str, name: str) -> DataFrame:
    """(scope, name, alias): names of a scope that begin with all of a shorter name's words; joined on the first word."""
    words = F.filter(F.split(F.lower(name), "[^\\p{L}\\p{N}]+"), lambda x: x != "")
    w = names.select(scope, name, words.alias("words_")).distinct().withColumn("first_", F.get("words_", F.lit(0)))
    a, b = w.alias("a"), w.alias("b")
    same = (F.col(f"a.{scope}") == F.col(f"b.{scope}")) & (F.col("a.first_") == F.col("b.first_"))
    longer = (F.size("b.words_") > F.size("a.words_")) & (F.slice("b.words_", F.lit(1), F.size("a.words_")) == F.col("a.words_"))
    return a.join(b, same & longer).select(F.col(f"a.{scope}").alias(scope), F.col(f"a.{name}").alias(name), F.col(f"b.{name}").alias("alias"))


def merged_records(rows: DataFrame, scope: str, position: str, keys: tuple[str, str], fields: list[str], largest: str) -> DataFrame:
    """Records of a scope folded in order: one that has a kept record's first or, failing that, second key joins it.

    A record that would bridge two kept ones joins the one that its first key finds, and keys that a merge brings along
    find nothing; empty fields are filled from later records, `largest` keeps its maximum. The fold depends on the order,
    so scopes (the hits of one question) are folded one behind the other in Python, over partitions sorted by scope and
    position; a record without keys goes out at once, the others with the end of their scope.
    """
    schema = rows.select(scope, position, *keys, *fields, largest).schema
    names = schema.names
    at = {n: i for i, n in enumerate(names)}
    own, k1, k2, most = at[scope], at[keys[0]], at[keys[1]], at[largest]
    filled = [at[f] for f in (*keys, *fields)]
    known = lambda x: x is not None and x == x

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, current, done = None, None, []
        kept: list[list] = []
        first: dict = {}
        second: dict = {}
        for batch in batches:
            arrow = batch.schema
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if not kept or r[own] != current:
                    done += kept
                    current, kept, first, second = r[own], [], {}, {}
                a, b = r[k1], r[k2]
                into = first.get(a) if known(a) else None
                if into is None and known(b):
                    into = second.get(b)
                if into is None:
                    new = [x if known(x) else None for x in r]
                    if not (known(a) or known(b)):
                        done.append(new)
                        continue
                    kept.append(new)
                    if known(a):
                        first[a] = new
                    if known(b):
                        second.setdefault(b, new)
                    continue
                for f in filled:
                    if into[f] is None and known(r[f]):
                        into[f] = r[f]
                if known(r[most]) and (into[most] is None or r[most] > into[most]):
                    into[most] = r[most]
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), arrow.types)], names=names)
                done = []
        done += kept
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), arrow.types)], names=names)

    rest = [c for c in names if c not in (scope, position)]
    return rows.select(*names).repartition(scope).sortWithinPartitions(scope, F.col(position).asc_nulls_last(), *rest).mapInArrow(fold, schema)
