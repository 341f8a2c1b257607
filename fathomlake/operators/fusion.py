"""Rank fusion, interleaving and choice among result lists. Lists are rows with an explicit position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomlake.functions.text import let, within_one_edit

RANK_OFFSET = 3
# Words that don't say what a question is about, and the weights of engines.
QUERY_STOP = "the and for with how what why when who are is to of in on a an vs best my do does can i".split()
ENGINE_WEIGHTS = {"brave": 1.2, "serper": 1.2, "exa": 1.2, "perplexity": 1.2, "tavily": 1.1, "jina": 1.1, "you": 1.15, "you-keyless": 1.05, "marginalia": 0.5, "wikipedia": 0.8}


def reciprocal_rank_fusion(hits: DataFrame, query: str = "query_id", key: str = "url_key", rank: str = "rank", weight: str = "weight") -> DataFrame:
    """Per query and key: score (sum of weight / (rank + 3), 9 places), n_lists, best_rank. One map-side combined aggregation."""
    share = F.col(weight) / (F.col(rank) + F.lit(RANK_OFFSET))
    return hits.groupBy(query, key).agg(F.round(F.sum(share), 9).alias("score"), F.count("*").alias("n_lists"), F.min(rank).alias("best_rank"))


def best_snippet(hits: DataFrame, query: str = "query_id", key: str = "url_key") -> DataFrame:
    """Per query and key the longest snippet; among equals the first by rank, then by engine."""
    order = F.struct(F.length("snippet").alias("n"), (-F.col("rank")).alias("r"), (-F.col("engine")).alias("e"))
    return hits.groupBy(query, key).agg(F.max_by("snippet", order).alias("snippet"), F.array_join(F.array_sort(F.collect_set(F.col("engine").cast("string"))), ",").alias("engines"))


def interleave(hits: DataFrame, query: str = "query_id", list_no: str = "list_no", rank: str = "rank", key: str = "url_key", beside: tuple[Column, ...] = ()) -> DataFrame:
    """Round-robin union of ranked lists; the first occurrence of a key stays, with its new position from 1, and aggregates of its occurrences beside it."""
    first = hits.groupBy(query, key).agg(F.min(F.struct(F.col(rank).alias("rank"), F.col(list_no).alias("list_no"))).alias("at"), *beside)
    others = [c for c in first.columns if c not in (query, key, "at")]
    w = Window.partitionBy(query).orderBy("at.rank", "at.list_no", key)
    return first.select(query, key, F.col("at.rank").alias("rank"), F.col("at.list_no").alias("list_no"), F.row_number().over(w).alias("position"), *others)


def first_working_source(status: DataFrame, query: str = "query_id") -> DataFrame:
    """Ordered failover: per query the first source, by preference, that is alive and has rows."""
    good = status.where(F.col("ok") & (F.col("n_rows") > 0))
    return good.groupBy(query).agg(F.min_by("engine", "preference").alias("engine"), F.min_by("n_rows", "preference").alias("n_rows"))


def source_flags(status: DataFrame, query: str = "query_id") -> DataFrame:
    """Per query: whether every source failed (rather than came back empty), whether any did, and the rows in all."""
    return status.groupBy(query).agg(F.bool_and(~F.col("ok")).alias("all_failed"), F.bool_or(~F.col("ok")).alias("some_failed"), F.sum("n_rows").alias("n_rows"))


def needs_second_opinion(rows: DataFrame, query: str = "query_id", strong: Column | None = None, least_rows: int = 8, least_strong: int = 3) -> DataFrame:
    """Per query: whether another source is asked, as there are rows enough but few of them strong."""
    strong = F.col("strong") if strong is None else strong
    counts = rows.groupBy(query).agg(F.count("*").alias("n_rows"), F.count_if(strong).alias("n_strong"))
    return counts.withColumn("second_opinion", (F.col("n_rows") >= least_rows) & (F.col("n_strong") < least_strong))


def word_stem(word: Column) -> Column:
    """A word without its ending: ing or ed of six letters and more (with the consonant that it doubled), and a plural's."""
    bare = F.when(F.length(word) >= 6, F.regexp_replace(word, "(ing|ed)$", "")).otherwise(word)
    single = F.when((bare != word) & bare.rlike("([b-df-hj-np-tv-z])\\1$"), F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)
    return F.regexp_replace(single, "(ies|es|s)$", "")


def coverage(question: Column, text: Column) -> Column:
    """The share of a question's stems that a text contains, or has within one edit of a long word; 1 if nothing is asked."""
    asked = F.filter(F.split(F.lower(question), "[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~w.isin(*QUERY_STOP))
    long = lambda low: F.array_distinct(F.filter(F.split(low, "[^a-z0-9]+"), lambda w: F.length(w) >= 6))
    near = lambda s, w: (F.abs(F.length(s) - F.length(w)) <= 1) & within_one_edit(s, w)
    close = lambda s, words: (F.length(s) >= 6) & F.exists(words, lambda w: near(s, w))
    found = lambda stems, low: let(long(low), lambda words: F.size(F.filter(stems, lambda s: F.contains(low, s) | close(s, words))))
    share = lambda stems: F.when(F.size(stems) == 0, F.lit(1.0)).otherwise(let(F.lower(text), lambda low: found(stems, low)) / F.size(stems))
    return let(F.array_distinct(F.transform(asked, lambda w: let(w, word_stem))), share)


def weighted_fusion(hits: DataFrame, query: str, key: str, question: str, title: str, snippet: str, count: int, least: float = 0.5) -> DataFrame:
    """Per query the `count` best keys: reciprocal ranks by engine weight, times 0.3 and the coverage of the question.

    A key of one engine that covers less than `least` of the question goes. Of several snippets the longest stays.
    """
    share = F.col("weight") / (F.col("rank") + F.lit(RANK_OFFSET))
    longest = F.struct(F.length(snippet).alias("n"), (-F.col("rank")).alias("r"), F.col("engine").alias("e"))
    first = F.struct("rank", "engine")
    rows = hits.groupBy(query, key).agg(F.sum(share).alias("sum_"), F.count_distinct("engine").alias("n_engines"), F.max_by(snippet, longest).alias(snippet), F.min_by(title, first).alias(title), F.min(question).alias(question))
    cover = F.array(coverage(F.col(question), F.concat_ws(" ", title, snippet, key)))
    rows = rows.withColumn("cover", F.explode(F.filter(cover, lambda c: (c >= least) | (F.col("n_engines") > 1))))  # a step that isn't merged
    rows = rows.withColumn("score", F.round(F.col("sum_") * (F.lit(0.3) + F.col("cover")), 9))
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= count).select(query, key, title, snippet, "n_engines", F.round("cover", 9).alias("cover"), "score", "position")
