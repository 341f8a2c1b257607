"""Filters that look at their query's other rows: keep a strict subset only where enough of it remains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_if_enough(rows: DataFrame, query: str, keep: Column, least: int) -> DataFrame:
    """Rows that pass, for queries with at least `least` of them; all rows of the other queries."""
    n = F.count_if(keep).over(Window.partitionBy(query))
    return rows.withColumn("enough_", n >= least).where(~F.col("enough_") | keep).drop("enough_")


def drop_minority(rows: DataFrame, query: str, soft: Column, hard: Column) -> DataFrame:
    """Hard failures go; soft ones go where they are fewer than half of what is left."""
    w = Window.partitionBy(query)
    left = rows.where(~hard).withColumns({"soft_": F.count_if(soft).over(w), "all_": F.count("*").over(w)})
    return left.where(~(soft & (2 * F.col("soft_") < F.col("all_")))).drop("soft_", "all_")


def prefer_fresh(rows: DataFrame, query: str, date: str, since: Column, position: str, least: int = 3) -> DataFrame:
    """Where at least `least` rows are dated within the window: those first, then undated ones, without dated old ones."""
    fresh, undated = F.col(date) >= since, F.col(date).isNull()
    marked = rows.withColumn("enough_", F.count_if(fresh).over(Window.partitionBy(query)) >= least)
    kept = marked.where(~F.col("enough_") | fresh | undated)
    rank = F.when(F.col("enough_") & undated, 1).otherwise(0)
    return kept.withColumn("new_position", F.row_number().over(Window.partitionBy(query).orderBy(rank, position))).drop("enough_")


def coverage(words_asked: Column, text: Column) -> Column:
    """The share of asked words, by six-letter stems, that stand in a text; null if nothing is asked."""
    stem = lambda w: F.substring(w, 1, 6)
    asked = F.array_distinct(F.transform(words_asked, stem))
    have = F.transform(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), stem)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, have)) / F.size(asked))


def year_conflict(asked: Column, found: Column) -> Column:
    """Whether years are found and asked for, and none found is within one of one asked."""
    near = F.exists(found, lambda y: F.exists(asked, lambda q: F.abs(q - y) <= 1))
    return (F.size(asked) > 0) & (F.size(found) > 0) & ~near


def blocked_host(host: Column, path: Column, words: tuple[str, ...]) -> Column:
    """Whether a word stands as a whole label or part of one cut off by hyphens in the host, or as a path segment."""
    alternatives = "|".join(words)
    return host.rlike(f"(^|[.-])({alternatives})([.-]|$)") | path.rlike(f"(^|/)({alternatives})(/|$)")
