"""Suggestions and subjects from histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recent_subjects(asks: DataFrame, owner: str, subject: str, time: str, tie: str, most: int = 8) -> DataFrame:
    """An owner's subjects by their newest ask, newest first."""
    newest = asks.groupBy(owner, subject).agg(F.max(F.struct(F.col(time).alias("t"), F.col(tie).alias("k"))).alias("at_"))
    placed = newest.withColumn("position", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("at_.t"), F.desc("at_.k"))))
    return placed.where(F.col("position") <= most).drop("at_")


def by_frequency(starters: DataFrame, asks: DataFrame, owner: str, category: str, position: str) -> DataFrame:
    """Starters for each owner that asked anything, those of categories asked most often first."""
    counts = asks.groupBy(owner, category).agg(F.count("*").alias("n"))
    every = counts.groupBy(owner).agg(F.map_from_entries(F.collect_list(F.struct(category, "n"))).alias("n_of"))
    # One row an owner with its few categories; starters are a short fixed list, carried as an array.
    listed = F.broadcast(starters.agg(F.collect_list(F.struct(*starters.columns)).alias("starters")).withColumn("one_", F.lit(1)))
    rows = every.withColumn("one_", F.lit(1)).join(listed, "one_").select(owner, "n_of", F.inline("starters"))
    rows = rows.withColumn("asked", F.coalesce(F.try_element_at("n_of", F.col(category)), F.lit(0)))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("asked"), position))).drop("n_of")


def merged_suggestions(sources: list[tuple[DataFrame, int | None]], owner: str, text: str, position: str, most: int = 6) -> DataFrame:
    """Suggestions of several sources in turn, each with its own limit, letters compared in lower case, at most `most`."""
    parts = []
    for k, (df, limit) in enumerate(sources):
        nth = df.select(owner, text, F.row_number().over(Window.partitionBy(owner).orderBy(position)).alias("pos_")).withColumn("source", F.lit(k))
        parts.append(nth.where(F.col("pos_") <= limit) if limit else nth)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    first = rows.groupBy(owner, F.lower(text).alias("key_")).agg(F.min_by(text, F.struct("source", "pos_")).alias(text), F.min(F.struct("source", "pos_")).alias("at_"))
    placed = first.withColumn("position", F.row_number().over(Window.partitionBy(owner).orderBy("at_")))
    return placed.where(F.col("position") <= most).select(owner, text, F.col("at_.source").alias("source"), "position")


def lanes(ideas: DataFrame, owner: str, lane: str, position: str, most: int) -> DataFrame:
    """Round-robin over lanes: the first idea of each, then the second of each."""
    nth = ideas.withColumn("round", F.row_number().over(Window.partitionBy(owner, lane).orderBy(position)))
    placed = nth.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy("round", lane)))
    return placed.where(F.col("place") <= most)
