"""Connected components of a graph given as edges, by smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node in `edges` (a, b); component is the smallest id that can be reached.

    Each step takes the smallest label of the neighbours and then the label of that label, so labels travel twice as
    far with each step. Labels are a table of their own for each step; nothing but one changed-or-not count is collected.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("before"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("component").alias("beyond"))
        step = lower.join(jump, "mid").select("id", "before", F.least("mid", "beyond").alias("component"))
        step = saved(step, "labels")
        labels = step.select("id", "component")
        if step.where("component < before").isEmpty():
            return labels
