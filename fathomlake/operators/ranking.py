"""Stable re-ranking, caps, paging and top-k over rows that carry their position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diversify(rows: DataFrame, query: str, group: str, position: str, cap: int = 2) -> DataFrame:
    """At most `cap` rows of a group up front, the others behind, both in their order; adds `new_position` from 1."""
    nth = F.row_number().over(Window.partitionBy(query, group).orderBy(position))
    flagged = rows.withColumn("tail_", (nth > cap).cast("int"))
    return flagged.withColumn("new_position", F.row_number().over(Window.partitionBy(query).orderBy("tail_", position))).drop("tail_")


# Words of a question, and labels of hosts, that name no site.
SITE_STOP = "the and for with how what why when who are vs best does can find give source official page this that from real which should buy get".split()
GENERIC_LABELS = "com org net www edu gov int docs support help blog news app web online site info store shop deals review reviews guide tech".split()


def named_site(question: Column, host: Column) -> Column:
    """Whether a label of a host is a word of the question that names a site."""
    words = F.filter(F.split(F.lower(question), "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(*SITE_STOP))
    labels = F.filter(F.split(F.lower(host), "[.-]"), lambda p: (F.length(p) > 2) & ~p.isin(*GENERIC_LABELS))
    return F.arrays_overlap(words, labels)


def diversify_named(rows: DataFrame, query: str, question: str, host: str, position: str, cap: int = 2, front: int = 3) -> DataFrame:
    """The first `front` rows of sites that the question names lead; then at most `cap` rows of each other host, named sites uncapped; then the rest. Adds `new_position` from 1."""
    flagged = rows.withColumn("own_", named_site(F.col(question), F.col(host)).cast("int"))
    flagged = flagged.withColumn("front_", ((F.col("own_") == 1) & (F.row_number().over(Window.partitionBy(query, "own_").orderBy(position)) <= front)).cast("int"))
    nth = F.row_number().over(Window.partitionBy(query, host, "front_").orderBy(position))
    place = F.when(F.col("front_") == 1, 0).when((F.col("own_") == 1) | (nth <= cap), 1).otherwise(2)
    flagged = flagged.withColumn("place_", place)
    return flagged.withColumn("new_position", F.row_number().over(Window.partitionBy(query).orderBy("place_", position))).drop("own_", "front_", "place_")


def flag_first(rows: DataFrame, query: str, flag: Column, position: str) -> DataFrame:
    """A stable partition: rows with the flag lead; adds `new_position` from 1."""
    return rows.withColumn("new_position", F.row_number().over(Window.partitionBy(query).orderBy(F.when(flag, 0).otherwise(1), position)))


def cap_class(rows: DataFrame, query: str, flag: Column, position: str, cap: int = 2) -> DataFrame:
    """Rows of a class after its first `cap` go last; adds `new_position` from 1."""
    seen = F.count(F.when(flag, 1)).over(Window.partitionBy(query).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    late = F.when(flag & (seen > cap), 1).otherwise(0)
    return rows.withColumn("late_", late).withColumn("new_position", F.row_number().over(Window.partitionBy(query).orderBy("late_", position))).drop("late_")


def top_k(rows: DataFrame, query: str, k: int, *order: Column | str) -> DataFrame:
    """The first k rows of each query; Spark prunes to k rows a group before the shuffle."""
    return rows.withColumn("rank_in_query", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("rank_in_query") <= k)


def keyset_page(rows: DataFrame, owner: str, time: str, key: str, after: tuple | None, limit: int) -> DataFrame:
    """For each owner the next page behind the cursor (time, key), newest first, with one row more to tell whether there is another."""
    page = rows
    if after is not None:
        t, k = F.lit(after[0]).cast(rows.schema[time].dataType), F.lit(after[1])
        page = rows.where((F.col(time) < t) | ((F.col(time) == t) & (F.col(key) < k)))
    return top_k(page, owner, limit + 1, F.desc(time), F.desc(key))


def nearest_rank(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles without interpolation: of n sorted values, the one with index floor(p n), the last at most. Equal values are counted first."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c_"))
    w = Window.partitionBy(group)
    ranked = counts.withColumns({"upto_": F.sum("c_").over(w.orderBy(value)), "n_": F.sum("c_").over(w)})
    at = lambda p: F.least(F.col("n_"), F.floor(F.lit(p) * F.col("n_")) + 1)
    return ranked.groupBy(group).agg(*(F.min(F.when(F.col("upto_") >= at(p), F.col(value))).alias(name) for name, p in shares.items()))


def downsample(points: DataFrame, series: str, time: str, most: int) -> DataFrame:
    """Of a series with more than `most` points, those at floor(i n / most); the last point always stays."""
    w = Window.partitionBy(series)
    p = points.withColumns({"nth_": F.row_number().over(w.orderBy(time)) - 1, "n_": F.count("*").over(w)})
    step = F.col("n_") / F.lit(float(most))
    slot = F.ceil(F.col("nth_") / step)
    kept = (F.col("n_") <= most) | (F.col("nth_") == F.floor(slot * step)) | (F.col("nth_") == F.col("n_") - 1)
    return p.where(kept).drop("nth_", "n_")


def move_to_front(asks: DataFrame, owner: str, text: str, time: str, tie: str, most: int) -> DataFrame:
    """Each owner's distinct texts, letters compared in lower case, newest first; the newest spelling stays."""
    folded = F.lower(F.trim(text))
    newest = asks.withColumn("folded_", folded).where(F.col("folded_") != "")
    newest = newest.groupBy(owner, "folded_").agg(F.max_by(text, F.struct(time, tie)).alias(text), F.max(F.struct(F.col(time).alias("t"), F.col(tie).alias("k"))).alias("at_"))
    ranked = newest.withColumn("position", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("at_.t"), F.desc("at_.k"))))
    return ranked.where(F.col("position") <= most).select(owner, text, F.col("at_.t").alias(time), "position")


#: Prefixes that are broadcast whole; beyond that names are filed under their runs.
FEW_PREFIXES = 64


def prefix_tiers(names: DataFrame, prefixes: DataFrame, name: str, position: str, most: int, width: int = 4) -> DataFrame:
    """Completions of each prefix: names that begin with it, then those where a word does, then those that contain it.

    Up to FEW_PREFIXES prefixes are broadcast and compared with every name, fewer comparisons than a name has runs. More
    are filed like the names under runs of at most `width` characters: a prefix under its first ones, a name under every
    run of that many that it has. A prefix of one or two characters fits most names whatever the index.
    """
    low, typed = F.lower(name), F.col("prefix")
    tier = F.when(low.startswith(typed), 0).when(F.contains(low, F.concat(F.lit(" "), typed)), 1).when(F.contains(low, typed), 2)
    keyed = prefixes.withColumn("size_", F.least(F.length(typed), F.lit(width))).where("size_ > 0").withColumn("run_", F.substring(typed, F.lit(1), F.col("size_")))
    run = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))
    counts = keyed.groupBy("size_").count().collect()  # width numbers at most
    if sum(n for _, n in counts) <= FEW_PREFIXES:
        found = names.crossJoin(F.broadcast(keyed)).withColumn("tier", tier).where("tier IS NOT NULL")
        return top_k(found, "prefix", most, "tier", position).select("prefix", name, "tier", "rank_in_query")
    lengths = [size for size, _ in counts]
    runs = F.array_distinct(F.concat(*map(run, lengths))) if lengths else F.array().cast("array<string>")
    found = names.withColumn("run_", F.explode(runs)).join(keyed, "run_").withColumn("tier", tier).where("tier IS NOT NULL")
    return top_k(found, "prefix", most, "tier", position).select("prefix", name, "tier", "rank_in_query")
