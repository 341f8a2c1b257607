"""Pictures for the items of a card."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomlake.functions import pictures

from .usage import _in_order


def best_pictures(items: DataFrame, pool: DataFrame, group: str, item: str, name: str, picture: str, title: str, alt: str, url: str) -> DataFrame:
    """(group, item, picture, url): of each item, in order of `item`, the best picture of its group that is of it and that none before it took.

    Better is the larger share of the item's words in the title, then fewer further words, then the smaller `picture`.
    Pictures are the same by URL; ones without URL are left out, and so are items that no picture is of. Items and pool
    meet in a group, the pictures found for one card; the other items of the group are an item's siblings.
    """
    names = items.groupBy(group).agg(F.collect_set(name).alias("names_"))
    asked = items.select(group, item, name).join(names, group).withColumn("siblings_", F.array_except("names_", F.array(name))).drop("names_")
    met = asked.join(pool.where(F.coalesce(url, F.lit("")) != "").select(group, picture, title, alt, url), group)
    of_it = met.where(pictures.fits(F.col(name), F.col(title), F.col(alt), F.col(url), F.col("siblings_")))
    title_ = F.coalesce(title, F.lit(""))
    order = (F.desc("share_"), "further_", picture)
    scored = of_it.select(group, item, picture, url, pictures.match_share(F.col(name), title_).alias("share_"), pictures.further_words(F.col(name), F.col(title)).alias("further_"))
    ranked = scored.withColumn("rank_", F.row_number().over(Window.partitionBy(group, item).orderBy(*order)))

    def step(state, own, u):
        last, served, used = state
        taken = u not in used and not (served and own == last)
        return (own, taken or (served and own == last), used | {u} if taken else used), taken

    chosen = _in_order(ranked, [group], item, "rank_", step, (None, False, frozenset()), [item, url], "taken_")
    return chosen.where("taken_").select(group, item, picture, url)
