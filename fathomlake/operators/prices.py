"""Prices of plans and picks over rows: the one for a basis of billing, the basis that a source states, priced picks alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomlake.functions.reading import billing_near
from fathomlake.functions.text import host_of, url_key


def price_for_basis(prices: DataFrame, plan: str, billing: str, position: str, amount: str, source: str) -> DataFrame:
    """One row a plan and basis of billing: the first with an amount and a source, else the first; partial aggregation precedes the shuffle.

    Rows at one position are taken by their other columns, so the choice doesn't depend on the order they come in.
    """
    grounded = F.col(amount).isNotNull() & (F.coalesce(source, F.lit("")) != "")
    row = F.struct(*(F.col(c) for c in prices.columns if c not in (plan, billing)))
    best = prices.groupBy(plan, billing).agg(F.min_by(row, F.struct((~grounded).alias("loose"), F.col(position).alias("position"), row.alias("row"))).alias("best_"))
    return best.select(plan, billing, "best_.*")


def source_key(url: Column) -> Column:
    """What makes two URLs one source: host and path; null where there is no host."""
    return F.when(host_of(url) != "", url_key(F.regexp_replace(url, "[?#].*$", "")))


def billing_from_sources(prices: DataFrame, sources: DataFrame, scope: str, position: str, amount: str, billing: str, source: str, url: str, text: str, reach: int = 2500) -> DataFrame:
    """Prices with the billing that their source states beside the amount, within its first `reach` characters; their own where it says nothing.

    A source is the first of its scope, by `position` and then URL, with the price's host and path; sources are cut down
    to one a key before prices meet them, so a key has one partner however many copies there are.
    """
    first = sources.where(source_key(F.col(url)).isNotNull()).groupBy(F.col(scope), source_key(F.col(url)).alias("key_"))
    first = first.agg(F.min_by(F.substring(text, 1, reach), F.struct(position, url)).alias("text_"))
    keyed = prices.withColumn("key_", source_key(F.col(source)))
    spelled = F.regexp_replace(F.col(amount).cast("decimal(18,6)").cast("string"), "\\.?0+$", "")
    grouped = F.concat(F.format_number(F.floor(amount), 0), F.regexp_extract(spelled, "(\\..*)$", 1))
    stated = F.when(F.col(amount).isNotNull(), billing_near(F.col("text_"), F.concat(F.lit("(?:"), spelled, F.lit("|"), grouped, F.lit(")"))))
    return keyed.join(first, [scope, "key_"], "left").withColumn(billing, F.coalesce(stated, F.col(billing))).select(*prices.columns)


def priced_picks(picks: DataFrame, card: str, priced: Column) -> DataFrame:
    """Picks of a card without the unpriced ones once any has a price; all of them where none has."""
    some = picks.withColumn("priced_", priced).groupBy(card).agg(F.max("priced_").alias("some_"))
    return picks.withColumn("priced_", priced).join(some, card).where("priced_ OR NOT some_").drop("priced_", "some_")
