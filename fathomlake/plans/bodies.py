"""Queries over nested cards; registered beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomlake.operators import bodies, nodes
from fathomlake.plans.catalogue import query, table


def _node(**fields: Column | str) -> Column:
    return F.to_json(F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items())))


def cards_of_threads(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, body): a thread as a nested card: a section a turn with its text, its sentences as a list, figures that come again, and an unknown node."""
    k = F.col("turn")
    sentences = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda s: s != "")
    list_ = F.concat(F.lit('{"type":"list","items":'), F.to_json(F.transform(sentences, lambda s: F.struct(s.alias("text")))), F.lit("}"))
    figures = F.to_json(F.array(F.struct(F.lit("Price of it").alias("label"), F.concat(F.lit("$"), (k % 3).cast("string"), F.lit("9")).alias("value")), F.struct(F.lit("Said").alias("label"), F.col("text").alias("value"))))
    rows = F.concat(F.lit('{"type":"keyvalue","items":'), figures, F.lit("}"))
    cut = _node(type="callout", text=F.concat(F.col("text"), F.lit(" It is said that the share of it has come to "), (k + 1).cast("string"), F.lit(".")))
    tile = _node(type="tile", label=F.concat(F.lit("Share "), F.col("role")), value=F.concat((k + 1).cast("string"), F.lit("."), (F.col("conv_id") % 7).cast("string"), F.lit("%")))
    inner = F.concat(F.lit('{"type":"stack","children":['), _node(type="text", text=F.col("text")), F.lit(","), list_, F.lit("]}"))
    section = F.concat(F.lit('{"type":"section","title":"turn","children":['), inner, F.lit(","), rows, F.lit(","), cut, F.lit("]}"))
    parts = F.concat_ws(",", section, tile, _node(type="quote", text=F.col("text")), F.when(k % 4 == 1, F.lit('{"type":"widget","children":[]}')))
    turns = table(spark, d, "conversations").select("conv_id", F.struct("turn", parts.alias("part")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]), ",")
    return turns.groupBy("conv_id").agg(F.concat(F.lit("["), joined, F.lit("]")).alias("body"))


@query()
def card_text_slots(spark: SparkSession, d: str) -> DataFrame:
    return bodies.text_slots(cards_of_threads(spark, d), "conv_id", "body")


@query()
def card_polished(spark: SparkSession, d: str) -> DataFrame:
    return bodies.polished(cards_of_threads(spark, d), "conv_id", "body")


@query()
def card_said_once(spark: SparkSession, d: str) -> DataFrame:
    return bodies.said_once(cards_of_threads(spark, d), "conv_id", "body")


@query()
def card_facts_once(spark: SparkSession, d: str) -> DataFrame:
    return bodies.without_repeated_facts(cards_of_threads(spark, d), "conv_id", "body")


@query()
def card_decimals(spark: SparkSession, d: str) -> DataFrame:
    return bodies.with_cut_decimals(cards_of_threads(spark, d), "conv_id", "body")


@query()
def card_sanitized(spark: SparkSession, d: str) -> DataFrame:
    out = nodes.sanitized(cards_of_threads(spark, d), "conv_id", "body")
    return out.select("conv_id", "body", F.coalesce(F.array_join(F.array_sort(F.transform(F.map_entries("dropped"), lambda e: F.concat_ws(": ", e["key"], e["value"].cast("string")))), ", "), F.lit("")).alias("dropped"))
