"""Queries over picks and plans, their prices and pictures, and over months and answers in sources; registered beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomlake.functions import prices as money
from fathomlake.functions.reading import MONTHS
from fathomlake.operators import pictures, prices, sourced
from fathomlake.plans.catalogue import query, table

NOW = "2024-10-15"
NAMES = tuple(m.capitalize() for m in MONTHS)
NAMES_SQL = "[" + ", ".join(f"'{m}'" for m in NAMES) + "]"


def _say(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _text(c: Column) -> Column:
    return c.cast("string")


@query("""WITH p AS (SELECT p_partkey, p_name, 100 + p_partkey % 900 AS was, 10 + p_size AS now, CAST(20 + p_partkey % 40 AS DOUBLE) AS cap FROM part)
SELECT p_partkey, p_name || ' costs' || CASE WHEN p_partkey % 3 = 0 THEN ' $' || now || '.50' ELSE '' END || ' today, under $99' || CASE WHEN was = 400 THEN ' ($400k).' ELSE ' .' END AS stripped,
  'from' || CASE WHEN now > cap THEN '' ELSE ' $' || now END || CASE WHEN cap < 30 THEN ',, best' ELSE ', up to $30, best' END AS within, CASE WHEN now <= cap THEN 'Under $' || now END AS chip,
  now <> 30 AS priced FROM p""")
def stray_prices(spark: SparkSession, d: str) -> DataFrame:
    """Each part's prose without stray prices, its label within a budget, and whether it states a price beyond the budget said again."""
    k, now = F.col("p_partkey"), 10 + F.col("p_size")
    cap = (20 + k % 40).cast("double")
    amount = _text(now)
    prose = _say(F.col("p_name"), " costs $", amount, ".50 today, under $99 ($", _text(100 + k % 900), "k).")
    keep = F.when(k % 3 == 0, F.array((now + 0.5).cast("double"), F.lit(400_000.0))).otherwise(F.array(F.lit(400_000.0)))
    label = _say("from $", amount, ", up to $30, best")
    said = F.when(k % 5 == 0, _say("under $", amount)).otherwise(_say("$", amount, " under $30"))
    return table(spark, d, "part").select(
        "p_partkey", money.without_stray_prices(prose, keep).alias("stripped"), money.within_budget(label, cap).alias("within"), money.chip_within(_say("Under $", amount), cap).alias("chip"), money.states_price(said, F.array(F.lit(30.0))).alias("priced"),
    )


@query("""WITH x AS (SELECT l_partkey AS plan, l_linenumber % 2 = 0 AS yearly, l_orderkey * 8 + l_linenumber AS position, CASE WHEN CAST(l_quantity AS BIGINT) % 3 <> 0 THEN l_quantity END AS amount, CASE WHEN l_suppkey % 2 = 0 THEN '' ELSE 'https://shop.example/' || l_suppkey END AS source FROM lineitem)
SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY plan, yearly ORDER BY amount IS NULL OR source = '', position) = 1""")
def plan_basis_prices(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("plan"), (F.col("l_linenumber") % 2 == 0).alias("yearly"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("position"),
        F.when(F.col("l_quantity").cast("long") % 3 != 0, F.col("l_quantity")).alias("amount"), F.when(F.col("l_suppkey") % 2 == 0, "").otherwise(_say("https://shop.example/", _text(F.col("l_suppkey")))).alias("source"),
    )
    return prices.price_for_basis(rows, "plan", "yearly", "position", "amount", "source")


@query("""SELECT o_orderkey, CAST(1000 + o_custkey % 500 AS DOUBLE) AS amount, CASE WHEN o_orderkey % 2 = 0 THEN CASE o_custkey % 4 WHEN 0 THEN 'annual' WHEN 1 THEN 'monthly' ELSE 'unknown' END ELSE 'unknown' END AS billing FROM orders""")
def billing_stated(spark: SparkSession, d: str) -> DataFrame:
    """Prices of orders with the basis that their customer's page states beside the amount, written with commas; odd orders cite a page that isn't there."""
    k = F.col("c_custkey")
    amount = F.format_number(1000 + k % 500, 0)
    words = F.when(k % 4 == 0, " per seat, billed annually").when(k % 4 == 1, ", pay monthly").when(k % 4 == 2, ", billed annually or billed monthly").otherwise(" each. Then $7 billed annually")
    pages = table(spark, d, "customer").select((k % 10).alias("scope"), F.lit(1).alias("position"), _say("http://www.shop.example/p/", _text(k), "/?ref=1").alias("url"), _say(F.col("c_name"), " is $", amount, words).alias("text"))
    url = F.when(F.col("o_orderkey") % 2 == 0, _say("https://shop.example/p/", _text(F.col("o_custkey")))).otherwise("https://shop.example/none")
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("scope"), (1000 + F.col("o_custkey") % 500).cast("double").alias("amount"), F.lit("unknown").alias("billing"), url.alias("source"))
    return prices.billing_from_sources(rows, pages, "scope", "position", "amount", "billing", "source", "url", "text").select("o_orderkey", "amount", "billing")


@query("""WITH x AS (SELECT l_orderkey // 2 AS card, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) % 4 = 0 AS priced FROM lineitem) SELECT card, l_orderkey, l_linenumber FROM x QUALIFY priced OR NOT bool_or(priced) OVER (PARTITION BY card)""")
def priced_picks(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("l_quantity").cast("long") % 4 == 0, _say("a pick at $", _text(F.col("l_quantity").cast("long")))).otherwise("a pick under $50")
    rows = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 2).alias("card"), "l_orderkey", "l_linenumber", text.alias("text"))
    return prices.priced_picks(rows, "card", money.states_price(F.col("text"), F.array(F.lit(50.0)))).select("card", "l_orderkey", "l_linenumber")


FIRST, AGAIN, SAID = "1 + (conv_id + turn) % 12", "1 + (conv_id * 5 + turn * 7) % 12", "1 + (conv_id * 3 + turn) % 12"


@query(f"""WITH s AS (SELECT conv_id, turn + 1 AS cite, {SAID} AS month FROM conversations), every AS (SELECT conv_id, list(DISTINCT month) AS months FROM s GROUP BY conv_id),
x AS (SELECT c.conv_id, c.turn, c.text, {FIRST} AS first, {AGAIN} AS again, coalesce((SELECT list(DISTINCT month) FROM s WHERE s.conv_id = c.conv_id AND s.cite IN (c.turn % 3 + 1, 99)), e.months) || [10, 1 + c.conv_id % 12] AS known FROM conversations c JOIN every e USING (conv_id)),
y AS (SELECT conv_id, turn, coalesce(text, '') || ' It came out in ' || ({NAMES_SQL})[first] || ' 2024, and again in late ' || ({NAMES_SQL})[again] || '.' AS text,
  coalesce(text, '') || ' It came out in ' || CASE WHEN list_contains(known, first) THEN ({NAMES_SQL})[first] || ' ' ELSE '' END || '2024, and again' || CASE WHEN list_contains(known, again) THEN ' in late ' || ({NAMES_SQL})[again] ELSE '' END || '.' AS kept FROM x)
SELECT conv_id, turn, CASE WHEN kept = text THEN text ELSE trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(kept, '\\s+([,.;:)])', '\\1', 'g'), '\\(\\s*\\)', '', 'g'), '\\s{{2,}}', ' ', 'g'), ',\\s*,', ',', 'g')) END AS text FROM y""")
def sourced_months(spark: SparkSession, d: str) -> DataFrame:
    """Turns as slots of their thread's card, which keep the months that the turns they cite, the question or the day state."""
    month = lambda expr: F.element_at(F.array(*map(F.lit, NAMES)), F.expr(expr).cast("int"))
    turns = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    text = _say(F.col("text"), " It came out in ", month(FIRST), " 2024, and again in late ", month(AGAIN), ".")
    slots = turns.select("conv_id", "turn", text.alias("text"), F.array(F.col("turn") % 3 + 1, F.lit(99).cast("long")).alias("cites"), _say("What of ", month("1 + conv_id % 12"), " 3?").alias("asked"))
    said = turns.select("conv_id", (F.col("turn") + 1).alias("source"), _say("Said on ", month(SAID), " 5, 2024.").alias("said"))
    return sourced.with_sourced_months(slots, said, "conv_id", "turn", "text", "cites", "source", "said", F.col("asked"), F.lit(NOW).cast("date")).select("conv_id", "turn", "text")


def threads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The first turn of each thread as a question, and all its turns as pages."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 1, _say("According to the group of it, ", F.col("text"))).otherwise(F.col("text")).alias("text"))
    return turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("ask")).withColumn("q_id", F.col("conv_id")), turns


@query()
def answering_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentence of each turn that has most of the words of its thread's first turn."""
    asked, pages = threads(spark, d)
    return sourced.answering_sentences(asked, pages, "q_id", "ask", "conv_id", "turn", "text")


def shelves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Twenty parts a card as items, and pictures of them: one a part, some of these of two, some without a title that tells."""
    k = F.col("p_partkey")
    card = F.floor(k / 20).alias("card")
    named = _say(F.initcap("p_name"), " ", _text(F.col("p_size") % 7))
    items = table(spark, d, "part").select(card, k.alias("item"), named.alias("name"))
    title = F.when(k % 5 == 0, _say(named, " vs Big Gizmo 3")).when(k % 7 == 0, F.lit(None)).otherwise(_say(named, F.when(k % 2 == 0, " shown in a garden").otherwise("")))
    url = _say("https://pictures.example/", F.when(k % 11 == 0, F.lit("same")).otherwise(_say(F.translate(named, " ", "-"), "-", _text(k))), ".jpg?w=3")
    return items, table(spark, d, "part").select(card, k.alias("picture"), title.alias("title"), F.lit(None).cast("string").alias("alt"), url.alias("url"))


@query()
def item_pictures(spark: SparkSession, d: str) -> DataFrame:
    items, pool = shelves(spark, d)
    return pictures.best_pictures(items, pool, "card", "item", "name", "picture", "title", "alt", "url")
