"""Queries over questions: every turn of conversations stands for one, worded from a list and from its whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomlake.functions import asks, wording
from fathomlake.plans.catalogue import query, table

QUESTIONS = (
    "Compare electric and gas heating for an old house", "Lions vs Bears score tonight", "solar vs wind power", "How does a heat pump actually work?", "weather in Oslo", "What's the weather like today?",
    "best laptop under $800", "cheap 4-port USB hub for 3 devices", "top 5 ways to save water", "What is the sales tax in Ohio and how much is the fee?", "battery life and weight of the Falcon 9 phone", "exact words of the speech",
    "peer-reviewed papers on sleep from Walker 2017", "arXiv preprints about graph search", "clinical trials research on aspirin", "toilet paper deals", "latest news about Mars", "live score of the game",
    "stock price of $rdw and $nvda", "why is $ACME dropping today", "release date of the next game", "That's not today's news", "old results, this is out of date", "split the bill three ways between two",
    "My brother and I share it, how much each?", "what's the total of 12 + 30", "add the price and the tax", "calculate the average points per game", "how many more than the difference", "who are the rookies to watch",
    "which players scored most", "who is Ada Lovelace", "What is Ada Lovelace?", "should I lease or buy a car", "how to bake bread step by step", "write an email to my landlord",
    "fix this python function error", "3-day itinerary for Rome", "meal plan for a team of 12", "pricing for a 5-person agency", "cost per seat for 40 engineers", "flowchart of the water cycle",
    "explain how a jet engine works", "visualize photosynthesis", "population growth statistics", "photos of places to visit", "how hot will it get", "temperature",
    "forecast this weekend", "7 day forecast", "history of Rome timeline", "injury report and roster moves", "standings and schedule", "trade rumors and contracts",
    "Mercury", "Mi Band 11 review", "Mi Band 8 pro against Mi Band 11", "iPhone 17 price", "And with tax?", "Is it heavy?", "What about Google?", "Capital One cards one day", "One day at Acme", "Ricky one bleuflame",
    "Does Zurich have a lake?", "is the site down today", "exchange rate right now; and then why, and also what next for the euro in the coming months of this year?", "two questions? really?", "studies on coffee, and what does the research say about it", "monitor below 300",
)
SITES = (None, "example.org", "docs.example.com")
QUESTIONS_SQL = "[" + ", ".join("'" + q.replace("'", "''") + "'" for q in QUESTIONS) + "]"
ASKS_SQL = f"""asks AS (SELECT conv_id, turn, ({QUESTIONS_SQL})[1 + (conv_id * 7 + turn * 13) % {len(QUESTIONS)}] || ' ' || coalesce(text, '') AS ask,
  ({QUESTIONS_SQL})[1 + (conv_id * 5 + turn * 3) % {len(QUESTIONS)}] AS prior, (['any', 'week', 'day'])[1 + turn % 3] AS fresh FROM conversations)"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda at: F.element_at(F.array(*map(F.lit, QUESTIONS)), (1 + at % len(QUESTIONS)).cast("int"))
    c, t = F.col("conv_id"), F.col("turn")
    rest = F.concat(F.lit(" "), F.coalesce("text", F.lit("")))
    fresh = F.element_at(F.array(*map(F.lit, ("any", "week", "day"))), (1 + t % 3).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(pick(c * 7 + t * 13), rest).alias("ask"), pick(c * 5 + t * 3).alias("prior"), fresh.alias("fresh"))


def says(pattern: str, column: str = "ask") -> str:
    return "regexp_matches({}, '(?i){}')".format(column, pattern.replace("'", "''"))


def any_of(patterns, column: str = "ask") -> str:
    return "(" + " OR ".join(says(p, column) for p in patterns) + ")"


def first(rules, otherwise: str, column: str = "ask") -> str:
    return "CASE " + " ".join(f"WHEN {says(p, column)} THEN '{name}'" for name, p in rules) + f" ELSE {otherwise} END"


def of_asks(sql: str) -> str:
    return f"WITH {ASKS_SQL} SELECT conv_id, turn, {sql} FROM asks"


@query(of_asks(f"""CASE WHEN {says(wording.DEEP)} OR ({says(wording.VERSUS)} AND NOT {says(wording.LOOKUP)}) OR length(ask) - length(replace(ask, '?', '')) >= 2
  OR (len(list_filter(string_split_regex(ask, '\\s+'), lambda x: x <> '')) >= 16 AND {says(wording.CLAUSES)}) THEN 'deep' ELSE 'quick' END AS route"""))
def ask_route(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("conv_id", "turn", asks.route(F.col("ask")).alias("route"))


def layout_sql() -> str:
    def one(name, pattern, also, no):
        return f"WHEN {says(pattern)}" + (f" AND {says(also)}" if also else "") + (f" AND NOT {says(no)}" if no else "") + f" THEN '{name}'"

    named = r"WHEN regexp_matches(regexp_extract(ask, '(?i)^(?:what|who)\s+(?:is|was)\s+(.+?)\s*\??$', 1), '^\p{Lu}[\p{L}.''-]+(?: \p{Lu}[\p{L}.''-]*){1,3}$') THEN 'profile'"
    return "CASE " + " ".join(one(*r) for r in wording.LAYOUTS) + f" {named} " + " ".join(one(*r) for r in wording.LATER_LAYOUTS) + " ELSE 'answer' END"


@query(of_asks(f"{layout_sql()} AS layout"))
def ask_layout(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("conv_id", "turn", asks.layout(F.col("ask")).alias("layout"))


FRESH_SQL = f"CASE WHEN {says(wording.FRESH_DAY)} THEN 'day' WHEN {says(wording.FRESH_WEEK)} THEN 'week' ELSE 'any' END"
WORDS_TIER_SQL = f"CASE WHEN {says(wording.TIER_LIVE)} THEN 3 WHEN {says(wording.TIER_SHORT)} THEN 2 WHEN {says(wording.TIER_MEDIUM)} THEN 1 ELSE 0 END"


@query(f"""WITH {ASKS_SQL}, g AS (SELECT *, {FRESH_SQL} AS guessed FROM asks),
t AS (SELECT *, CASE WHEN guessed = 'day' OR fresh = 'any' OR (guessed = 'week' AND fresh <> 'day') THEN guessed ELSE fresh END AS strict FROM g)
SELECT conv_id, turn, guessed, strict, {any_of(wording.STALE)} AND len(list_filter(string_split_regex(trim(ask), '\\s+'), lambda x: x <> '')) <= 14 AS stale FROM t""")
def ask_freshness(spark: SparkSession, d: str) -> DataFrame:
    guessed = asks.freshness(F.col("ask"))
    rows = questions(spark, d).withColumn("guessed", guessed)
    return rows.select("conv_id", "turn", "guessed", asks.stricter(F.col("guessed"), F.col("fresh")).alias("strict"), asks.stale_complaint(F.col("ask")).alias("stale"))


@query(f"""WITH {ASKS_SQL}, t AS (SELECT conv_id, turn, greatest({WORDS_TIER_SQL}, CASE fresh WHEN 'day' THEN 2 WHEN 'week' THEN 1 ELSE 0 END) AS r FROM asks)
SELECT conv_id, turn, (['long', 'medium', 'short', 'live'])[r + 1] AS tier, ([86400, 10800, 300, 30])[r + 1] AS ttl_s, ([86400, 10800, 600, 120])[r + 1] AS search_ttl_s FROM t""")
def ask_cache_tier(spark: SparkSession, d: str) -> DataFrame:
    rows = questions(spark, d).withColumn("tier", asks.cache_tier(F.col("ask"), F.col("fresh")))
    return rows.select("conv_id", "turn", "tier", asks.ttl(F.col("tier")).alias("ttl_s"), asks.search_ttl(F.col("tier")).alias("search_ttl_s"))


PAPER_SQL = f"({says(wording.PAPER)} AND NOT {any_of(wording.NO_PAPER)})"
CEILINGS_SQL = "list_transform(regexp_extract_all(ask, '(?i){}', 1), lambda x: CAST(replace(x, ',', '') AS BIGINT))".format(wording.CEILING)
PRICED_SQL = f"(len({CEILINGS_SQL}) > 0 AND {says(wording.PRODUCT)})"
KINDS_SQL = f"""{says(wording.BRIEFING)} AS briefing, {says(wording.NEWS)} AS news, {PAPER_SQL} AS paper,
  {PAPER_SQL} AND {says(wording.PREPRINT)} AND NOT {says(wording.NO_PREPRINT)} AS preprint, {PAPER_SQL} AND {says(wording.TRIAL)} AS trial,
  NOT {says(wording.ADVICE)} AND NOT {says(wording.TAX)} AND ({PRICED_SQL} OR ({says(wording.SHOPPING)} AND ({says(wording.PRODUCT)} OR NOT {says(wording.ASKING, 'trim(ask)')}))) AS shopping,
  NOT {says(wording.NO_CALCULATION, 'trim(ask)')} AND {any_of(wording.CALCULATION)} AS calculation,
  {says(wording.NAMED_LIST)} AND NOT {says(wording.VERSUS)} AND NOT {says(wording.WHO_IS)} AS named_list, {says(wording.WATCH)} AS video,
  NOT {says(wording.NO_CONDITIONS)} AND ({says(wording.CONDITIONS)} OR ({says(wording.TEMPERATURE)} AND NOT {says(wording.DEFINING, 'trim(ask)')})) AS conditions, {says(wording.HIGH)} AS high,
  fresh IN ('day', 'week') OR {says(wording.BRIEFING)} AS social"""


@query(of_asks(KINDS_SQL))
def ask_kinds(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("ask")
    kinds = {
        "briefing": asks.says(q, wording.BRIEFING), "news": asks.says(q, wording.NEWS), "paper": asks.is_paper(q), "preprint": asks.is_preprint(q), "trial": asks.is_trial(q), "shopping": asks.is_shopping(q),
        "calculation": asks.is_calculation(q), "named_list": asks.wants_named_list(q), "video": asks.says(q, wording.WATCH), "conditions": asks.asks_conditions(q), "high": asks.says(q, wording.HIGH),
        "social": F.col("fresh").isin("day", "week") | asks.says(q, wording.BRIEFING),
    }
    return questions(spark, d).select("conv_id", "turn", *(c.alias(n) for n, c in kinds.items()))


NO_DIAGRAM_SQL = " OR ".join(f"({says(p)}" + (f" AND NOT {says(u)}" if u else "") + ")" for p, u in wording.NO_DIAGRAM)
FACT_SQL = f"CASE WHEN {says(wording.QUOTE)} THEN 'quote' WHEN {says(wording.LEVY)} OR ({says(wording.RATE)} AND {says(wording.RATE_ASK)}) THEN 'levy' WHEN {says(wording.SPEC)} THEN 'spec' END"


@query(of_asks(f"""{FACT_SQL} AS fact, CASE {FACT_SQL} WHEN 'quote' THEN regexp_matches(prior, '{wording.QUOTE_FACT.replace("'", "''")}') WHEN 'levy' THEN {says(wording.LEVY_FACT, 'prior')} WHEN 'spec' THEN {says(wording.SPEC_FACT, 'prior')} END AS stated,
  {first(wording.OPERATIONS, "'bare'")} AS operation, {first(wording.CATEGORIES, "'other'")} AS category, {first(wording.FACETS, 'NULL')} AS facet,
  CASE WHEN NOT ({NO_DIAGRAM_SQL}) AND {says(wording.DIAGRAM)} THEN CASE WHEN {says(wording.FLOW)} THEN 'flow' ELSE 'concept' END END AS diagram"""))
def ask_classes(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("ask")
    fact = asks.fact_kind(q)
    return questions(spark, d).select("conv_id", "turn", fact.alias("fact"), asks.supports(fact, F.col("prior")).alias("stated"), asks.operation(q).alias("operation"), asks.category(q).alias("category"), asks.facet(q).alias("facet"), asks.diagram(q).alias("diagram"))


SEATS_SQL = [f"TRY_CAST(nullif(regexp_extract(lower(ask), '{p}', 1), '') AS INTEGER)" for p in wording.SEATS]
SEAT_SQL = "CASE " + " ".join(f"WHEN {x} BETWEEN 1 AND 10000 THEN {x}" for x in SEATS_SQL) + " END"
NUMBERS = "two|three|four|five|six|\\d"
SHARED = [f"\\b({NUMBERS})\\s+ways\\b", f"\\b(?:between|among)\\s+({NUMBERS})\\b", f"\\bthe\\s+({NUMBERS})\\s+of us\\b"]
SPLIT_SQL = f"""coalesce({', '.join(f"nullif(regexp_extract(lower(ask), '{p}', 1), '')" for p in SHARED)})"""
NAMED_SQL = r"regexp_extract(lower(ask), '\b((?:my|our)\s+[a-z]+(?:\s+and\s+(?:my|our)\s+[a-z]+)*\s+and\s+(?:i|me))\b', 1)"


@query(of_asks(f"""array_to_string({CEILINGS_SQL}, ',') AS ceilings, {SEAT_SQL} AS seats, {SEAT_SQL} IS NOT NULL OR {says(wording.PLAN)} AS plan,
  CASE WHEN {SPLIT_SQL} IS NOT NULL THEN coalesce(list_position(['', 'two', 'three', 'four', 'five', 'six'], {SPLIT_SQL}), TRY_CAST({SPLIT_SQL} AS INTEGER)) WHEN {NAMED_SQL} <> '' THEN len(string_split_regex({NAMED_SQL}, '\\s+and\\s+')) WHEN {says(chr(92) + 'bboth of us' + chr(92) + 'b')} THEN 2 END AS sharing,
  array_to_string(regexp_extract_all(lower(ask), '(?:^|[^a-z0-9])\\$([a-z]{{1,5}})', 1), ',') AS tickers"""))
def ask_amounts(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("ask")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return questions(spark, d).select("conv_id", "turn", joined(asks.budget_amounts(q)).alias("ceilings"), asks.seats(q).alias("seats"), asks.is_plan(q).alias("plan"), asks.split_count(q).cast("long").alias("sharing"), joined(asks.cashtags(q)).alias("tickers"))


TOKENS_SQL = "list_distinct(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: length(x) >= {} AND x NOT IN {}))"
TOPIC_SQL = TOKENS_SQL.format("ask", 4, tuple(wording.TOPIC_STOP))


def thread_sql(column: str) -> str:
    return TOKENS_SQL.format(column, 3, tuple(wording.THREAD_STOP))


LITERAL_SQL = "list_distinct(list_filter(string_split_regex(lower({}), '[^a-z0-9$]+'), lambda x: x <> ''))"
NAMES_SQL = f"""list_filter(list_transform(list_filter(string_split_regex(regexp_replace(ask, '[“”"''’]', ' ', 'g'), '\\s+'), lambda x: x <> ''), lambda x, i: CASE WHEN i = 1 AND lower(regexp_replace(x, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')) IN {tuple(wording.LEADING)} THEN '' ELSE regexp_replace(x, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g') END),
  lambda x: regexp_matches(x, '^(?:[A-Z]{{2,}}|[A-Z][a-zA-Z0-9.-]{{2,}})$'))"""


@query(of_asks(f"""array_to_string({NAMES_SQL}, ' ') AS names, len(list_filter({NAMES_SQL}, lambda x: NOT contains(lower(prior), lower(x)))) > 0 AS breaks,
  NOT ({says(wording.POINTS_BACK, 'trim(ask)')} OR {says(wording.ELLIPTICAL, 'trim(ask)')} OR {says(wording.COST_QUALIFIER, 'trim(ask)')}) AND len({TOPIC_SQL}) > 0
    AND len(list_filter({TOPIC_SQL}, lambda x: contains(lower(prior), regexp_replace(x, '(?:ies|es|s)$', '')))) = 0 AS new_topic,
  len(list_intersect({thread_sql('ask')}, {thread_sql('prior')})) > 0 AS same_thread,
  len(list_filter({LITERAL_SQL.format('ask')}, lambda x: NOT list_contains({LITERAL_SQL.format('prior')}, x))) + len(list_filter({LITERAL_SQL.format('prior')}, lambda x: NOT list_contains({LITERAL_SQL.format('ask')}, x))) <= 1 AS near_literal"""))
def ask_follows(spark: SparkSession, d: str) -> DataFrame:
    q, p = F.col("ask"), F.col("prior")
    return questions(spark, d).select("conv_id", "turn", F.array_join(asks.introduced_names(q), " ").alias("names"), asks.breaks_chain(q, p).alias("breaks"), asks.new_topic(q, p).alias("new_topic"), asks.same_thread(q, p).alias("same_thread"), asks.near_literal(q, p).alias("near_literal"))


@query(f"""WITH {ASKS_SQL}, b AS (SELECT conv_id, turn, row_number() OVER w - 1 AS k, row_number() OVER w > 1 AND len(list_filter({NAMES_SQL}, lambda x: NOT contains(lower(last), lower(x)))) > 0 AS breaks
  FROM (SELECT *, coalesce(lag(ask) OVER (PARTITION BY conv_id ORDER BY turn), '') AS last FROM asks) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, coalesce(max(CASE WHEN breaks THEN k END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 0) AS chain_start FROM b""")
def ask_chain_start(spark: SparkSession, d: str) -> DataFrame:
    """Of each turn, the index of the last one up to it that named something new."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = questions(spark, d).withColumns({"last": F.coalesce(F.lag("ask").over(w), F.lit("")), "k": F.row_number().over(w) - 1})
    breaks = (F.col("k") > 0) & asks.breaks_chain(F.col("ask"), F.col("last"))
    start = F.max(F.when(breaks, F.col("k"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("conv_id", "turn", F.coalesce(start, F.lit(0)).cast("long").alias("chain_start"))


ANCHOR_SQL = f"list_filter(list_transform(string_split_regex(ask, '\\s+'), lambda x: regexp_replace(x, '[^A-Za-z''-]', '', 'g')), lambda x: regexp_matches(x, '^[A-Z][a-z]{{3,}}$') AND lower(x) NOT IN {tuple(wording.AUTHOR_STOP)})"
YEAR_SQL = r"regexp_extract(ask, '\b((?:19|20)\d{2})\b', 1)"
BARE_SQL = "regexp_replace(trim(ask), '[?.!]+$', '')"


@query(of_asks(f"""CASE WHEN {YEAR_SQL} <> '' THEN lower(({ANCHOR_SQL})[1]) END AS author, CASE WHEN len({ANCHOR_SQL}) > 0 THEN TRY_CAST(nullif({YEAR_SQL}, '') AS INTEGER) END AS year,
  CASE WHEN regexp_matches(trim(ask), '^\\p{{L}}[\\p{{L}}''’.-]{{2,29}}$') THEN trim(ask) END AS term,
  CASE WHEN NOT regexp_matches(ask, '{wording.NAMES_PLACE[0]}') AND NOT regexp_matches(trim(ask), '{wording.NAMES_PLACE[1].replace("'", "''")}') AND {any_of(wording.BARE_LOCAL, BARE_SQL)} THEN {BARE_SQL} || ' in Bergen' ELSE ask END AS placed,
  len(regexp_extract_all(ask, '\\p{{L}}')) < 3 OR len(regexp_extract_all(ask, '\\p{{Latin}}')) / len(regexp_extract_all(ask, '\\p{{L}}')) >= 0.8 AS latin"""))
def ask_subjects(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("ask")
    author, year = asks.paper_anchor(q)
    return questions(spark, d).select("conv_id", "turn", author.alias("author"), year.alias("year"), asks.bare_term(q).alias("term"), asks.with_place(q, F.lit("Bergen")).alias("placed"), asks.is_latin(q).alias("latin"))


@query()
def ask_rewrites(spark: SparkSession, d: str) -> DataFrame:
    """Searches made of a question: tickers spelled out, a stray "one" dropped, a site filter, specs, product models and their conflicts."""
    q, p = F.col("ask"), F.col("prior")
    site = F.element_at(F.array(*map(F.lit, SITES)), (1 + F.col("turn") % len(SITES)).cast("int"))
    models = F.array_join(F.transform(asks.model_mentions(q), lambda m: F.concat_ws(" ", m["key"], m["n"])), ",")
    return questions(spark, d).select(
        "conv_id", "turn", asks.expand_cashtags(q).alias("expanded"), asks.without_loose_one(q).alias("without_one"), asks.gap_query(q, site).alias("gap"), F.array_join(asks.ticker_queries(q), "|").alias("ticker_queries"),
        F.array_join(asks.asked_specs(q), ",").alias("specs"), models.alias("models"), asks.model_conflict(q, p).alias("conflict"), asks.covered_by(q, F.lit(""), p).alias("covered"),
    )
