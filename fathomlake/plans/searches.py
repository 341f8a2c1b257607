"""Queries over the searches that questions lead to; registered beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomlake.functions import searches as s
from fathomlake.plans.catalogue import query, table

QUESTIONS = (
    "iPhone 17 vs Pixel 10, which is better for gaming?", "Compare the Kobo Clara, Kindle Paperwhite and Boox Page: price", "which is better value: solar vs wind power", "Make a table comparing Roth IRA and 401k for 2026",
    "AJ Dybantsa vs 2026 NBA rookies vs past draft classes", "pros and cons: pros and cons of heat pumps", "Who is Ada Lovelace of London?", "jaylen brown injuries today", "why is $rdw dropping today", "RDW stock price",
    "tell me about the Falcon 9 site:example.org, and energy.gov", "Blueflame AI Blueflame AI at Datasite news", "Phones: Fitbit Edge vs Mi Band 10 specs", "should i lease or buy a Model 3", "What Is It: a? What Is It: a house",
    "Kobo or kobo or Kindle which one should i buy", "how to", "latest news recap", "compare Harbor and Plank side by side", "Mercury",
)
TITLES = (None, "Solar guide energy.gov", "Mercury")
QUESTIONS_SQL = "[" + ", ".join("'" + q.replace("'", "''") + "'" for q in QUESTIONS) + "]"


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Every turn of conversations as a question: a wording of the list alone where the turn is the third, sixth, ... of its thread, else in front of the whole text."""
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (1 + at % len(values)).cast("int"))
    at = F.col("conv_id") * 3 + F.col("turn") * 7
    text = F.when(F.col("turn") % 3 == 2, F.lit("")).otherwise(F.concat(F.lit(" "), F.coalesce("text", F.lit(""))))
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(pick(QUESTIONS, at), text).alias("ask"), pick(TITLES, at).alias("title"))


def _joined(c: Column) -> Column:
    return F.array_join(c, "|")


@query()
def ask_subject_topics(spark: SparkSession, d: str) -> DataFrame:
    """What each question is about and what it asks of that, once its frame is off."""
    rows = questions(spark, d).select("conv_id", "turn", s.peel_frame(F.col("ask")).alias("peeled"), s.subject_of(F.col("ask")).alias("x"))
    return rows.select("conv_id", "turn", "peeled", "x.subject", "x.topic", "x.kind")


@query()
def ask_sanitized(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("conv_id", "turn", s.sanitized(F.col("ask"), F.col("title")).alias("search"))


@query()
def ask_sides(spark: SparkSession, d: str) -> DataFrame:
    """The sides of each comparison, the options it has room for, and a search for each side."""
    rows = questions(spark, d).withColumn("sides", s.compare_sides(F.col("ask")))
    return rows.select("conv_id", "turn", _joined(F.col("sides")).alias("sides"), s.compare_count(F.col("sides")).alias("n"), _joined(s.side_queries(F.col("ask"), F.col("sides"))).alias("searches"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')"


CORE_SQL = f"regexp_replace(w, {_sql(s.END_MARKS)}, '')"
SITE_SQL = f"regexp_matches({CORE_SQL}, '(?i){s.SITE_FILTER}')"
DOMAIN_SQL = f"regexp_matches({CORE_SQL}, '(?i)^{s.DOMAIN}$')"
PLAIN_SQL = f"array_to_string(list_filter({_words('ask')}, lambda w: NOT {SITE_SQL} AND NOT {DOMAIN_SQL}), ' ')"
BARE_SQL = f"""list_filter(list_transform({_words(f"regexp_replace(regexp_replace({PLAIN_SQL}, '[\"''“”‘’()\\[\\]{{}}]', ' ', 'g'), '[^A-Za-z0-9\\s''-]+', ' ', 'g')")}, lambda w: regexp_replace(w, '^[''-]+|[''-]+$', '', 'g')), lambda w: w <> '')"""
ASKED_SQL = f"""regexp_replace(regexp_replace(trim(ask), {_sql(s.QUESTION_LEAD)}, ''), '["''“”‘’()\\[\\]{{}}]', ' ', 'g')"""
LEADS_SQL = f"list_filter(list_transform(list_filter({_words(ASKED_SQL)}, lambda w: NOT {SITE_SQL} AND NOT {DOMAIN_SQL}), lambda w: regexp_replace(w, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')), lambda w: w <> '')"
ITEM_SQL = "replace(p, '?', ' ')"
for _pattern in s.ITEM_FILLER:
    ITEM_SQL = f"regexp_replace({ITEM_SQL}, {_sql(_pattern)}, ' ', 'g')"
ITEM_SQL = f"regexp_replace(trim(regexp_replace({ITEM_SQL}, '\\s+', ' ', 'g')), '^[\\s,:;.-]+|[\\s,:;.-]+$', '', 'g')"
NAMED_SQL = f"len(list_filter({_words('p')}, lambda w: regexp_matches(w, '^[^\\p{{L}}\\p{{N}}]*\\p{{Lu}}|[0-9]'))) > 0"


@query(f"""WITH asks AS (SELECT conv_id, turn, ({QUESTIONS_SQL})[1 + (conv_id * 3 + turn * 7) % {len(QUESTIONS)}] || CASE WHEN turn % 3 = 2 THEN '' ELSE ' ' || coalesce(text, '') END AS ask FROM conversations),
w AS (SELECT *, {BARE_SQL} AS bare, {LEADS_SQL} AS leads, list_distinct(list_transform(regexp_extract_all(ask, '(?:^|[^A-Za-z0-9])\\$([A-Za-z]{{1,5}})(?:[^A-Za-z0-9]|$)', 1), lambda x: upper(x))) AS tags,
  CASE WHEN regexp_matches(ask, '(?i){s.COMPARISON}') THEN list_filter(list_transform(string_split_regex(trim(ask), {_sql(s.SEPARATOR)}), lambda p: {ITEM_SQL}), lambda p: {NAMED_SQL}) ELSE [] END AS items FROM asks),
c AS (SELECT *, bare[1:len(bare) - coalesce(nullif(list_position(list_transform(list_reverse(bare), lambda x: lower(x) NOT IN {tuple(s.TRAILING)}), true), 0) - 1, len(bare))] AS kept, list_transform(items, lambda x: lower(x)) AS low FROM w)
SELECT conv_id, turn, array_to_string(list_filter(items, lambda x, i: list_position(low, lower(x)) = i), '|') AS items,
  CASE WHEN len(tags) > 0 THEN array_to_string(tags, ' ') || ' stock' ELSE array_to_string((CASE WHEN len(list_filter(kept, lambda x: regexp_matches(x, '^[A-Z0-9]'))) > 0 THEN list_filter(kept, lambda x: regexp_matches(x, '^[A-Z0-9]')) ELSE kept END)[1:6], ' ') END AS relaxed,
  array_to_string(leads[1:least(coalesce(nullif(list_position(list_transform(leads, lambda x: NOT regexp_matches(x, '^[A-Z]')), true), 0) - 1, len(leads)), 4)], ' ') AS entity FROM c""")
def ask_items(spark: SparkSession, d: str) -> DataFrame:
    """The items that a question compares, a looser search, and the name that it begins with."""
    q = F.col("ask")
    return questions(spark, d).select("conv_id", "turn", _joined(s.split_entities(q)).alias("items"), s.relaxed(q).alias("relaxed"), s.entity_query(q).alias("entity"))
