"""Queries that weigh result rows against a question: fusion, gate, named sites, grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomlake.functions.text import host_of
from fathomlake.operators import fusion, gate, grounding, ranking
from fathomlake.plans.catalogue import HOST_SQL, query, table

QUESTIONS = ("cold widgets for promo", "What is the best larg bolt?", "green gizmo vs small gadget brand", "example shops for bolting", "the of a", "therwh erhaan news in en", "Brand 13 widget")
WEIGHTS_SQL = "([1.2::DOUBLE, 1.1::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE, 0.8::DOUBLE])"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def in_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


BARE_SQL = "CASE WHEN length(w) >= 6 THEN regexp_replace(w, '(ing|ed)$', '') ELSE w END"
STEM_SQL = f"regexp_replace(CASE WHEN {BARE_SQL} <> w AND right({BARE_SQL}, 1) = substr({BARE_SQL}, -2, 1) AND regexp_matches({BARE_SQL}, '[b-df-hj-np-tv-z]$') THEN left({BARE_SQL}, -1) ELSE {BARE_SQL} END, '(ies|es|s)$', '')"
STEMS_SQL = f"list_distinct(list_transform(list_filter(string_split_regex(lower(question), '[^a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN {in_list(fusion.QUERY_STOP)}), lambda w: {STEM_SQL}))"
COVER_SQL = "CASE WHEN len(stems) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(stems, lambda s: contains(low, s) OR (length(s) >= 6 AND len(list_filter(long, lambda t: damerau_levenshtein(s, t) = 1)) > 0)))::DOUBLE / len(stems) END"
QUESTION_SQL = f"({sql_list(QUESTIONS)})[1 + {{0}} % {len(QUESTIONS)}]"


def question(k):
    return F.element_at(F.array(*map(F.lit, QUESTIONS)), (1 + k % len(QUESTIONS)).cast("int"))


@query(f"""WITH ranked AS (SELECT l_orderkey // 16 AS list_id, l_suppkey % 5 AS engine, l_partkey AS item, row_number() OVER (PARTITION BY l_orderkey // 16, l_suppkey % 5 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem),
h AS (SELECT list_id, engine, item, min(r) AS rank FROM ranked GROUP BY ALL),
n AS (SELECT h.*, 'https://shop.example/' || item AS key, p_name AS title, repeat(p_type || ' ', CAST(1 + engine % 3 AS INTEGER)) AS snippet FROM h JOIN part ON item = p_partkey),
g AS (SELECT list_id, key, sum({WEIGHTS_SQL}[engine + 1] / (rank + 3)) AS s, count(DISTINCT engine) AS n_engines, arg_max(snippet, (length(snippet), -rank, engine)) AS snippet, arg_min(title, (rank, engine)) AS title, {QUESTION_SQL.format('list_id')} AS question FROM n GROUP BY list_id, key),
t AS (SELECT *, {STEMS_SQL} AS stems, lower(title || ' ' || snippet || ' ' || key) AS low FROM g), l AS (SELECT *, list_distinct(list_filter(string_split_regex(low, '[^a-z0-9]+'), lambda x: length(x) >= 6)) AS long FROM t),
c AS (SELECT *, {COVER_SQL} AS cover FROM l), k AS (SELECT *, round(s * (0.3 + cover), 9) AS score FROM c WHERE cover >= 0.5 OR n_engines > 1)
SELECT list_id, key, title, snippet, n_engines, round(cover, 9) AS cover, score, CAST(row_number() OVER (PARTITION BY list_id ORDER BY score DESC, key) AS INTEGER) AS position FROM k QUALIFY row_number() OVER (PARTITION BY list_id ORDER BY score DESC, key) <= 10""")
def fuse_weighted(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 16).alias("list_id"), (F.col("l_suppkey") % 5).alias("engine"), F.col("l_partkey").alias("item"), "l_extendedprice", "l_orderkey", "l_linenumber")
    w = Window.partitionBy("list_id", "engine").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    hits = lines.withColumn("rank", F.row_number().over(w)).groupBy("list_id", "engine", "item").agg(F.min("rank").alias("rank"))
    hits = hits.withColumn("weight", F.element_at(F.array(*map(F.lit, (1.2, 1.1, 0.5, 1.0, 0.8))), (F.col("engine") + 1).cast("int")))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("title"), "p_type")
    rows = hits.join(parts, "item").withColumns({"key": F.concat(F.lit("https://shop.example/"), "item"), "snippet": F.repeat(F.concat("p_type", F.lit(" ")), (1 + F.col("engine") % 3).cast("int")), "question": question(F.col("list_id"))})
    return fusion.weighted_fusion(rows, "list_id", "key", "question", "title", "snippet", 10)


ASKED_SQL = f"list_filter(string_split_regex(lower(question), '[^a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN {in_list(ranking.SITE_STOP)})"
LABELS_SQL = f"list_filter(string_split_regex(lower(host), '[.-]'), lambda p: length(p) > 2 AND p NOT IN {in_list(ranking.GENERIC_LABELS)})"


@query(f"""WITH r AS (SELECT page_id // 25 AS query_id, page_id, {HOST_SQL} AS host, {QUESTION_SQL.format('(page_id // 25)')} AS question FROM pages), o AS (SELECT *, len(list_intersect({ASKED_SQL}, {LABELS_SQL})) > 0 AS own FROM r),
f AS (SELECT *, own AND row_number() OVER (PARTITION BY query_id, own ORDER BY page_id) <= 3 AS front FROM o),
p AS (SELECT *, CASE WHEN front THEN 0 WHEN own OR row_number() OVER (PARTITION BY query_id, host, front ORDER BY page_id) <= 2 THEN 1 ELSE 2 END AS place FROM f)
SELECT query_id, page_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place, page_id) AS INTEGER) AS new_position FROM p""")
def diversify_named(spark: SparkSession, d: str) -> DataFrame:
    group = F.floor(F.col("page_id") / 25)
    rows = table(spark, d, "pages").select(group.alias("query_id"), "page_id", host_of(F.col("url")).alias("host"), question(group).alias("question"))
    return ranking.diversify_named(rows, "query_id", "question", "host", "page_id").select("query_id", "page_id", "new_position")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus = 'F' AND l_discount > 0.08 AS hard, l_returnflag = 'R' AND NOT (l_linestatus = 'F' AND l_discount > 0.08) AS passes, l_linenumber = 1 AS filler, l_quantity > 10 AS enough, l_discount * 5 AS score FROM lineitem),
c AS (SELECT *, count(*) FILTER (passes) OVER w AS n, count(*) FILTER (NOT passes AND NOT hard AND NOT filler) OVER w AS soft, count(*) FILTER (NOT filler) OVER w AS every FROM r WINDOW w AS (PARTITION BY l_orderkey))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM c WHERE CASE WHEN n > 0 THEN NOT hard AND (passes OR NOT (2 * soft < every)) ELSE NOT hard AND score >= 0.2::DOUBLE AND enough END""")
def gate_choice(spark: SparkSession, d: str) -> DataFrame:
    hard = (F.col("l_linestatus") == "F") & (F.col("l_discount") > 0.08)
    rows = table(spark, d, "lineitem").withColumns({"hard": hard, "passes": (F.col("l_returnflag") == "R") & ~hard, "score": F.col("l_discount") * 5})
    return gate.gate_judged(rows, "l_orderkey", F.col("l_linenumber") == 1, F.col("l_quantity") > 10).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query()
def gate_results(spark: SparkSession, d: str) -> DataFrame:
    """The whole gate over parts as rows of questions; its judgement is checked on literals."""
    group = F.floor(F.col("p_partkey") / 20)
    rows = table(spark, d, "part").select(group.alias("query_id"), "p_partkey", question(group).alias("question"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_brand", "p_type").alias("snippet"), F.concat(F.lit("https://shop.example/"), "p_partkey").alias("url"), F.array(F.lit("a")).alias("engines"))
    return gate.gated(rows, "query_id", "question", "title", "snippet", "url", "engines").select("query_id", "p_partkey", F.round("score", 9).alias("score"), "hits", "passes")


NUMBER_SQL = "list_distinct(list_transform(regexp_extract_all(text, '(\\d[\\d,]*(?:\\.\\d+)?)', 1), lambda n: regexp_replace(replace(n, ',', ''), '\\.0+$', '')))"
NEAR_SQL = "len(list_filter(own, lambda a: len(list_filter(own, lambda b: a <> b AND (abs(a / b - v) <= e OR abs(a * (1 + b / 100) - v) <= e OR abs(a * b / 100 - v) <= e OR abs(a + b - v) <= e OR abs(a - b - v) <= e OR abs(a * b - v) <= e))) > 0)) > 0"


@query(f"""WITH s AS (SELECT l_orderkey, min(l_quantity) AS a, max(l_quantity) AS b, max(l_extendedprice) AS p FROM lineitem GROUP BY 1),
lines AS (SELECT l_orderkey, 'from ' || CAST(CAST(a AS INTEGER) AS VARCHAR) || ' to ' || CAST(CAST(b AS INTEGER) AS VARCHAR) || ' [12], in all ' || CAST(CAST(a + b + l_orderkey % 2 + 100 * (l_orderkey % 3) AS INTEGER) AS VARCHAR) || ' or ' || format('{{:.1f}}', round(b / a, 1)) || ' times, $' || format('{{:.1f}}', round(p, 1)) || ', in 2 steps' AS raw FROM s),
t AS (SELECT l_orderkey, regexp_replace(raw, '\\[\\d+\\]', ' ', 'g') AS text FROM lines), n AS (SELECT l_orderkey, text, unnest({NUMBER_SQL}) AS token FROM t),
e AS (SELECT DISTINCT l_orderkey, unnest([l_quantity, l_extendedprice, round(l_extendedprice, 1), round(CASE WHEN l_extendedprice >= 1000 THEN l_extendedprice END, 0)]) AS value FROM lineitem),
k AS (SELECT n.*, CAST(token AS DOUBLE) AS v, length(regexp_extract(token, '\\.(\\d+)$', 1)) AS places, e.value IS NOT NULL AS stated FROM n LEFT JOIN e ON n.l_orderkey = e.l_orderkey AND CAST(n.token AS DOUBLE) = e.value),
o AS (SELECT *, 0.5 * pow(10.0::DOUBLE, -places) + 1e-9 AS e, coalesce(list(DISTINCT v) FILTER (stated AND v > 0) OVER (PARTITION BY l_orderkey), []) AS own FROM k),
w AS (SELECT *, NOT stated AND v > 2 AS open, NOT stated AND v > 2 AND (places > 0 OR v >= 100 OR regexp_matches(text, token || '\\s*times')) AND {NEAR_SQL} AS worked FROM o)
SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n_tokens, CAST(count(*) FILTER (stated) AS INTEGER) AS n_stated, CAST(count(*) FILTER (worked) AS INTEGER) AS n_derived, count(*) FILTER (open) = count(*) FILTER (worked) AS backed FROM w GROUP BY l_orderkey""")
def ground_derived(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    k = F.col("l_orderkey")
    whole = lambda c: c.cast("int").cast("string")
    sums = li.groupBy("l_orderkey").agg(F.min("l_quantity").alias("a"), F.max("l_quantity").alias("b"), F.max("l_extendedprice").alias("p"))
    a, b = F.col("a"), F.col("b")
    text = F.concat(F.lit("from "), whole(a), F.lit(" to "), whole(b), F.lit(" [12], in all "), whole(a + b + k % 2 + 100 * (k % 3)), F.lit(" or "), F.format_string("%.1f", F.round(b / a, 1)), F.lit(" times, $"), F.format_string("%.1f", F.round("p", 1)), F.lit(", in 2 steps"))
    lines = sums.select("l_orderkey", F.lit(0).alias("line"), text.alias("text"))
    evidence = li.select("l_orderkey", F.explode(F.array(whole(F.col("l_quantity")), F.format_string("%.2f", "l_extendedprice"))).alias("token"))
    return grounding.ground_lines(lines, evidence, "l_orderkey", "line", "text", "token").drop("line")
