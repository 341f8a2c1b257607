"""All queries of the library by name, over the fixture tables, with DuckDB SQL that gives the same rows.

The tables stand in for search data: lineitem for ranked result lists of engines, pages for result rows, events for
asks and product events, conversations for threads, orders for quotes and claims, part for plans and completions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomlake.functions import money, text
from fathomlake.operators import cards, entities, filters, fusion, grounding, joins, ranking, usage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name; without SQL it is checked by unit tests against plain Python."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Result lists: seven lists, five engines with weights, an item's best rank in each.
WEIGHTS = (1.2, 1.1, 0.5, 1.0, 0.8)
HITS_SQL = """
ranked AS (
  SELECT l_orderkey // 800 AS list_id, l_suppkey % 5 AS engine, l_partkey AS item,
    row_number() OVER (PARTITION BY l_orderkey // 800, l_suppkey % 5 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank
  FROM lineitem),
hits AS (
  SELECT list_id, engine, item, CAST(min(rank) AS INTEGER) AS rank,
    CASE engine WHEN 0 THEN 1.2::DOUBLE WHEN 1 THEN 1.1::DOUBLE WHEN 2 THEN 0.5::DOUBLE WHEN 3 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS weight
  FROM ranked GROUP BY list_id, engine, item)"""
FUSED_SQL = "fused AS (SELECT list_id, item, round(sum(weight / (rank + 3)), 9) AS score, count(*) AS n_lists, min(rank) AS best_rank FROM hits GROUP BY list_id, item)"


def result_lists(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 800).alias("list_id"), (F.col("l_suppkey") % 5).alias("engine"), F.col("l_partkey").alias("item"), "l_extendedprice", "l_orderkey", "l_linenumber")
    w = Window.partitionBy("list_id", "engine").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    hits = entities.spread(lines, "list_id").withColumn("rank", F.row_number().over(w)).groupBy("list_id", "engine", "item").agg(F.min("rank").alias("rank"))
    return hits.withColumn("weight", F.array(*map(F.lit, WEIGHTS))[F.col("engine").cast("int")])


@query(f"""WITH {HITS_SQL}, {FUSED_SQL},
branded AS (SELECT list_id, item, p_brand AS brand, score, CAST(row_number() OVER (PARTITION BY list_id ORDER BY score DESC, item) AS INTEGER) AS fused_rank FROM fused JOIN part ON item = p_partkey),
nth AS (SELECT *, row_number() OVER (PARTITION BY list_id, brand ORDER BY fused_rank) > 2 AS tail FROM branded),
placed AS (SELECT list_id, item, brand, score, CAST(row_number() OVER (PARTITION BY list_id ORDER BY tail, fused_rank) AS INTEGER) AS new_position FROM nth)
SELECT * FROM placed WHERE new_position <= 20""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    fused = fusion.reciprocal_rank_fusion(result_lists(spark, d), "list_id", "item")
    brands = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("brand"))
    lines = table(spark, d, "lineitem")
    branded = entities.spread(fused, "item", like=lines).join(entities.spread(brands, "item", like=lines), "item")
    ranked = entities.spread(branded, "list_id", like=lines).withColumn("fused_rank", F.row_number().over(Window.partitionBy("list_id").orderBy(F.desc("score"), "item")))
    placed = ranking.diversify(ranked, "list_id", "brand", "fused_rank", 2)
    return placed.where("new_position <= 20").select("list_id", "item", "brand", "score", "new_position")


@query(f"WITH {HITS_SQL}, {FUSED_SQL} SELECT * FROM fused")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return fusion.reciprocal_rank_fusion(result_lists(spark, d), "list_id", "item")


@query(f"""WITH {HITS_SQL}, named AS (SELECT h.*, p_name || repeat('x', CAST(engine AS INTEGER)) AS snippet FROM hits h JOIN part ON item = p_partkey)
SELECT list_id, item, arg_max(snippet, (length(snippet), -rank, -engine)) AS snippet, string_agg(DISTINCT CAST(engine AS VARCHAR), ',' ORDER BY CAST(engine AS VARCHAR)) AS engines FROM named GROUP BY list_id, item""")
def rrf_best_snippet(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.col("p_partkey").alias("item"), "p_name")
    lines = table(spark, d, "lineitem")
    hits = entities.spread(result_lists(spark, d), "item", like=lines)
    named = hits.join(entities.spread(names, "item", like=lines), "item").withColumn("snippet", F.concat("p_name", F.repeat(F.lit("x"), F.col("engine").cast("int"))))
    return fusion.best_snippet(named, "list_id", "item")


@query(f"""WITH {HITS_SQL}, firsts AS (SELECT list_id, item, min((rank, engine)) AS first_at FROM hits GROUP BY list_id, item)
SELECT list_id, item, first_at[1] AS rank, first_at[2] AS engine, CAST(row_number() OVER (PARTITION BY list_id ORDER BY first_at, item) AS INTEGER) AS position FROM firsts""")
def interleave_lists(spark: SparkSession, d: str) -> DataFrame:
    return fusion.interleave(result_lists(spark, d), "list_id", "engine", "rank", "item").withColumnRenamed("list_no", "engine")


STATUS_SQL = """status AS (
  SELECT user_id, event_type AS engine, CAST(length(event_type) AS INTEGER) * 100 + ascii(event_type) AS preference, count(*) FILTER (value >= 50) AS n_rows, max(value) >= 60 AS ok
  FROM events GROUP BY user_id, event_type)"""


def engine_status(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("engine")).agg(F.count_if(F.col("value") >= 50).alias("n_rows"), (F.max("value") >= 60).alias("ok"))
    return e.withColumn("preference", F.length("engine") * 100 + F.ascii("engine"))


@query(f"WITH {STATUS_SQL} SELECT user_id, arg_min(engine, preference) AS engine, arg_min(n_rows, preference) AS n_rows FROM status WHERE ok AND n_rows > 0 GROUP BY user_id")
def source_failover(spark: SparkSession, d: str) -> DataFrame:
    return fusion.first_working_source(engine_status(spark, d), "user_id")


@query(f"WITH {STATUS_SQL} SELECT user_id, bool_and(NOT ok) AS all_failed, bool_or(NOT ok) AS some_failed, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM status GROUP BY user_id")
def engine_status_flags(spark: SparkSession, d: str) -> DataFrame:
    return fusion.source_flags(engine_status(spark, d), "user_id")


@query("SELECT user_id, count(*) AS n_rows, count(*) FILTER (value >= 95) AS n_strong, count(*) >= 8 AND count(*) FILTER (value >= 95) < 3 AS second_opinion FROM events GROUP BY user_id")
def second_opinion_choice(spark: SparkSession, d: str) -> DataFrame:
    return fusion.needs_second_opinion(table(spark, d, "events"), "user_id", F.col("value") >= 95)


# Result rows: pages, ten queries, position by page_id.
HOST_SQL = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '')"
PATH_SQL = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
SITE_SQL = """CASE WHEN len(string_split(host, '.')) <= 2 THEN host
  WHEN string_split(host, '.')[-2] IN ('co', 'com', 'ac', 'gov', 'org', 'net') AND length(string_split(host, '.')[-1]) = 2 THEN array_to_string(string_split(host, '.')[-3:], '.')
  ELSE array_to_string(string_split(host, '.')[-2:], '.') END"""
ROWS_SQL = f"""cut AS (SELECT page_id, page_id // 25 AS query_id, url, {HOST_SQL} AS host, {PATH_SQL} AS path FROM pages), hit AS (SELECT *, {SITE_SQL} AS site FROM cut)"""


def result_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", F.floor(F.col("page_id") / 25).alias("query_id"), "url", text.host_of(F.col("url")).alias("host"), text.path_of(F.col("url")).alias("path"))
    return rows.withColumn("site", text.site_of(F.col("host")))


@query(f"WITH {ROWS_SQL} SELECT page_id, host, path, site FROM hit")
def host_of(spark: SparkSession, d: str) -> DataFrame:
    return result_rows(spark, d).select("page_id", "host", "path", "site")


@query(f"""WITH {ROWS_SQL}, kept AS (SELECT *, array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: NOT starts_with(lower(p), 'utm_') AND p <> ''), '&') AS q FROM hit)
SELECT page_id, CASE WHEN host = '' THEN url ELSE lower(host || regexp_replace(path, '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END) END AS url_key FROM kept""")
def normalize_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.url_key(F.col("url")).alias("url_key"))


@query(f"""WITH {ROWS_SQL}, nth AS (SELECT *, row_number() OVER (PARTITION BY query_id, site ORDER BY page_id) > 2 AS tail FROM hit)
SELECT query_id, page_id, site, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tail, page_id) AS INTEGER) AS new_position FROM nth""")
def diversify_hosts(spark: SparkSession, d: str) -> DataFrame:
    return ranking.diversify(result_rows(spark, d), "query_id", "site", "page_id", 2).select("query_id", "page_id", "site", "new_position")


@query(f"WITH {ROWS_SQL} SELECT query_id, page_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN site = 'example.org' THEN 0 ELSE 1 END, page_id) AS INTEGER) AS new_position FROM hit")
def named_site_front(spark: SparkSession, d: str) -> DataFrame:
    return ranking.flag_first(result_rows(spark, d), "query_id", F.col("site") == "example.org", "page_id").select("query_id", "page_id", "new_position")


@query(f"""WITH {ROWS_SQL}, seen AS (SELECT *, count(*) FILTER (site = 'example.net') OVER (PARTITION BY query_id ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS n FROM hit)
SELECT query_id, page_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN site = 'example.net' AND n > 2 THEN 1 ELSE 0 END, page_id) AS INTEGER) AS new_position FROM seen""")
def few_encyclopedia(spark: SparkSession, d: str) -> DataFrame:
    return ranking.cap_class(result_rows(spark, d), "query_id", F.col("site") == "example.net", "page_id", 2).select("query_id", "page_id", "new_position")


@query(f"""WITH {ROWS_SQL} SELECT page_id, host FROM hit WHERE NOT (regexp_matches(host, '(^|[.-])(casino|poker|adult)([.-]|$)') OR regexp_matches(path, '(^|/)(casino|poker|adult)(/|$)'))""")
def blocked_hosts(spark: SparkSession, d: str) -> DataFrame:
    return result_rows(spark, d).where(~filters.blocked_host(F.col("host"), F.col("path"), ("casino", "poker", "adult"))).select("page_id", "host")


@query(f"""WITH {ROWS_SQL}, n AS (SELECT *, count(*) FILTER (site = 'example.com') OVER (PARTITION BY query_id) AS k FROM hit) SELECT query_id, page_id, site FROM n WHERE k < 6 OR site = 'example.com'""")
def drop_if_enough(spark: SparkSession, d: str) -> DataFrame:
    return filters.drop_if_enough(result_rows(spark, d), "query_id", F.col("site") == "example.com", 6).select("query_id", "page_id", "site")


@query(f"""WITH {ROWS_SQL}, l AS (SELECT *, host LIKE 'm.%' AS soft FROM hit WHERE site <> 'example.net'),
n AS (SELECT *, count(*) FILTER (soft) OVER (PARTITION BY query_id) AS s, count(*) OVER (PARTITION BY query_id) AS a FROM l) SELECT query_id, page_id FROM n WHERE NOT (soft AND 2 * s < a)""")
def drop_soft_minority(spark: SparkSession, d: str) -> DataFrame:
    return filters.drop_minority(result_rows(spark, d), "query_id", F.col("host").startswith("m."), F.col("site") == "example.net").select("query_id", "page_id")


@query(r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?i)<title[^>]*>([^<]*)', 1), '[ \t\n\r\f\v]+', ' ', 'g')) AS title FROM pages""")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.html_title(F.col("html")).alias("title"))


@query()
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 80 THEN t WHEN contains(substr(t, 1, 81), ' ') THEN regexp_replace(substr(t, 1, 81), ' [^ ]*$', '') ELSE substr(t, 1, 80) END AS cut FROM f""")
def cut_on_word(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.cut_on_word(F.col("text"), 80).alias("cut"))


@query(r"""SELECT conv_id, turn, sha256(lower(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) || '|' || role || '|' || CAST(turn AS VARCHAR) || '|1') AS cache_key FROM conversations""")
def sha256_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.cache_key(F.col("text"), F.col("role"), F.col("turn")).alias("cache_key"))


@query("""SELECT p_partkey, lower(lpad(printf('%x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)), 8, '0')) AS hash FROM part""")
def fnv1a(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.fnv1a(F.col("p_name")).alias("hash"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS a FROM part), v AS (SELECT *, substr(a, 2, 1) || substr(a, 1, 1) || substr(a, 3) AS swapped, substr(a, 2) AS cut FROM w)
SELECT p_partkey, damerau_levenshtein(a, swapped) = 1 AS swap_is_one, damerau_levenshtein(a, cut) = 1 AS cut_is_one, damerau_levenshtein(a, cut || 'zz') = 1 AS far_is_one FROM v""")
def one_edit(spark: SparkSession, d: str) -> DataFrame:
    a = F.split("p_name", " ")[0]
    swapped, cut = F.concat(F.substring(a, 2, 1), F.substring(a, 1, 1), F.substring(a, 3, 1000)), F.substring(a, 2, 1000)
    w = table(spark, d, "part").select("p_partkey", a.alias("a"), swapped.alias("swapped"), cut.alias("cut"))
    one = lambda b: text.within_one_edit(F.col("a"), b)
    return w.select("p_partkey", one(F.col("swapped")).alias("swap_is_one"), one(F.col("cut")).alias("cut_is_one"), one(F.concat("cut", F.lit("zz"))).alias("far_is_one"))


@query(r"""WITH t AS (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '(\d[\d,]*(?:\.\d+)?)', 1), lambda n: regexp_replace(replace(n, ',', ''), '\.0+$', '')))) AS n FROM documents)
SELECT doc_id, array_to_string(n, ' ') AS numbers, CAST(len(n) AS INTEGER) AS n_numbers FROM t""")
def number_tokens(spark: SparkSession, d: str) -> DataFrame:
    n = text.number_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.array_join(n, " ").alias("numbers"), F.size(n).alias("n_numbers"))


@query(r"""WITH t AS (SELECT o_orderkey, o_custkey, [CAST(year(o_orderdate) AS INTEGER)] AS found, [CAST(1995 + o_custkey % 7 AS INTEGER)] AS asked FROM orders)
SELECT o_orderkey, len(list_filter(found, lambda y: abs(y - asked[1]) <= 1)) = 0 AS conflict FROM t""")
def year_conflict(spark: SparkSession, d: str) -> DataFrame:
    found = text.years_in(F.concat(F.lit("ordered in "), F.year("o_orderdate").cast("string")))
    asked = text.years_in(F.concat(F.lit("year "), (1995 + F.col("o_custkey") % 7).cast("string")))
    return table(spark, d, "orders").select("o_orderkey", filters.year_conflict(asked, found).alias("conflict"))


@query(r"""WITH w AS (SELECT p_partkey, list_distinct(list_transform(string_split(lower(p_name), ' '), lambda x: substr(x, 1, 6))) AS asked,
  list_transform(string_split_regex(lower(p_type || ' ' || p_name[1:12]), '[^\p{L}\p{N}]+'), lambda x: substr(x, 1, 6)) AS have FROM part)
SELECT p_partkey, CAST(len(list_intersect(asked, have)) AS DOUBLE) / len(asked) AS coverage FROM w""")
def coverage_share(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", filters.coverage(F.split(F.lower("p_name"), " "), F.concat("p_type", F.lit(" "), F.substring("p_name", 1, 12))).alias("coverage"))


# Money and dates.
@query("SELECT l_orderkey, l_linenumber, floor((l_extendedprice * (1 - l_discount)) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS net FROM lineitem")
def round_cents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", money.round_half_up(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query("""WITH b AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_retailprice * greatest(p_size, 5) ELSE p_retailprice END AS base, p_size % 3 = 0 AS yearly FROM part)
SELECT p_partkey, floor((CASE WHEN yearly THEN base / 12.0::DOUBLE ELSE base END) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS monthly FROM b""")
def monthly_total(spark: SparkSession, d: str) -> DataFrame:
    total = money.monthly_total(F.col("p_retailprice"), F.col("p_size"), F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0, F.lit(5))
    return table(spark, d, "part").select("p_partkey", total.alias("monthly"))


DAILY_SQL = "daily AS (SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY 1)"


def daily_quotes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("price"))


@query(f"""WITH {DAILY_SQL}, y AS (SELECT year(day) AS year, arg_min(price, day) AS base, arg_max(price, day) AS price FROM daily GROUP BY 1)
SELECT CAST(year AS INTEGER) AS year, floor((price - base) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS amount, CASE WHEN base <> 0 THEN floor(((price - base) / base * 100.0::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS pct FROM y""")
def range_change(spark: SparkSession, d: str) -> DataFrame:
    y = daily_quotes(spark, d).groupBy(F.year("day").alias("year")).agg(F.min_by("price", "day").alias("base"), F.max_by("price", "day").alias("price"))
    amount, pct = money.range_change(F.col("price"), F.col("base"))
    return y.select("year", amount.alias("amount"), pct.alias("pct"))


@query(f"""WITH {DAILY_SQL}, n AS (SELECT CAST(year(day) AS INTEGER) AS series, day, price, row_number() OVER (PARTITION BY year(day) ORDER BY day) - 1 AS k, count(*) OVER (PARTITION BY year(day)) AS n FROM daily)
SELECT series, day, price FROM n WHERE n <= 60 OR k = floor(ceil(k / (n / 60.0::DOUBLE)) * (n / 60.0::DOUBLE)) OR k = n - 1""")
def downsample_series(spark: SparkSession, d: str) -> DataFrame:
    return ranking.downsample(daily_quotes(spark, d).withColumn("series", F.year("day")), "series", "day", 60).select("series", "day", "price")


@query("""WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (k = least(n, floor(0.5 * n) + 1)) AS p50, max(value) FILTER (k = least(n, floor(0.9 * n) + 1)) AS p90, max(value) FILTER (k = least(n, floor(0.95 * n) + 1)) AS p95 FROM n GROUP BY event_type""")
def percentile_floor(spark: SparkSession, d: str) -> DataFrame:
    return ranking.nearest_rank(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p90": 0.9, "p95": 0.95})


@query("""SELECT o_orderkey, CAST(year(DATE '2001-03-15') - year(o_orderdate) - CASE WHEN 315 < month(o_orderdate) * 100 + day(o_orderdate) THEN 1 ELSE 0 END AS INTEGER) AS age, strftime(o_orderdate, '%b %Y') AS label FROM orders""")
def completed_age(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", money.completed_years(F.col("o_orderdate"), F.lit("2001-03-15").cast("date")).alias("age"), money.month_label(F.col("o_orderdate")).alias("label"))


@query("""WITH t AS (SELECT event_id, ts, CASE event_type WHEN 'click' THEN 30 WHEN 'view' THEN 300 WHEN 'signup' THEN 10800 ELSE 86400 END AS ttl FROM events)
SELECT event_id, CAST(ttl AS INTEGER) AS ttl, epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(ts) BETWEEN 0 AND ttl::BIGINT * 1000000 AS hit FROM t""")
def ttl_tier(spark: SparkSession, d: str) -> DataFrame:
    tier = F.when(F.col("event_type") == "click", "live").when(F.col("event_type") == "view", "hour").when(F.col("event_type") == "signup", "day")
    e = table(spark, d, "events").select("event_id", "ts", money.ttl_seconds(tier).alias("ttl"))
    age = F.unix_micros(F.lit("2024-01-15 12:00:00").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("event_id", "ttl", age.between(0, F.col("ttl").cast("long") * 1000000).alias("hit"))


# Joins.
@query("""WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS ask_id, user_id, ts AS asked FROM events WHERE event_type = 'view')
SELECT a.event_id, a.user_id, a.ts, arg_max(v.ask_id, (v.asked, v.ask_id)) FILTER (v.asked IS NOT NULL) AS ask_id
FROM a LEFT JOIN v ON a.user_id = v.user_id AND v.asked <= a.ts AND v.asked >= a.ts - INTERVAL 6 HOUR GROUP BY ALL""")
def asof_latest_within(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    a = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    v = e.where("event_type = 'view'").select(F.col("event_id").alias("ask_id"), "user_id", F.col("ts").alias("asked"))
    return joins.latest_within(a, v, ["user_id"], "ts", "asked", "ask_id", 6 * 3600)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)")
def anti_join_new_rows(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.new_rows(table(spark, d, "customer").select("c_custkey", "c_name"), done, ["c_custkey"])


@query("""WITH r AS (SELECT page_id // 25 AS query_id, page_id % 97 AS key, min(page_id) AS position FROM pages WHERE page_id % 2 = 0 GROUP BY 1, 2),
e AS (SELECT page_id // 25 AS query_id, page_id % 97 AS key, min(page_id) AS position FROM pages WHERE page_id % 2 = 1 GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position, key) AS nth FROM e WHERE (query_id, key) NOT IN (SELECT (query_id, key) FROM r)),
l AS (SELECT query_id, max(position) AS last FROM r GROUP BY 1)
SELECT * FROM r UNION ALL SELECT query_id, key, coalesce(last, 0) + nth FROM f LEFT JOIN l USING (query_id) WHERE nth <= 5""")
def supplement_sources(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    side = lambda k: p.where(F.col("page_id") % 2 == k).groupBy(F.floor(F.col("page_id") / 25).alias("query_id"), (F.col("page_id") % 97).alias("key")).agg(F.min("page_id").alias("position"))
    return joins.supplement(side(0), side(1), "query_id", "key", "position", 5)


@query("""WITH o AS (SELECT DISTINCT o_custkey % 50 AS subject, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS name FROM orders)
SELECT a.subject, count(*) AS n_pairs, CASE WHEN count(DISTINCT b.name) = 1 THEN min(b.name) END AS name FROM o a JOIN o b ON a.subject = b.subject AND b.day - INTERVAL 3 YEAR = a.day AND day(a.day) = day(b.day) GROUP BY a.subject""")
def date_offset_pairs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("subject"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("name")).distinct()
    return joins.years_apart(o, "subject", "day", "name", 3)


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate > TIMESTAMP '2000-06-01 00:00:00'")
def session_user_range(spark: SparkSession, d: str) -> DataFrame:
    return joins.live_sessions(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey", "o_orderdate", F.lit("2000-06-01").cast("timestamp_ntz")).select("o_orderkey", "c_name")


@query("""WITH a AS (SELECT l_orderkey AS doc, l_linenumber * 100 AS at FROM lineitem WHERE l_returnflag = 'R'), v AS (SELECT l_orderkey AS doc, l_linenumber * 100 + l_partkey % 90 AS vat, l_quantity AS quantity FROM lineitem WHERE l_returnflag <> 'R')
SELECT a.doc, a.at, arg_min(v.quantity, (v.vat, v.quantity)) AS quantity, min(v.vat) AS value_at FROM a JOIN v ON a.doc = v.doc AND v.vat > a.at AND v.vat - a.at <= 180 GROUP BY a.doc, a.at""")
def proximity_price(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    a = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 100).alias("at"))
    v = li.where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 100 + F.col("l_partkey") % 90).alias("at"), F.col("l_quantity").alias("quantity"))
    return joins.nearest_after(a, v, "doc", "at", "quantity", 180)


# Usage.
def asks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def daily_usage(spark: SparkSession, d: str) -> DataFrame:
    return usage.daily_usage(asks(spark, d), "user_id", "ts")


@query("""WITH c AS (SELECT CAST(ts AS DATE) AS day, user_id % 4 AS provider, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1, 2)
SELECT *, click + "view" + error AS used, (click + "view" + error) * 5 >= 60 * 4 AS alert FROM c""")
def usage_matrix_pivot(spark: SparkSession, d: str) -> DataFrame:
    return usage.usage_matrix(asks(spark, d).withColumn("provider", F.col("user_id") % 4), "provider", "event_type", ["click", "view", "error"], 60, "ts")


@query("""WITH u AS (SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS n FROM events GROUP BY 1, 2)
SELECT day, CASE WHEN user_id % 10 = 3 THEN user_id - user_id % 10 ELSE user_id END AS user_id, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY 1, 2""")
def carry_usage(spark: SparkSession, d: str) -> DataFrame:
    e = asks(spark, d)
    moves = e.select("user_id").distinct().where("user_id % 10 = 3").select(F.col("user_id").alias("from_key"), (F.col("user_id") - F.col("user_id") % 10).alias("to_key"))
    return usage.carry_over(usage.daily_usage(e, "user_id", "ts"), moves, "user_id")


@query("""WITH n AS (SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id % 8 ORDER BY ts, event_id) AS k FROM events) SELECT event_id, k <= 20 AS admitted, CAST(least(k, 20) AS INTEGER) AS counter FROM n""")
def saturating_cap(spark: SparkSession, d: str) -> DataFrame:
    e = asks(spark, d).withColumn("bucket", F.col("user_id") % 8)
    return usage.saturating(e, ["bucket"], "ts", "event_id", 20).select("event_id", "admitted", "counter")


def folded_sql(rule: str, out: str, where: str = "") -> str:
    """A fold over each key's events as a recursive query: (opened, n, value) from the state before and t."""
    return f"""WITH RECURSIVE e AS (SELECT event_id, user_id AS key, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT event_id, key, k, t AS opened, 1 AS n, {out} AS value FROM e WHERE k = 1
  UNION ALL SELECT e.event_id, e.key, e.k, {rule} FROM s JOIN e ON e.key = s.key AND e.k = s.k + 1)
SELECT event_id{'' if where else ', value AS flag'} FROM s {where}"""


def keyed(spark: SparkSession, d: str) -> DataFrame:
    return asks(spark, d).select("event_id", "ts", F.col("user_id").alias("key"))


@query(folded_sql("CASE WHEN e.t - s.opened < 86400 THEN s.opened ELSE e.t END, CASE WHEN e.t - s.opened < 86400 THEN s.n + 1 ELSE 1 END, CASE WHEN e.t - s.opened < 86400 THEN s.n + 1 <= 2 ELSE true END", "true"))
def fixed_window(spark: SparkSession, d: str) -> DataFrame:
    return usage.fixed_window(keyed(spark, d), "key", "ts", "event_id", 2, 86400).select("event_id", F.col("admitted").alias("flag"))


@query(folded_sql("CASE WHEN e.t - s.opened >= 86400 THEN e.t ELSE s.opened END, 0, e.t - s.opened >= 86400", "true", "WHERE value"))
def greedy_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return usage.greedy_spacing(keyed(spark, d), "key", "ts", "event_id", 86400).select("event_id")


@query(folded_sql("CASE WHEN e.t - s.opened < 172800 AND s.n - 1 < 3 THEN s.opened ELSE e.t END, CASE WHEN e.t - s.opened < 172800 AND s.n - 1 < 3 THEN s.n + 1 ELSE 1 END, e.t - s.opened < 172800 AND s.n - 1 < 3", "false"))
def retry_window(spark: SparkSession, d: str) -> DataFrame:
    return usage.free_retries(keyed(spark, d), "key", "ts", "event_id", 172800, 3).select("event_id", F.col("free_retry").alias("flag"))


@query("SELECT event_id, sum(user_id) OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM events")
def budget_running(spark: SparkSession, d: str) -> DataFrame:
    return usage.running_budget(asks(spark, d), "ts", "event_id", "user_id", ["event_type"]).select("event_id", "spent")


@query()
def budget_admit(spark: SparkSession, d: str) -> DataFrame:
    return usage.admitted_spend(asks(spark, d).select("event_id", "ts", "event_type", "value"), "event_type", "ts", "event_id", "value", 1000.0).select("event_id", "admitted")


@query("""WITH f AS (SELECT user_id, event_type, min(ts) AS first_at FROM events GROUP BY 1, 2) SELECT user_id, event_type, CAST((epoch_us(first_at) - min(epoch_us(first_at)) OVER (PARTITION BY user_id)) // 1000 AS BIGINT) AS ms FROM f""")
def stage_marks(spark: SparkSession, d: str) -> DataFrame:
    return usage.first_marks(asks(spark, d), "user_id", "event_type", "ts")


# Grounding: orders state totals, lineitem has the amounts.
@query("""WITH e AS (SELECT DISTINCT l_orderkey % 1000 AS scope, CAST(l_quantity AS INTEGER) AS token FROM lineitem), c AS (SELECT o_orderkey AS claim, o_orderkey % 1000 AS scope, CAST(o_custkey % 60 AS INTEGER) AS token FROM orders)
SELECT scope, claim, token FROM c ANTI JOIN e USING (scope, token)""")
def ground_tokens(spark: SparkSession, d: str) -> DataFrame:
    claims, evidence = stated(spark, d)
    return grounding.unsupported(claims, evidence, "scope", "token").select("scope", "claim", "token")


def stated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim"), (F.col("o_orderkey") % 1000).alias("scope"), (F.col("o_custkey") % 60).cast("int").alias("token"))
    evidence = table(spark, d, "lineitem").select((F.col("l_orderkey") % 1000).alias("scope"), F.col("l_suppkey").alias("source"), F.col("l_quantity").cast("int").alias("token"))
    return claims, evidence


@query("""WITH c AS (SELECT DISTINCT o_orderkey % 1000 AS scope, o_orderpriority AS claim, CAST(o_custkey % 60 AS INTEGER) AS token FROM orders), e AS (SELECT DISTINCT l_orderkey % 1000 AS scope, CAST(l_quantity AS INTEGER) AS token, 1 AS has FROM lineitem)
SELECT scope, claim, count(*) AS n_tokens, count(has) AS n_backed, bool_and(has IS NOT NULL) AS backed FROM c LEFT JOIN e USING (scope, token) GROUP BY 1, 2""")
def evidence_left_join(spark: SparkSession, d: str) -> DataFrame:
    _, evidence = stated(spark, d)
    claims = table(spark, d, "orders").select(F.col("o_orderpriority").alias("claim"), (F.col("o_orderkey") % 1000).alias("scope"), (F.col("o_custkey") % 60).cast("int").alias("token"))
    return grounding.support(claims, evidence, "scope", "claim", "token")


@query("""WITH p AS (SELECT l_orderkey AS o_orderkey, sum(l_extendedprice * (1 + l_tax) * (1 - l_discount)) AS s FROM lineitem GROUP BY 1) SELECT o_orderkey, o_totalprice, coalesce(abs(o_totalprice - s) <= 50000, false) AS backed FROM orders LEFT JOIN p USING (o_orderkey)""")
def derived_backing(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_extendedprice") * (1 + F.col("l_tax")) * (1 - F.col("l_discount"))).alias("part"))
    return grounding.sum_backed(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), parts, "o_orderkey", "o_totalprice", "part", 50000.0)


@query("""WITH c AS (SELECT DISTINCT o_orderkey % 1000 AS scope, o_orderpriority AS claim, CAST(o_custkey % 60 AS INTEGER) AS token, 3::BIGINT AS preferred FROM orders), e AS (SELECT DISTINCT l_orderkey % 1000 AS scope, l_suppkey AS source, CAST(l_quantity AS INTEGER) AS token FROM lineitem),
n AS (SELECT scope, claim, preferred, source, count(*) AS n_shared FROM c JOIN e USING (scope, token) GROUP BY ALL)
SELECT scope, claim, source, n_shared FROM n QUALIFY row_number() OVER (PARTITION BY scope, claim ORDER BY n_shared DESC, CASE WHEN source = preferred THEN 0 ELSE 1 END, source) = 1""")
def retarget_cites(spark: SparkSession, d: str) -> DataFrame:
    _, evidence = stated(spark, d)
    claims = table(spark, d, "orders").select(F.col("o_orderpriority").alias("claim"), (F.col("o_orderkey") % 1000).alias("scope"), (F.col("o_custkey") % 60).cast("int").alias("token"), F.lit(3).cast("long").alias("preferred"))
    return grounding.best_citation(claims, evidence, "scope", "claim", "source", "token", "preferred")


@query(r"""WITH q AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark), t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents)
SELECT item_id, doc_id FROM q JOIN t ON contains(' ' || array_to_string(t.w, ' ') || ' ', ' ' || array_to_string(q.w, ' ') || ' ') WHERE len(q.w) > 0""")
def verbatim_quotes(spark: SparkSession, d: str) -> DataFrame:
    return grounding.verbatim(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "text", "doc_id", "text")


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_values, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS o_orderpriority FROM orders GROUP BY o_custkey")
def distinct_or_abstain(spark: SparkSession, d: str) -> DataFrame:
    return grounding.one_value_or_none(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("""WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, length(o_orderpriority), o_orderpriority) = 1""")
def mode_by_group(spark: SparkSession, d: str) -> DataFrame:
    return grounding.mode(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


# Cards: a user's events are node updates, the type is the slot.
@query("""WITH l AS (SELECT user_id, event_type, arg_max(props, event_id) AS props, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, event_type, props, CAST(row_number() OVER (PARTITION BY user_id ORDER BY f, event_type) AS INTEGER) AS shown FROM l""")
def last_node_per_slot(spark: SparkSession, d: str) -> DataFrame:
    return cards.last_per_slot(table(spark, d, "events").select("user_id", "event_type", "event_id", "props"), "user_id", "event_type", "event_id", "props")


@query("""WITH l AS (SELECT event_id, user_id % 3 AS node, lag(user_id % 3) OVER (PARTITION BY event_type ORDER BY event_id) AS b FROM events) SELECT event_id, node FROM l WHERE b IS NULL OR node <> b""")
def unchanged_suppress(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type", F.lit(0).alias("card"), (F.col("user_id") % 3).alias("node"))
    return cards.changed_only(e, "card", "event_type", "event_id", "node").select("event_id", "node")


@query("""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents), o AS (SELECT *, doc_id * 100000 + k AS position FROM l WHERE line <> '')
SELECT source, doc_id, CAST(k AS INTEGER) AS line_no, line FROM o QUALIFY row_number() OVER (PARTITION BY source, line ORDER BY position) = 1""")
def first_seen_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("k", "line")).where("line <> ''")
    placed = lines.withColumn("line_no", F.col("k") + 1).withColumn("position", F.col("doc_id") * 100000 + F.col("line_no"))
    return cards.first_seen(placed, "source", "line", "position").select("source", "doc_id", "line_no", "line")


# Entities: customers sharing a supplier-like signal in a nation.
SIGNALS_SQL = "signals AS (SELECT c_nationkey AS scope, c_custkey AS r, CASE WHEN c_custkey % 3 = 0 THEN 'a' || (c_custkey % 60) ELSE 'b' || (c_custkey // 40) END AS signal FROM customer)"


def signals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    signal = F.when(k % 3 == 0, F.concat(F.lit("a"), k % 60)).otherwise(F.concat(F.lit("b"), F.floor(k / 40)))
    both = table(spark, d, "customer").select(F.col("c_nationkey").alias("scope"), k.alias("row"), signal.alias("signal"))
    return both.unionByName(table(spark, d, "customer").where("c_custkey % 7 = 0").select(F.col("c_nationkey").alias("scope"), F.col("c_custkey").alias("row"), F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 100)).alias("signal")))


@query(f"""WITH RECURSIVE {SIGNALS_SQL}, s AS (SELECT * FROM signals UNION ALL SELECT c_nationkey, c_custkey, 'c' || (c_custkey // 100) FROM customer WHERE c_custkey % 7 = 0),
e AS (SELECT DISTINCT a.scope, a.r AS a, b.r AS b FROM s a JOIN s b ON a.scope = b.scope AND a.signal = b.signal),
reach(scope, a, b) AS (SELECT scope, a, b FROM e UNION SELECT e.scope, reach.a, e.b FROM reach JOIN e ON reach.scope = e.scope AND reach.b = e.a)
SELECT scope, a AS row, min(b) AS cluster FROM reach GROUP BY scope, a""")
def cluster_components(spark: SparkSession, d: str) -> DataFrame:
    return entities.clusters(signals(spark, d), "scope", "row", "signal")


@query("""WITH m AS (SELECT c_nationkey AS scope, c_mktsegment AS cluster, round(sum(abs(c_acctbal)), 6) AS weight, count(*) AS n_rows FROM customer GROUP BY 1, 2),
r AS (SELECT *, max(weight) OVER (PARTITION BY scope) AS top, CAST(row_number() OVER (PARTITION BY scope ORDER BY weight DESC, cluster) AS INTEGER) AS nth FROM m) SELECT scope, cluster, round(weight, 2) AS weight, n_rows, nth FROM r WHERE weight >= 0.5 * top AND nth <= 5""")
def weighted_choice(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("scope"), F.col("c_mktsegment").alias("cluster"), F.abs("c_acctbal").alias("w"))
    return entities.leading_choices(c, "scope", "cluster", "w").withColumn("weight", F.round("weight", 2))


def long_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_size").alias("scope"), F.col("p_partkey").alias("position"), F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " plus").otherwise("")).alias("name"))


@query(r"""WITH n AS (SELECT p_size AS scope, p_partkey AS position, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' plus' ELSE '' END AS name FROM part), w AS (SELECT *, list_distinct(string_split_regex(lower(name), '[^\p{L}\p{N}]+')) AS w FROM n)
SELECT scope, position, name FROM w a WHERE NOT EXISTS (SELECT 1 FROM w b WHERE a.scope = b.scope AND len(b.w) > len(a.w) AND list_has_all(b.w, a.w))""")
def word_subset_drop(spark: SparkSession, d: str) -> DataFrame:
    return entities.drop_covered(long_names(spark, d), "scope", "name", "position").select("scope", "position", "name")


@query()
def word_subset_drop_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same rows, compared with plain Python in the tests."""
    return entities.drop_covered(long_names(spark, d), "scope", "name", "position").select("scope", "position", "name")


# Personal: completions and histories.
PREFIXES = ("a", "co", "par", "1", "green")


@query(f"""WITH p AS (SELECT unnest({list(PREFIXES)!r}) AS prefix), t AS (SELECT prefix, p_name, p_partkey, CASE WHEN starts_with(lower(p_name), prefix) THEN 0 WHEN contains(lower(p_name), ' ' || prefix) THEN 1 WHEN contains(lower(p_name), prefix) THEN 2 END AS tier FROM p, part)
SELECT prefix, p_name, CAST(tier AS INTEGER) AS tier, CAST(row_number() OVER (PARTITION BY prefix ORDER BY tier, p_partkey) AS INTEGER) AS rank_in_query FROM t WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY tier, p_partkey) <= 6""")
def typeahead_tiers(spark: SparkSession, d: str) -> DataFrame:
    typed = spark.createDataFrame([(p,) for p in PREFIXES], "prefix string")
    return ranking.prefix_tiers(table(spark, d, "part").select("p_name", "p_partkey"), typed, "p_name", "p_partkey", 6)


@query("""WITH f AS (SELECT conv_id, lower(trim(role)) AS k, arg_max(role, (turn, turn)) AS role, max(turn) AS turn FROM conversations GROUP BY 1, 2)
SELECT conv_id, role, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS position FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2""")
def list_history(spark: SparkSession, d: str) -> DataFrame:
    return ranking.move_to_front(table(spark, d, "conversations").select("conv_id", "role", "turn", F.col("turn").alias("tie")), "conv_id", "role", "turn", "tie", 2)


@query("""SELECT user_id, event_id, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank_in_query FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-20 00:00:00', 5000) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 11""")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return ranking.keyset_page(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", ("2024-01-20 00:00:00", 5000), 10)


@query("SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank_in_query FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_k(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", 3, F.desc("o_totalprice"), "o_orderkey")


@query("""WITH r AS (SELECT page_id, page_id // 25 AS query_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(page_id % 60 AS INTEGER) END AS date FROM pages), n AS (SELECT *, count(*) FILTER (date >= DATE '2024-02-01') OVER (PARTITION BY query_id) >= 3 AS enough FROM r)
SELECT query_id, page_id, date, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN enough AND date IS NULL THEN 1 ELSE 0 END, page_id) AS INTEGER) AS new_position FROM n WHERE NOT enough OR date IS NULL OR date >= DATE '2024-02-01'""")
def prefer_fresh(spark: SparkSession, d: str) -> DataFrame:
    date = F.when(F.col("page_id") % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 60).cast("int")))
    rows = table(spark, d, "pages").select("page_id", F.floor(F.col("page_id") / 25).alias("query_id"), date.alias("date"))
    return filters.prefer_fresh(rows, "query_id", "date", F.lit("2024-02-01").cast("date"), "page_id").select("query_id", "page_id", "date", "new_position")


@query()
def answer_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.answer_key(F.col("text")).alias("answer_key"))
