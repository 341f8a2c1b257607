"""Queries over passages, figures, comparisons and histories; registered beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomlake.functions import money, text
from fathomlake.operators import cards, entities, figures, fusion, passages, personal, ranking
from fathomlake.plans.catalogue import HITS_SQL, asks, query, result_lists, table
from fathomlake.sources import feeds

FLAT = r"trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))"
SENTENCES_SQL = f"""cut AS (SELECT doc_id, string_split(regexp_replace({FLAT}, '([.!?]) +', '\\1' || chr(10), 'g'), chr(10)) AS s FROM documents),
sentences AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM cut)"""


@query(f"""WITH {SENTENCES_SQL}, f AS (SELECT doc_id, min(pos) AS pos, arg_min(sentence, pos) AS sentence FROM sentences WHERE length(sentence) BETWEEN 35 AND 260 GROUP BY doc_id, lower(substr(sentence, 1, 60)))
SELECT doc_id, CAST(pos AS INTEGER) AS pos, sentence FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 40""")
def candidates(spark: SparkSession, d: str) -> DataFrame:
    return passages.candidates(table(spark, d, "documents"), "doc_id", "text")


ASKED = ["edthe", "thorer", "tion", "achlic", "limit"]
LINES_SQL = f"""{SENTENCES_SQL}, lines AS (SELECT doc_id // 50 AS query_id, doc_id, pos, sentence, CASE WHEN len(list_filter({ASKED!r}, lambda s: contains(lower(sentence), s))) = 0 THEN 0.0::DOUBLE ELSE len(list_filter({ASKED!r}, lambda s: contains(lower(sentence), s)))
  + CASE WHEN regexp_matches(sentence, '{passages.FIGURE}') THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN regexp_matches(sentence, '{passages.RULE_EDGE}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS score FROM sentences)"""


def scored_lines(spark: SparkSession, d: str) -> DataFrame:
    asked = F.array(*map(F.lit, ASKED))
    rows = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 50).alias("query_id"), "doc_id", F.posexplode(passages.sentence_array(F.col("text"))).alias("pos", "sentence"))
    return rows.withColumn("asked", asked)


@query(f"""WITH {LINES_SQL}, a AS (SELECT * FROM lines WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id, lower(substr(sentence, 1, 80)) ORDER BY score DESC, doc_id, pos) = 1),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, doc_id, pos) <= 2)
SELECT query_id, doc_id, CAST(pos AS INTEGER) AS pos, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, pos) AS INTEGER) AS nth FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, pos) <= 5""")
def key_lines(spark: SparkSession, d: str) -> DataFrame:
    return passages.key_lines(scored_lines(spark, d), "query_id", "doc_id", "pos", "sentence", "asked").select("query_id", "doc_id", "pos", "score", "nth")


@query(f"""WITH {LINES_SQL}, b AS (SELECT *, greatest(score, coalesce(lag(score) OVER w, 0) - 0.5::DOUBLE, coalesce(lead(score) OVER w, 0) - 0.5::DOUBLE) AS best FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
u AS (SELECT *, sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY best DESC, pos ROWS UNBOUNDED PRECEDING) AS used FROM b WHERE best > 0) SELECT doc_id, CAST(pos AS INTEGER) AS pos FROM u WHERE used <= 600""")
def relevant_passages(spark: SparkSession, d: str) -> DataFrame:
    rows = scored_lines(spark, d).withColumn("score", passages.line_score(F.col("sentence"), F.col("asked")))
    return passages.with_neighbours(rows, "doc_id", "pos", "sentence", "score", 600).select("doc_id", "pos")


def sql_list(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(rf"""WITH documents AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN repeat('漢字かなカナ한글', CAST(1 + doc_id % 50 AS INTEGER)) ELSE '' END AS text FROM documents), w AS (SELECT doc_id, string_split_regex(lower(text), '[^\p{{L}}]+') AS w FROM documents), n AS (SELECT doc_id, len(list_filter(w, lambda x: x IN {sql_list(passages.ROMANCE)})) AS r, len(list_filter(w, lambda x: x IN {sql_list(passages.ENGLISH)})) AS e FROM w),
c AS (SELECT doc_id, len(regexp_extract_all(text, '\p{{L}}')) AS letters, len(regexp_extract_all(text, '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Hangul}}]')) AS cjk FROM documents)
SELECT doc_id, CASE WHEN letters > 0 THEN cjk::DOUBLE / letters ELSE 0.0::DOUBLE END AS cjk_share, r >= 4 AND r > e AS romance_heavy FROM n JOIN c USING (doc_id)""")
def language_share(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    mixed = F.concat("text", F.when(k % 3 == 0, F.repeat(F.lit("漢字かなカナ한글"), (1 + k % 50).cast("int"))).otherwise(""))
    cjk, romance = passages.language_flags(F.col("text"))
    return table(spark, d, "documents").withColumn("text", mixed).select("doc_id", cjk.alias("cjk_share"), romance.alias("romance_heavy"))


@query(f"""WITH {HITS_SQL}, f AS (SELECT list_id, item, min((rank, engine)) AS first_at, string_agg(CAST(engine AS VARCHAR), ',' ORDER BY engine) AS engines FROM hits GROUP BY list_id, item)
SELECT list_id, item, engines, CAST(row_number() OVER (PARTITION BY list_id ORDER BY first_at, item) AS INTEGER) AS position FROM f""")
def merge_lists_engines(spark: SparkSession, d: str) -> DataFrame:
    hits = result_lists(spark, d)
    engines = F.array_join(F.array_sort(F.collect_set(F.col("engine").cast("string"))), ",").alias("engines")
    return fusion.interleave(hits, "list_id", "engine", "rank", "item", (engines,)).select("list_id", "item", "engines", "position")


@query("""WITH p(engine, price) AS (VALUES (0, 0.001::DOUBLE), (1, 0.005::DOUBLE), (2, 0.0025::DOUBLE)), c AS (SELECT l_orderkey % 100 AS key, l_suppkey % 5 AS engine, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT key, CAST(sum(n) AS BIGINT) AS calls, round(sum(n * coalesce(price, 0)), 6) AS cost FROM c LEFT JOIN p USING (engine) GROUP BY key""")
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.createDataFrame([(0, 0.001), (1, 0.005), (2, 0.0025)], "engine long, price double")
    calls = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("key"), (F.col("l_suppkey") % 5).alias("engine")).agg(F.count("*").alias("n"))
    return figures.estimated_cost(calls, prices, "key", "engine", "n", "price")


@query("""SELECT DISTINCT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN (SELECT o_orderkey, unnest([1 + o_custkey % 7, 1 + o_orderkey % 4]) AS n FROM orders) c ON l.l_orderkey = c.o_orderkey AND l.l_linenumber = c.n""")
def semi_join_cited(spark: SparkSession, d: str) -> DataFrame:
    answer = F.concat(F.lit("so it is ["), 1 + F.col("o_custkey") % 7, F.lit("] and ["), 1 + F.col("o_orderkey") % 4, F.lit("]."))
    numbers = passages.cited(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), answer.alias("answer")), "l_orderkey", "answer").withColumnRenamed("n", "l_linenumber")
    return table(spark, d, "lineitem").join(numbers, ["l_orderkey", "l_linenumber"], "left_semi").select("l_orderkey", "l_linenumber").distinct()


FIGURES_SQL = "figures AS (SELECT o_custkey AS key, unnest(['money', 'percent', 'clock']) AS unit, unnest([o_totalprice, CAST(o_orderkey % 40 AS DOUBLE), (o_orderkey % 24) * 60.0::DOUBLE + o_custkey % 60]) AS amount, o_orderkey FROM orders)"


def order_figures(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    clock = F.concat((k % 24).cast("string"), F.lit(":"), F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0"))
    sentence = F.concat(F.lit("Order total $"), F.format_string("%.2f", "o_totalprice"), F.lit(", with "), (k % 40).cast("string"), F.lit("% off, at "), clock, F.lit("."))
    texts = table(spark, d, "orders").select(F.struct("o_custkey", "o_orderkey").alias("k"), sentence.alias("text"))
    flat = texts.select(F.concat_ws(":", F.col("k.o_custkey").cast("string"), F.col("k.o_orderkey").cast("string")).alias("key"), "text")
    found = figures.read_figures(flat, "key", "text")
    return found.withColumns({"order": F.split("key", ":")[1].cast("long"), "key": F.split("key", ":")[0].cast("long")})


@query(f"WITH {FIGURES_SQL} SELECT o_orderkey AS \"order\", unit, round(amount, 2) AS amount FROM figures")
def read_figures(spark: SparkSession, d: str) -> DataFrame:
    return order_figures(spark, d).select("order", "unit", F.round("amount", 2).alias("amount"))


@query(f"WITH {FIGURES_SQL} SELECT key, unit, count(*) AS n, round(sum(round(amount, 2)), 2) AS total, round(max(round(amount, 2)) - min(round(amount, 2)), 2) AS spread FROM figures GROUP BY 1, 2")
def combine_figures(spark: SparkSession, d: str) -> DataFrame:
    c = figures.combined(order_figures(spark, d), "key", "unit", "amount")
    return c.select("key", "unit", "n", F.round("total", 2).alias("total"), F.round("spread", 2).alias("spread"))


@query("""WITH c AS (SELECT l_returnflag || l_linestatus AS unit, l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2) SELECT key, unit, n FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, unit) = 1""")
def group_by_measure(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.concat("l_returnflag", "l_linestatus").alias("unit"))
    return figures.largest_measure(li, "key", "unit")


@query("""WITH f AS (SELECT o_orderkey // 40 AS key, o_custkey % 30 + (o_orderkey % 7) * 0.0004::DOUBLE AS amount, o_orderkey AS first FROM orders),
l AS (SELECT key, list([struct_pack(first := first, amount := amount)] ORDER BY first) AS l FROM f GROUP BY key),
k AS (SELECT key, unnest(list_reduce(l, lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: abs(y.amount - x[1].amount) <= 0.001)) > 0 THEN kept ELSE list_concat(kept, x) END)) AS x FROM l)
SELECT key, x.amount AS amount, x.first AS first FROM k""")
def figure_dedupe(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 40).alias("key"), F.lit("x").alias("unit"), (F.col("o_custkey") % 30 + (F.col("o_orderkey") % 7) * 0.0004).alias("amount"), F.col("o_orderkey").alias("first"))
    return figures.first_distinct(f, "key", "unit", "amount", "first").select("key", "amount", "first")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN l_quantity > 25 THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN l_discount < 0.05 THEN 1.5::DOUBLE ELSE 0 END AS score FROM lineitem)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) = 1""")
def scored_pick(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("official"), (F.col("l_quantity") > 25).alias("combined"), (F.col("l_discount") < 0.05).alias("place"))
    return figures.pick_scored(c, "l_orderkey", {"official": 3.0, "combined": 2.0, "place": 1.5}, "l_linenumber").select("l_orderkey", "l_linenumber", "score")


@query("""SELECT o_orderpriority, round(avg(o_totalprice) FILTER (r_name = 'ASIA'), 2) AS "ASIA", round(avg(o_totalprice) FILTER (r_name = 'EUROPE'), 2) AS "EUROPE" FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY o_orderpriority""")
def compare_pivot(spark: SparkSession, d: str) -> DataFrame:
    sides = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(sides, "c_nationkey")
    return figures.compared(rows, "r_name", ["ASIA", "EUROPE"], "o_orderpriority", "o_totalprice")


@query("""SELECT conv_id, bool_or(regexp_matches(lower(text), '\\b(no|not|never)\\b')) AS denial, bool_or(regexp_matches(text, '\\d')) AS figure, bool_and(length(text) < 400) AS brief FROM conversations GROUP BY conv_id""")
def verdict_flags(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.bool_or(low.rlike(text.word_bounds("\\b(no|not|never)\\b"))).alias("denial"), F.bool_or(F.col("text").rlike("\\d")).alias("figure"), F.bool_and(F.length("text") < 400).alias("brief"))


@query("SELECT conv_id, sha256(string_agg(role || ':' || sha256(text), '|' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def card_digest(spark: SparkSession, d: str) -> DataFrame:
    node = F.struct("turn", F.concat("role", F.lit(":"), F.sha2("text", 256)).alias("node"))
    ordered = F.transform(F.array_sort(F.collect_list(node)), lambda n: n["node"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(ordered, "|"), 256).alias("digest"))


@query("""WITH w AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS web FROM events WHERE event_type = 'view' GROUP BY 1, 2) SELECT event_id FROM events e JOIN w ON e.user_id = w.user_id AND CAST(e.ts AS DATE) = w.day WHERE e.event_type = 'click' AND e.ts <= w.web + INTERVAL 2 HOUR""")
def late_grace(spark: SparkSession, d: str) -> DataFrame:
    e = asks(spark, d).withColumn("day", F.to_date("ts"))
    web = e.where("event_type = 'view'").groupBy("user_id", "day").agg(F.min("ts").alias("web"))
    return e.where("event_type = 'click'").join(web, ["user_id", "day"]).where(F.col("ts") <= F.col("web") + F.expr("INTERVAL 2 HOURS")).select("event_id")


@query("""WITH n AS (SELECT user_id, event_type, max((ts, event_id)) AS m FROM events GROUP BY 1, 2) SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY m DESC) AS INTEGER) AS position FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY m DESC) <= 3""")
def recent_subjects(spark: SparkSession, d: str) -> DataFrame:
    return personal.recent_subjects(asks(spark, d), "user_id", "event_type", "ts", "event_id", 3)


STARTERS = (("click", 1), ("view", 2), ("purchase", 3), ("error", 4), ("signup", 5), ("other", 6))


@query(f"""WITH s(event_type, position) AS (VALUES {', '.join(map(str, STARTERS))}), n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), u AS (SELECT DISTINCT user_id FROM events)
SELECT u.user_id, s.event_type, CAST(position AS INTEGER) AS position, coalesce(n, 0) AS asked, CAST(row_number() OVER (PARTITION BY u.user_id ORDER BY coalesce(n, 0) DESC, position) AS INTEGER) AS rank FROM u CROSS JOIN s LEFT JOIN n ON n.user_id = u.user_id AND n.event_type = s.event_type""")
def category_rank(spark: SparkSession, d: str) -> DataFrame:
    starters = spark.createDataFrame(list(STARTERS), "event_type string, position int")
    return personal.by_frequency(starters, table(spark, d, "events"), "user_id", "event_type", "position").select("user_id", "event_type", "position", "asked", "rank")


@query("""WITH h AS (SELECT o_custkey % 100 AS owner, o_orderpriority AS text, min(o_orderkey) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), w AS (SELECT o_custkey % 100 AS owner, o_orderpriority AS text, min(o_orderkey) AS p FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2),
a AS (SELECT owner, text, 0 AS source, row_number() OVER (PARTITION BY owner ORDER BY p) AS pos FROM h QUALIFY row_number() OVER (PARTITION BY owner ORDER BY p) <= 3 UNION ALL SELECT owner, text, 1, row_number() OVER (PARTITION BY owner ORDER BY p) FROM w),
f AS (SELECT owner, arg_min(text, (source, pos)) AS text, min((source, pos)) AS m FROM a GROUP BY owner, lower(text)) SELECT owner, text, CAST(m[1] AS INTEGER) AS source, CAST(row_number() OVER (PARTITION BY owner ORDER BY m) AS INTEGER) AS position FROM f QUALIFY row_number() OVER (PARTITION BY owner ORDER BY m) <= 4""")
def merge_suggestions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("owner", F.col("o_custkey") % 100)
    side = lambda rows: rows.groupBy("owner", F.col("o_orderpriority").alias("text")).agg(F.min("o_orderkey").alias("p"))
    return personal.merged_suggestions([(side(o.where("o_orderstatus = 'F'")), 3), (side(o.where("o_orderstatus <> 'F'")), None)], "owner", "text", "p", 4)


@query("""WITH n AS (SELECT c_nationkey AS owner, c_mktsegment AS lane, c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS round FROM customer)
SELECT owner, lane, c_custkey, CAST(round AS INTEGER) AS round, CAST(row_number() OVER (PARTITION BY owner ORDER BY round, lane) AS INTEGER) AS place FROM n QUALIFY row_number() OVER (PARTITION BY owner ORDER BY round, lane) <= 8""")
def idea_lanes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("owner"), F.col("c_mktsegment").alias("lane"), "c_custkey")
    return personal.lanes(c, "owner", "lane", "c_custkey", 8)


@query("""WITH r AS (SELECT o_orderkey, o_custkey AS image, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) SELECT o_orderkey, image FROM r WHERE k = 1""")
def image_once(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("image"))
    return ranking.top_k(o, "image", 1, "o_orderkey").select("o_orderkey", "image")


# Landed payloads, composed from the tables so that what the parsers have to find is known.
def part_lists(spark: SparkSession, d: str) -> DataFrame:
    """(list_id, rows): twenty parts each, so that a body stays small however long the table is."""
    rows = F.array_sort(F.collect_list(F.struct("p_partkey", "p_name")))
    return table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 20).alias("list_id")).agg(rows.alias("rows"))


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq, role AS event, CAST(turn AS VARCHAR) AS data FROM conversations")
def source_sse(spark: SparkSession, d: str) -> DataFrame:
    frame = F.struct("turn", F.concat(F.lit("event: "), "role", F.lit("\r\ndata: "), F.col("turn").cast("string"), F.lit("\r\n\r\n")).alias("frame"))
    streams = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(frame)), lambda f: f["frame"]), "").alias("body"))
    return feeds.sse_frames(streams.withColumn("body", F.concat("body", F.lit("event: cut"))), "conv_id", "body")


@query("""WITH f AS (SELECT p_partkey // 20 AS list_id, p_name AS suggestion, min(p_partkey) AS k FROM part GROUP BY 1, 2) SELECT list_id, CAST(row_number() OVER (PARTITION BY list_id ORDER BY k) - 1 AS INTEGER) AS position, suggestion FROM f QUALIFY row_number() OVER (PARTITION BY list_id ORDER BY k) <= 6""")
def source_suggestions(spark: SparkSession, d: str) -> DataFrame:
    names = F.to_json(F.transform("rows", lambda r: r["p_name"]))
    bodies = part_lists(spark, d).select("list_id", F.concat(F.lit('["no such", '), names, F.lit("]")).alias("body"), F.lit("no such").alias("prefix"))
    return feeds.suggestions(bodies, "list_id", "body", "prefix")


@query("SELECT p_partkey // 20 AS list_id, CAST(row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1 AS INTEGER) AS position, p_name AS title, p_partkey AS page_id, 'about ' || p_name || ' & more' AS snippet FROM part")
def source_wiki(spark: SparkSession, d: str) -> DataFrame:
    hits = F.transform("rows", lambda r: F.struct(r["p_name"].alias("title"), r["p_partkey"].alias("pageid"), F.concat(F.lit("about <b>"), r["p_name"], F.lit("</b> &amp; more")).alias("snippet")))
    body = F.to_json(F.struct(F.struct(hits.alias("search")).alias("query")))
    return feeds.wiki_hits(part_lists(spark, d).select("list_id", body.alias("body")), "list_id", "body")


@query("SELECT p_partkey // 20 AS list_id, CAST(row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1 AS INTEGER) AS position, p_name || ' & co' AS title FROM part")
def source_rss(spark: SparkSession, d: str) -> DataFrame:
    items = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("<item><title>"), r["p_name"], F.lit(" &amp; co</title></item>"))), "\n")
    return feeds.rss_titles(part_lists(spark, d).select("list_id", F.concat(F.lit("<rss><title>feed</title>"), items, F.lit("</rss>")).alias("body")), "list_id", "body")


@query("SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, substr(string_agg('w' || l_suppkey, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey), 1, 400) AS abstract FROM lineitem GROUP BY 1")
def source_abstracts(spark: SparkSession, d: str) -> DataFrame:
    placed = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("w"), "l_suppkey").alias("word"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("at"))
    words = placed.groupBy("l_orderkey", "word").agg(F.collect_list("at").alias("at")).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))
    return feeds.abstracts(words, "l_orderkey", "index")


@query()
def card_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Threads as nested cards, flattened again."""
    node = F.struct("turn", F.struct(F.col("role").alias("type"), F.array(F.struct(F.lit("text").alias("type"), F.length("text").alias("size"))).alias("children")).alias("node"))
    bodies = table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(node)), lambda n: n["node"])).alias("body"))
    return cards.flatten_nodes(bodies, "conv_id", "body")


@query("""WITH t AS (SELECT o_orderkey, CAST(o_orderkey % 50 AS INTEGER) AS n, o_orderkey % 5 AS kind, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o_orderkey, CAST(CASE kind WHEN 0 THEN DATE '2001-08-31' - n WHEN 1 THEN DATE '2001-08-31' - 7 * n WHEN 2 THEN DATE '2001-08-31' - to_months(n) WHEN 3 THEN day END AS DATE) AS day FROM t""")
def relative_date(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("o_orderkey") % 5, (F.col("o_orderkey") % 50).cast("string")
    words = F.when(k == 0, F.concat(n, F.lit(" days ago"))).when(k == 1, F.concat(n, F.lit(" weeks ago"))).when(k == 2, F.concat(n, F.lit(" months ago")))
    words = words.when((k == 3) & (F.col("o_orderkey") % 2 == 0), F.date_format("o_orderdate", "MMM d, yyyy")).when(k == 3, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).otherwise("some day")
    return table(spark, d, "orders").select("o_orderkey", money.parsed_date(words, F.lit("2001-08-31").cast("date")).alias("day"))


@query("""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) GROUP BY 1), t AS (SELECT DISTINCT substr(word, 2, 1) || substr(word, 1, 1) || substr(word, 3) AS typed FROM w WHERE length(word) > 3)
SELECT typed, word, n FROM t JOIN w ON damerau_levenshtein(typed, word) = 1 QUALIFY row_number() OVER (PARTITION BY typed ORDER BY n DESC, word) = 1""")
def spelling(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    typed = words.where(F.length("word") > 3).select(F.concat(F.substring("word", 2, 1), F.substring("word", 1, 1), F.substring("word", 3, 1000)).alias("typed")).distinct()
    return entities.nearest_spelling(typed, words, "word", "n")


@query(r"""WITH n AS (SELECT DISTINCT p_size AS scope, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' ' || p_brand END AS name FROM part), w AS (SELECT *, list_filter(string_split_regex(lower(name), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM n)
SELECT a.scope, a.name, b.name AS alias FROM w a JOIN w b ON a.scope = b.scope AND len(b.w) > len(a.w) AND b.w[1:len(a.w)] = a.w""")
def aliases(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_size").alias("scope"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_brand")).alias("name"))
    return entities.longer_forms(p, "scope", "name")


@query("SELECT l_orderkey, round(product(1 + l_tax), 6) AS factor FROM lineitem GROUP BY l_orderkey")
def product_agg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.product(1 + F.col("l_tax")), 6).alias("factor"))


@query()
def merge_works(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order stand for catalogue records: the part for a DOI (one in three has none), the supplier for a preprint id."""
    li = table(spark, d, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("scope"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("position"), F.when(F.col("l_partkey") % 3 != 0, F.concat(F.lit("doi"), F.col("l_partkey") % 40)).alias("doi"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("pre"), F.col("l_suppkey"))).alias("preprint"), F.col("l_returnflag").alias("title"), F.col("l_quantity").alias("citations"))
    return entities.merged_records(rows, "scope", "position", ("doi", "preprint"), ["title"], "citations")


@query()
def markdown_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clean_markdown(F.concat(F.lit("# "), "text")).alias("lines"))
