"""Queries over objects, diagrams, contexts, packed answers and figures; registered beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomlake.functions.text import host_of, page_text
from fathomlake.operators import context, objects, spans
from fathomlake.plans.catalogue import query, table
from fathomlake.streaming import revisions

SAME_SQL = """len(x.p) > 0 AND (len(x.m) > 0) = (len(c.m) > 0) AND (len(x.m) = 0 OR list_has_any(x.m, c.m)) AND CASE WHEN len(x.w) = 0 OR len(c.w) = 0 THEN len(x.m) > 0
  WHEN len(x.w) <= len(c.w) THEN list_has_all(c.w, x.w) ELSE list_has_all(x.w, c.w) END"""
LEADERS_SQL = f"""named AS (SELECT p_partkey // 25 AS scope, p_partkey AS position, p_type AS fact, p_name || CASE WHEN p_partkey % 4 < 2 THEN ' T' || (p_partkey // 4) % 5 ELSE '' END || CASE WHEN p_partkey % 6 = 0 THEN ' ' || p_type ELSE '' END AS name FROM part),
parts AS (SELECT *, list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda x: length(x) >= 2) AS p, row_number() OVER (PARTITION BY scope ORDER BY position) AS k FROM named),
kinds AS (SELECT *, list_filter(p, lambda x: regexp_matches(x, '[0-9]')) AS m, list_filter(p, lambda x: NOT regexp_matches(x, '[0-9]') AND length(x) >= 4) AS w FROM parts),
fold AS (SELECT scope, 0::BIGINT AS k, CAST([] AS STRUCT(position BIGINT, p VARCHAR[], m VARCHAR[], w VARCHAR[])[]) AS held, NULL::BIGINT AS position, NULL::BIGINT AS leader FROM (SELECT DISTINCT scope FROM kinds)
  UNION ALL SELECT scope, k, CASE WHEN hit IS NULL THEN list_append(held, {{'position': position, 'p': p, 'm': m, 'w': w}}) ELSE held END, position, coalesce(hit, position)
  FROM (SELECT f.scope, c.k, f.held, c.position, c.p, c.m, c.w, list_filter(f.held, lambda x: {SAME_SQL})[1].position AS hit FROM fold f JOIN kinds c ON c.scope = f.scope AND c.k = f.k + 1)),
led AS (SELECT scope, position, leader FROM fold WHERE k > 0)"""


def named_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as sides of questions about 25 of them: a name, a model number on half of them, a type on some."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("Show the "), "p_name", F.when(k % 4 < 2, F.concat(F.lit(" T"), (F.floor(k / 4) % 5).cast("string"))).otherwise(""), F.when(k % 6 == 0, F.concat(F.lit(" "), "p_type")).otherwise(""), F.lit(" what is it?"))
    return table(spark, d, "part").select(F.floor(k / 25).alias("scope"), k.alias("position"), name.alias("name"), F.col("p_type").alias("fact"))


@query(f"WITH RECURSIVE {LEADERS_SQL} SELECT scope, position, leader FROM led")
def object_leaders(spark: SparkSession, d: str) -> DataFrame:
    return objects.leaders(named_parts(spark, d), "scope", "name", "position")


@query(f"""WITH RECURSIVE {LEADERS_SQL}, f AS (SELECT scope, leader, fact, min(position) AS since FROM led JOIN named USING (scope, position) GROUP BY ALL),
l AS (SELECT scope, leader, array_to_string(list(fact ORDER BY since)[1:8], '; ') AS facts FROM f GROUP BY ALL)
SELECT scope, 'o' || rank() OVER (PARTITION BY scope ORDER BY leader) AS object, name, facts FROM l JOIN (SELECT scope, position AS leader, name FROM named) USING (scope, leader)""")
def thread_objects(spark: SparkSession, d: str) -> DataFrame:
    out = objects.thread_objects(named_parts(spark, d), "scope", "name", "fact", "position")
    return out.withColumn("facts", F.array_join("facts", "; "))


@query()
def product_leaders(spark: SparkSession, d: str) -> DataFrame:
    return objects.leaders(named_parts(spark, d), "scope", "name", "position", objects.same_product, objects.product_keys)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS graph, l_partkey % 9 AS a, l_suppkey % 9 AS b FROM lineitem), n AS (SELECT graph, a AS node FROM e UNION SELECT graph, b FROM e), c AS (SELECT graph, count(*) AS n FROM n GROUP BY 1),
r AS (SELECT graph, node, 0 AS len FROM n UNION SELECT r.graph, e.b, r.len + 1 FROM r JOIN e ON e.graph = r.graph AND e.a = r.node JOIN c ON c.graph = r.graph WHERE r.len < c.n)
SELECT graph, node, CAST(CASE WHEN max(len) < n THEN max(len) END AS INTEGER) AS level FROM r JOIN c USING (graph) GROUP BY graph, node, n""")
def diagram_levels(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as the edges of a diagram, some of which run in circles."""
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("graph"), (F.col("l_partkey") % 9).alias("a"), (F.col("l_suppkey") % 9).alias("b"))
    return objects.levels(edges, "graph", "a", "b")


@query()
def fitted_context(spark: SparkSession, d: str) -> DataFrame:
    """Threads as contexts of at most 500 characters: the first turn as the topic, earlier ones as lines, the last as the card on screen."""
    flat = F.regexp_replace("text", r"\s+", " ")
    line = F.when(F.col("turn") == 0, F.concat(F.lit("Topic: "), flat, F.lit("\n" + context.HEADER))).otherwise(F.concat(F.lit("- Q: "), flat))
    lines = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line"), flat.alias("flat")))), lambda x: x).alias("x"))
    last = F.concat(F.lit("Latest card: "), F.element_at("x", -1)["flat"])
    text = F.concat(F.array_join(F.transform("x", lambda x: x["line"]), "\n"), F.lit("\n"), last)
    return lines.select("conv_id", text.alias("text")).select("conv_id", context.fit_context(F.col("text"), 500).alias("fitted"))


PACKED = "struct<results:array<struct<title:string,url:string,snippet:string,domain:string,engines:array<string>,date:string,content:string>>,images:array<struct<url:string>>,knowledge:struct<title:string>>"


def searches(spark: SparkSession, d: str) -> DataFrame:
    """Ten pages as the hits of one search; every third search is a large one."""
    k = F.col("page_id")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    body = page_text(F.col("html"))
    hit = F.struct(k.alias("page_id"), title.alias("title"), F.col("url"), body.alias("snippet"), host_of(F.col("url")).alias("domain"), F.array(F.lit("web"), F.lit("news")).alias("engines"), F.lit("2024-01-05").alias("date"), body.alias("content"))
    image = F.struct(F.col("url"), F.col("url").alias("thumb"), title.alias("title"), host_of(F.col("url")).alias("source"), F.lit("CC").alias("license"), F.lit(None).cast("string").alias("credit"))
    talk = F.struct(title.alias("title"), F.col("url"))
    hits = table(spark, d, "pages").groupBy(F.floor(k / 10).alias("search")).agg(F.array_sort(F.collect_list(hit)).alias("hits"), F.array_sort(F.collect_list(image)).alias("images"), F.array_sort(F.collect_list(talk)).alias("talk"))
    engine = F.struct(F.lit("web").alias("name"), F.lit(True).alias("ok"), F.lit(10).alias("count"), F.lit(120).alias("ms"), F.lit(None).cast("string").alias("error"))
    top = F.col("hits")[0]
    known = F.when(F.col("search") % 2 == 0, F.struct(top["title"].alias("title"), top["content"].alias("extract"), top["url"].alias("url"), F.lit(None).cast("string").alias("description")))
    return hits.select("search", F.concat(F.lit("search "), F.col("search").cast("string")).alias("query"), F.lit("any").alias("freshness"), "hits", "images", known.alias("knowledge"), "talk", F.array(engine).alias("engines"))


@query()
def packed_searches(spark: SparkSession, d: str) -> DataFrame:
    """Searches within budgets of 32,000, 4,000, 1,500 and 300 bytes, and what of each is read back."""
    s = searches(spark, d)
    most = F.explode(F.array(*map(F.lit, (context.PAYLOAD_MAX, 4_000, 1_500, 300)))).alias("most")
    args = [F.col(c) for c in ("query", "freshness", "hits", "images", "knowledge", "talk", "engines")]
    packed = F.when(F.col("most") == context.PAYLOAD_MAX, context.pack_search(*args))
    for n in (4_000, 1_500, 300):
        packed = packed.when(F.col("most") == n, context.pack_search(*args, most=n))
    rows = s.select("*", most).select("search", "most", packed.alias("payload"))
    return rows.withColumn("n_results", F.size(context.unpacked(F.col("payload"), PACKED)["results"]))


def figure_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a sentence of figures before them that overlap in several ways."""
    k = F.col("doc_id")
    s = lambda n: n.cast("string")
    sentence = F.concat(
        F.lit("The price was $"), s(k), F.lit(","), F.lpad(s(k % 997), 3, "0"), F.lit(".50 million and it weighs "), s(k % 90), F.lit(" lbs; he had "), s(k % 40), F.lit(".5 PPG, points: "), s(k % 31), F.lit(" in "),
        s(10 + k % 50), F.lit(":"), F.lpad(s(k % 60), 2, "0"), F.lit(" minutes of "), s(k % 82), F.lit(" games, up "), s(k % 100), F.lit(" percent. Optional extra for $"), s(5 + k % 7), F.lit(". The fee is $"), s(20 + k % 9), F.lit(". "),
    )
    return table(spark, d, "documents").select("doc_id", F.concat(sentence, "text").alias("text"))


@query()
def priority_figures(spark: SparkSession, d: str) -> DataFrame:
    found = figure_texts(spark, d).select("doc_id", F.explode(spans.figures(F.col("text"))).alias("f"))
    return found.select("doc_id", "f.start", "f.label", "f.unit", F.round("f.amount", 4).alias("amount"), "f.clock", "f.rate")


@query()
def money_lines(spark: SparkSession, d: str) -> DataFrame:
    return figure_texts(spark, d).select("doc_id", F.explode(spans.money_clauses(F.col("text"))).alias("c")).select("doc_id", "c.start", "c.figure", "c.value", "c.line")


@query()
def lead_figures(spark: SparkSession, d: str) -> DataFrame:
    asked = figure_texts(spark, d).withColumns({"question": F.lit("what is the fee"), "words": F.array(F.lit("fee"))})
    return spans.lead_figures(asked, "doc_id", "question", "text", "words")


SAYS_SQL = "CASE WHEN value > 80 THEN 'no' WHEN value > 40 THEN 'yes' ELSE '' END"


@query(f"""WITH n AS (SELECT user_id // 2 AS card, event_id % 5 AS slot, {SAYS_SQL} AS says, event_type AS payload, ts, event_id FROM events WHERE event_type <> 'error'),
l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY card, slot ORDER BY ts DESC, event_id DESC) = 1), v AS (SELECT *, bool_or(says = 'no') OVER (PARTITION BY card) AND says = 'yes' AS retracted FROM l)
SELECT card, slot, CASE WHEN NOT retracted THEN payload END AS payload, retracted FROM v""")
def settled_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Events as nodes of cards: the slot's last one is shown, unless it says yes and another one says no."""
    v = F.col("value")
    nodes = table(spark, d, "events").where("event_type <> 'error'").select(F.floor(F.col("user_id") / 2).alias("card"), (F.col("event_id") % 5).alias("slot"), F.when(v > 80, "no").when(v > 40, "yes").otherwise("").alias("says"), F.col("event_type").alias("payload"), "ts", "event_id")
    return revisions.settled_verdicts(nodes, "card", "slot", "says", "payload", "ts", "event_id")


@query("""WITH r AS (SELECT event_id, user_id, ts AS shown FROM events WHERE event_type = 'view'), c AS (SELECT event_id AS content_id, user_id, ts AS arrived FROM events WHERE event_type = 'click')
SELECT r.event_id, c.content_id FROM r LEFT JOIN c ON c.user_id = r.user_id AND c.arrived BETWEEN r.shown - INTERVAL 1 HOUR AND r.shown + INTERVAL 4 HOUR""")
def late_contents(spark: SparkSession, d: str) -> DataFrame:
    """Views as results shown, clicks of the same user as contents that come an hour early to four hours late."""
    e = table(spark, d, "events")
    results = e.where("event_type = 'view'").select("event_id", "user_id", F.col("ts").alias("shown"))
    contents = e.where("event_type = 'click'").select(F.col("event_id").alias("content_id"), "user_id", F.col("ts").alias("arrived"))
    return revisions.late_content(results, contents, "user_id", "shown", "arrived", "1 hour", "4 hours").select("event_id", "content_id")
