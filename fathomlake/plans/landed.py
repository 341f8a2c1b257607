"""Queries of the payload parsers and counters whose inputs are composed from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomlake.operators import usage
from fathomlake.plans.catalogue import query, table
from fathomlake.plans.more import part_lists
from fathomlake.sources import feeds


def bodies(spark: SparkSession, d: str, item, wrap) -> DataFrame:
    """(list_id, body): twenty parts each as JSON items, wrapped."""
    return part_lists(spark, d).select("list_id", F.to_json(wrap(F.transform("rows", item))).alias("body"))


@query("""SELECT p_partkey // 20 AS list_id, CAST(row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1 AS INTEGER) AS position, CASE WHEN p_partkey % 4 = 0 THEN 'shop.example' ELSE p_name END AS title, 'https://www.shop.example/' || p_partkey AS url,
  'about ' || p_name AS snippet, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '2024-01-02' END AS date, CASE WHEN p_partkey % 2 = 0 THEN 'https://i.example/' || p_partkey END AS image FROM part QUALIFY p_partkey % 5 > 0""")
def source_web_hits(spark: SparkSession, d: str) -> DataFrame:
    k = lambda r: r["p_partkey"]
    item = lambda r: F.struct(F.concat(F.when(k(r) % 5 == 0, "ftp").otherwise("https"), F.lit("://www.shop.example/"), k(r)).alias("url"), F.when(k(r) % 4 == 0, " ").otherwise(r["p_name"]).alias("title"), F.concat(F.lit("about "), r["p_name"]).alias("description"), F.when(k(r) % 3 == 0, "").otherwise("2024-01-02").alias("page_age"), F.concat(F.when(k(r) % 2 == 0, "https").otherwise("http"), F.lit("://i.example/"), k(r)).alias("thumbnail_url"))
    return feeds.web_hits(bodies(spark, d, item, lambda rows: F.struct(F.struct(rows.alias("web")).alias("results"))), "list_id", "body")


@query("""WITH p AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'linked ' || p_name ELSE 'I saw ' || p_name END AS shown FROM part WHERE p_partkey % 4 > 0)
SELECT p_partkey // 20 AS list_id, CAST(row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) AS INTEGER) AS position, 'u' || p_partkey || '.example' AS handle, 'https://bsky.app/profile/u' || p_partkey || '.example/post/r' || p_partkey AS url, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE shown END AS title,
  '@u' || p_partkey || '.example: ' || shown AS snippet, '2024-01-02' AS date FROM p QUALIFY row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) <= 5""")
def source_posts(spark: SparkSession, d: str) -> DataFrame:
    k = lambda r: r["p_partkey"]
    kind = lambda r: F.when(k(r) % 4 == 0, "like").otherwise("post")
    link = lambda r: F.struct(F.struct(r["p_name"].alias("title"), F.concat(F.lit("linked "), r["p_name"]).alias("description")).alias("external"))
    record = lambda r: F.struct(F.when(k(r) % 3 == 0, " ").otherwise(F.concat(F.lit("I  saw "), r["p_name"])).alias("text"), F.lit("2024-01-02").alias("createdAt"))
    item = lambda r: F.struct(F.concat(F.lit("at://x/app.bsky.feed."), kind(r), F.lit("/r"), k(r)).alias("uri"), F.struct(F.concat(F.lit("@u"), k(r), F.lit(".example")).alias("handle")).alias("author"), record(r).alias("record"), link(r).alias("embed"))
    return feeds.social_posts(bodies(spark, d, item, lambda rows: F.struct(rows.alias("posts"))), "list_id", "body")


@query("""WITH w AS (SELECT p_partkey // 20 AS list_id, CAST(row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey % 9 DESC, p_partkey) AS INTEGER) AS position, p_partkey, p_name FROM part)
SELECT list_id, position, p_name AS title, 'https://doi.org/10.1/x' || p_partkey AS url, 'doi.org' AS domain,
  'Authors: Ann ' || p_name || ', The Group. Published: ' || (2000 + p_partkey % 20) || '. Venue: Journal. DOI: 10.1/x' || p_partkey || '. Cited by ' || (p_partkey % 9) || ' works.' AS snippet FROM w""")
def source_catalogue_works(spark: SparkSession, d: str) -> DataFrame:
    k = lambda r: r["p_partkey"]
    authors = lambda r: F.array(F.struct(F.lit("Ann").alias("given"), r["p_name"].alias("family"), F.lit(None).cast("string").alias("name")), F.struct(F.lit(None).cast("string").alias("given"), F.lit(None).cast("string").alias("family"), F.lit("The Group").alias("name")))
    item = lambda r: F.struct(F.concat(F.lit("10.1/X"), k(r)).alias("DOI"), F.array(r["p_name"]).alias("title"), F.struct(F.array(F.array((2000 + k(r) % 20).cast("int"))).alias("date-parts")).alias("issued"), F.array(F.lit("Journal")).alias("container-title"), authors(r).alias("author"), (k(r) % 9).alias("is-referenced-by-count"))
    works = feeds.catalogue_works(bodies(spark, d, item, lambda rows: F.struct(F.struct(rows.alias("items")).alias("message"))), "list_id", "body")
    return feeds.work_results(works, "list_id")


@query("""SELECT p_partkey // 20 AS list_id, CAST(row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) AS INTEGER) AS position, p_name AS title, 'https://www.youtube.com/watch?v=v' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS url FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) <= 10""")
def source_videos(spark: SparkSession, d: str) -> DataFrame:
    video = lambda r: F.concat(F.lit('{"videoRenderer":{"videoId":"v'), F.lpad(r["p_partkey"].cast("string"), 10, "0"), F.lit('","thumb":1,"title":{"runs":[{"text":"'), r["p_name"], F.lit('"}]}}}'))
    pages = part_lists(spark, d).select("list_id", F.concat(F.lit("<script>var ytInitialData = ["), F.array_join(F.transform("rows", video), ","), F.lit("];</script>")).alias("body"))
    return feeds.video_rows(pages, "list_id", "body")


@query("""SELECT p_partkey // 20 AS list_id, CAST(row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1 AS INTEGER) AS position, '2101.' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS arxiv_id, p_name || ' & co' AS title, CAST(2000 + p_partkey % 20 AS INTEGER) AS year, 'Ann; Bob' AS authors FROM part""")
def source_arxiv(spark: SparkSession, d: str) -> DataFrame:
    entry = lambda r: F.concat(F.lit("<entry><id>http://arxiv.org/abs/2101."), F.lpad(r["p_partkey"].cast("string"), 5, "0"), F.lit("v2</id><published>"), (2000 + r["p_partkey"] % 20).cast("string"), F.lit("-01-02</published><title>"), r["p_name"], F.lit(" &amp; co</title><author><name>Ann</name></author><author><name>Bob</name></author></entry>"))
    feed = part_lists(spark, d).select("list_id", F.concat(F.lit("<feed>"), F.array_join(F.transform("rows", entry), ""), F.lit("</feed>")).alias("body"))
    return feeds.arxiv_works(feed, "list_id", "body")


@query("""SELECT p_partkey // 20 AS list_id, CAST(row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) AS INTEGER) AS position, p_name AS title, 'https://shop.example/' || p_partkey || '?a=1&b=2' AS url FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) <= 8""")
def source_links(spark: SparkSession, d: str) -> DataFrame:
    link = lambda r: F.concat(F.lit('<p><a class="x" href="/own">own</a><a href="https://shop.example/'), r["p_partkey"].cast("string"), F.lit('?a=1&amp;b=2"><b>'), r["p_name"], F.lit("</b></a></p>"))
    page = part_lists(spark, d).select("list_id", F.concat(F.lit("<html>"), F.array_join(F.transform("rows", link), ""), F.lit("</html>")).alias("body"))
    return feeds.result_links(page, "list_id", "body")


@query("""WITH RECURSIVE e AS (SELECT *, CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 0 WHEN 'error' THEN NULL ELSE 10 END AS cap, CASE WHEN user_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS share FROM events),
n AS (SELECT event_id, event_type, CAST(ts AS DATE) AS day, CASE WHEN cap = 0 THEN 0 WHEN share < 1 THEN greatest(1, floor(cap * share)) ELSE cap END AS most, row_number() OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY ts, event_id) AS k FROM e),
s AS (SELECT day, event_type, 0::BIGINT AS k, 0 AS used, NULL::BIGINT AS event_id, true AS admitted FROM (SELECT DISTINCT day, event_type FROM n)
  UNION ALL SELECT n.day, n.event_type, n.k, s.used + CASE WHEN s.used < n.most THEN 1 ELSE 0 END, n.event_id, n.most IS NULL OR s.used < n.most FROM s JOIN n ON n.day = s.day AND n.event_type = s.event_type AND n.k = s.k + 1)
SELECT event_id, admitted FROM s WHERE k > 0""")
def share_limited_cap(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    cap = F.when(kind == "view", 3).when(kind == "click", 0).when(kind == "error", F.lit(None)).otherwise(10).cast("int")
    rows = table(spark, d, "events").withColumns({"cap": cap, "share": F.when(F.col("user_id") % 2 == 0, 1.0).otherwise(0.5)})
    return usage.share_limited(rows, ["event_type"], "ts", "event_id", "cap", "share").select("event_id", "admitted")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT event_id, user_id, k, t AS start FROM e WHERE k = 1 UNION ALL SELECT e.event_id, e.user_id, e.k, greatest(e.t, s.start + 36000000000) FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT event_id, make_timestamp(start) AS start FROM s""")
def spaced_starts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return usage.spaced_starts(rows, "user_id", "ts", "event_id", 36_000_000_000).select("event_id", "start")
