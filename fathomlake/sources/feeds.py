"""Parsers of landed payloads: each turns a column of raw bodies into rows, and a body it can't read into none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomlake.functions import text


def sse_frames(streams: DataFrame, key: str, body: str) -> DataFrame:
    """(key, seq, event, data) of complete server-sent-event frames; what follows the last blank line is incomplete."""
    frames = F.split(F.replace(body, F.lit("\r\n"), F.lit("\n")), "\n\n")
    rows = streams.select(key, F.posexplode(F.slice(frames, 1, F.greatest(F.size(frames) - 1, F.lit(0)))).alias("seq", "frame"))
    event = F.regexp_extract("frame", "(?m)^event:[ ]?(.*)$", 1)
    data = F.array_join(F.regexp_extract_all("frame", F.lit("(?m)^data:[ ]?(.*)$"), 1), "\n")
    return rows.select(key, "seq", F.when(event != "", F.trim(event)).otherwise("message").alias("event"), data.alias("data"))


def suggestions(bodies: DataFrame, key: str, body: str, prefix: str, most: int = 6) -> DataFrame:
    """(key, position, suggestion) of OpenSearch JSON ["prefix", ["a", "b"]]: distinct, without the prefix itself."""
    found = F.from_json(F.get_json_object(body, "$[1]"), "array<string>")
    clean = F.array_distinct(F.transform(F.filter(found, lambda s: s.isNotNull()), lambda s: text.collapsed(s)))
    kept = F.slice(F.filter(clean, lambda s: (s != "") & (F.lower(s) != F.lower(F.col(prefix)))), 1, most)
    return bodies.select(key, F.posexplode(kept).alias("position", "suggestion"))


def wiki_hits(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, position, title, page_id, snippet) of MediaWiki search JSON."""
    kind = "struct<query: struct<search: array<struct<title: string, pageid: bigint, snippet: string>>>>"
    rows = bodies.select(key, F.posexplode(F.from_json(body, kind)["query"]["search"]).alias("position", "hit"))
    return rows.where("hit.title IS NOT NULL").select(key, "position", F.col("hit.title").alias("title"), F.col("hit.pageid").alias("page_id"), text.strip_html(F.coalesce("hit.snippet", F.lit(""))).alias("snippet"))


def rss_titles(bodies: DataFrame, key: str, body: str, most: int | None = None, covered: str | None = None) -> DataFrame:
    """(key, position, title) of the items of an RSS feed; at most `most`, without those of the array column `covered` (case aside)."""
    items = F.regexp_extract_all(body, F.lit("(?s)<item\\b[^>]*>(.*?)</item>"), 1)
    titles = F.transform(items, lambda i: text.strip_html(F.regexp_replace(F.regexp_extract(i, "(?s)<title\\b[^>]*>(.*?)</title>", 1), "<!\\[CDATA\\[|\\]\\]>", "")))
    kept = F.filter(titles, lambda t: t != "")
    if covered:
        known = F.transform(covered, F.lower)
        kept = F.filter(kept, lambda t: ~F.array_contains(known, F.lower(t)))
    return bodies.select(key, F.posexplode(kept if most is None else F.slice(kept, 1, most)).alias("position", "title"))


def web_hits(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, position, title, url, snippet, date, image) of a search API's web rows, at the top or under results; rows without a web address go."""
    row = "array<struct<url: string, title: string, description: string, snippet: string, page_age: string, thumbnail_url: string>>"
    parsed = F.from_json(body, f"struct<results: struct<web: {row}>, web: {row}>")
    rows = bodies.select(key, F.posexplode(F.coalesce(parsed["results"]["web"], parsed["web"])).alias("position", "hit"))
    url = F.trim("hit.url")
    title = F.coalesce(F.nullif(F.trim("hit.title"), F.lit("")), text.host_of(url))
    image = F.when(F.col("hit.thumbnail_url").rlike("(?i)^https://"), F.col("hit.thumbnail_url"))
    snippet = text.clip(F.coalesce("hit.description", "hit.snippet", F.lit("")), 320)
    return rows.where(url.rlike("(?i)^https?://")).select(key, "position", title.alias("title"), url.alias("url"), snippet.alias("snippet"), F.nullif(F.col("hit.page_age"), F.lit("")).alias("date"), image.alias("image"))


def social_posts(bodies: DataFrame, key: str, body: str, most: int = 5) -> DataFrame:
    """(key, position, handle, url, title, snippet, date) of a post search: posts with an author and an address, by their text or what they link to."""
    link = "struct<external: struct<title: string, description: string>>"
    parsed = F.from_json(body, f"struct<posts: array<struct<uri: string, author: struct<handle: string>, record: struct<text: string, createdAt: string, embed: {link}>, embed: {link}>>>")
    rows = bodies.select(key, F.posexplode(parsed["posts"]).alias("at", "post"))
    handle = F.trim(F.regexp_replace("post.author.handle", "^@", ""))
    post_id = F.regexp_extract("post.uri", "/app\\.bsky\\.feed\\.post/(?:.*/)?([^/]+)$", 1)
    words = text.collapsed(F.coalesce("post.record.text", F.lit("")))
    linked = lambda f: F.coalesce(F.col(f"post.embed.external.{f}"), F.col(f"post.record.embed.external.{f}"))
    extra = text.collapsed(F.coalesce(F.nullif(linked("description"), F.lit("")), linked("title"), F.lit("")))
    shown = F.when(words != "", words).otherwise(extra)
    rows = rows.select(key, "at", handle.alias("handle"), post_id.alias("id"), shown.alias("shown"), F.when(words != "", words).otherwise(F.coalesce(linked("title"), shown)).alias("lead"), F.col("post.record.createdAt").alias("date"))
    rows = rows.where("handle <> '' AND id <> '' AND shown <> ''").withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("at"))).where(F.col("position") <= most)
    url = F.concat(F.lit("https://bsky.app/profile/"), "handle", F.lit("/post/"), "id")
    return rows.select(key, "position", "handle", url.alias("url"), text.clip(F.col("lead"), 140).alias("title"), text.clip(F.concat(F.lit("@"), "handle", F.lit(": "), "shown"), 320).alias("snippet"), "date")


def catalogue_works(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, position, doi, title, year, venue, authors, citations, abstract) of a DOI registry's items, the most cited first."""
    item = "struct<DOI: string, title: array<string>, issued: struct<`date-parts`: array<array<int>>>, `container-title`: array<string>, author: array<struct<given: string, family: string, name: string>>, `is-referenced-by-count`: bigint, abstract: string>"
    parsed = F.from_json(body, f"struct<message: struct<items: array<{item}>>>")
    rows = bodies.select(key, F.posexplode(parsed["message"]["items"]).alias("at", "w"))
    first = lambda c: F.get(c, F.lit(0))
    names = F.transform("w.author", lambda a: F.coalesce(a["name"], F.concat_ws(" ", a["given"], a["family"])))
    cited = F.coalesce(F.col("w")["is-referenced-by-count"], F.lit(0))
    rows = rows.select(key, "at", F.lower("w.DOI").alias("doi"), first(F.col("w.title")).alias("title"), first(first(F.col("w.issued")["date-parts"])).alias("year"), first(F.col("w")["container-title"]).alias("venue"), F.array_join(names, "; ").alias("authors"), cited.alias("citations"), text.strip_html(F.col("w.abstract")).alias("abstract"))
    placed = rows.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("citations"), "at")))
    return placed.select(key, "position", "doi", "title", "year", "venue", "authors", "citations", "abstract")


def work_results(works: DataFrame, key: str, most: int = 300) -> DataFrame:
    """(key, position, title, url, domain, snippet) of catalogue works that have a title and a DOI: who, when, where, how often cited."""
    names = F.split("authors", "; ")
    who = F.when(F.size(names) > 3, F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.lit(" et al."))).otherwise(F.array_join(names, ", "))
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    meta = F.concat_ws(". ", part("Authors: ", who), part("Published: ", F.col("year").cast("string")), part("Venue: ", F.col("venue")), part("DOI: ", F.col("doi")), F.concat(F.lit("Cited by "), F.col("citations").cast("string"), F.lit(" works")))
    kept = works.where("title <> '' AND doi <> ''")
    return kept.select(key, "position", "title", F.concat(F.lit("https://doi.org/"), "doi").alias("url"), F.lit("doi.org").alias("domain"), F.substring(F.concat(meta, F.lit(".")), 1, most).alias("snippet"))


def video_rows(bodies: DataFrame, key: str, body: str, most: int = 10) -> DataFrame:
    """(key, position, title, url) of the videos in a results page's embedded data, each once."""
    pattern = r'"videoRenderer":\{{"videoId":"{0}".*?"title":\{{"runs":\[\{{"text":"{1}"'
    found = lambda *p: F.regexp_extract_all(body, F.lit("(?s)" + pattern.format(*p)), 1)
    string = r'(?:[^"\\]|\\.)*'
    pairs = F.arrays_zip(found(r"([\w-]{11})", string).alias("id"), found(r"[\w-]{11}", f"({string})").alias("title"))
    rows = bodies.select(key, F.posexplode(pairs).alias("at", "v")).where("v.title <> ''")
    first = rows.groupBy(key, "v.id").agg(F.min(F.struct("at", F.col("v.title").alias("title"))).alias("f"))
    placed = first.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("f.at"))).where(F.col("position") <= most)
    return placed.select(key, "position", F.col("f.title").alias("title"), F.concat(F.lit("https://www.youtube.com/watch?v="), "id").alias("url"))


def arxiv_works(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, position, arxiv_id, title, year, authors) of an Atom feed's entries."""
    entries = F.regexp_extract_all(body, F.lit("(?s)<entry\\b[^>]*>(.*?)</entry>"), 1)
    rows = bodies.select(key, F.posexplode(entries).alias("position", "entry"))
    one = lambda tag: text.strip_html(F.regexp_extract("entry", f"(?s)<{tag}\\b[^>]*>(.*?)</{tag}>", 1))
    names = F.regexp_extract_all("entry", F.lit("(?s)<name>\\s*(.*?)\\s*</name>"), 1)
    arxiv_id = F.regexp_extract(one("id"), "arxiv\\.org/abs/([^/\\s]+?)(?:v\\d+)?$", 1)
    return rows.select(key, "position", arxiv_id.alias("arxiv_id"), one("title").alias("title"), F.regexp_extract(one("published"), "^(\\d{4})", 1).try_cast("int").alias("year"), F.array_join(names, "; ").alias("authors"))


def result_links(bodies: DataFrame, key: str, body: str, most: int = 8) -> DataFrame:
    """(key, position, title, url) of a plain HTML results page: its outward links, each url once, redirects unwrapped."""
    links = F.regexp_extract_all(body, F.lit("(?is)<a\\b[^>]*?href=[\"']([^\"']+)[\"'][^>]*>.*?</a>"), 1)
    titles = F.regexp_extract_all(body, F.lit("(?is)<a\\b[^>]*?href=[\"'][^\"']+[\"'][^>]*>(.*?)</a>"), 1)
    rows = bodies.select(key, F.posexplode(F.arrays_zip(links.alias("href"), titles.alias("label"))).alias("at", "link"))
    href = F.col("link.href")
    target = F.regexp_extract(href, "[?&]uddg=([^&]+)", 1)
    url = F.when(target != "", F.try_url_decode(target)).otherwise(F.replace(href, F.lit("&amp;"), F.lit("&")))
    rows = rows.select(key, "at", url.alias("url"), text.strip_html(F.col("link.label")).alias("title")).where(F.col("url").rlike("^https?://") & (F.col("title") != ""))
    first = rows.groupBy(key, "url").agg(F.min("at").alias("at"), F.min_by("title", "at").alias("title"))
    placed = first.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("at")))
    return placed.where(F.col("position") <= most).select(key, "position", "title", "url")


def abstracts(works: DataFrame, key: str, index: str, most: int = 400) -> DataFrame:
    """(key, abstract) of an inverted index, a map from word to its places: words in order, cut at `most` characters."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return works.select(key, F.substring(F.array_join(F.transform(F.array_sort(places), lambda p: p["word"]), " "), 1, most).alias("abstract"))
