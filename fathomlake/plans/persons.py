"""Queries over persons in rows and over quotations; registered beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomlake.functions import people as signs
from fathomlake.operators import entities, people, quotations
from fathomlake.plans.catalogue import query, table

SIGNS_SQL = """s AS (SELECT o_custkey AS scope, o_orderkey AS "row", CASE WHEN o_orderkey % 5 < 3 THEN ['role' || (o_orderkey // 3) % 3] ELSE [] END AS roles,
  CASE WHEN o_orderkey % 7 < 4 THEN ['place' || (o_orderkey // 5) % 2] ELSE [] END AS places, CASE WHEN o_orderkey % 11 = 0 THEN ['paren' || o_orderkey % 2] ELSE [] END AS parens,
  CASE WHEN o_orderkey % 3 = 0 THEN [] ELSE ['org' || (o_orderkey // 2) % 3] END AS orgs FROM orders), n AS (SELECT *, list_concat(roles, places, parens, orgs) AS sig FROM s)"""


def signs_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """An order stands for a row about its customer, with roles, places, a qualifier and an employer by its number."""
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    named = lambda what, n: F.array(F.concat(F.lit(what), n.cast("string")))
    roles = F.when(k % 5 < 3, named("role", F.floor(k / 3) % 3)).otherwise(none)
    places = F.when(k % 7 < 4, named("place", F.floor(k / 5) % 2)).otherwise(none)
    parens = F.when(k % 11 == 0, named("paren", k % 2)).otherwise(none)
    orgs = F.when(k % 3 == 0, none).otherwise(named("org", F.floor(k / 2) % 3))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("scope"), k.alias("row"), roles.alias("roles"), places.alias("places"), parens.alias("parens"), orgs.alias("orgs"))
    return rows.withColumn("sig", F.concat("roles", "places", "parens", "orgs"))


@query(f"""WITH RECURSIVE {SIGNS_SQL}, e AS (SELECT a.scope, a."row" AS a, b."row" AS b FROM n a JOIN n b ON a.scope = b.scope AND list_has_any(a.sig, b.sig)
  AND (len(a.roles) = 0 OR len(b.roles) = 0 OR list_has_any(a.roles, b.roles)) AND (len(a.places) = 0 OR len(b.places) = 0 OR list_has_any(a.places, b.places))
  AND (len(a.parens) = 0 OR len(b.parens) = 0 OR list_has_any(a.parens, b.parens))),
r AS (SELECT scope, a, b FROM e UNION SELECT r.scope, r.a, e.b FROM r JOIN e ON r.scope = e.scope AND r.b = e.a),
strong AS (SELECT scope, a AS "row", min(b) AS cluster FROM r GROUP BY ALL), size AS (SELECT scope, cluster, count(*) AS n FROM strong GROUP BY ALL),
top AS (SELECT scope, cluster FROM size QUALIFY row_number() OVER (PARTITION BY scope ORDER BY n DESC, cluster) = 1), weak AS (SELECT scope, "row" FROM n WHERE len(sig) = 0)
SELECT scope, "row", cluster FROM strong UNION ALL SELECT w.scope, w."row", coalesce(t.cluster, min(w."row") OVER (PARTITION BY w.scope)) AS cluster FROM weak w LEFT JOIN top t USING (scope)""")
def refused_merges(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a customer into persons, with roles, places and qualifiers that refuse a merge, and rows without any sign."""
    rows = signs_of_orders(spark, d)
    strong = people.compatible_clusters(rows, "scope", "row", "sig", ["roles", "places", "parens"])
    return people.attach_weak(strong, rows.where(F.size("sig") == 0), "scope", "row")


NAMES = ("Ada Bell", "Ian Moss", "Lena Ortiz", "Tom Reed", "Ruth Vance")
TITLES = ("{n} (explorer)", "{n}", "{n}, CEO of Northwind", "Mayor {n} | City of Salem", "{n} - dentist in Portland")
SNIPPETS = ("{n} is an engineer at Fabrikam.", "The explorer {n} was born in Dover.", "{n} works for Contoso in Salem.", "About {n} and more.", "{n} lives in Portland. He paints.")


def _dealt(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def rows_about_people(spark: SparkSession, d: str) -> DataFrame:
    """Pages as result rows about a few names: composed titles and snippets before a page's own title; a scope is 40 pages of one name."""
    k = F.col("page_id")
    name = _dealt(NAMES, k)
    fill = lambda texts, n: F.replace(_dealt(texts, n), F.lit("{n}"), name)
    own = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, d, "pages").select(
        F.concat_ws(":", name, F.floor(k / 200).cast("string")).alias("scope"), k.alias("row"), name.alias("name"),
        fill(TITLES, F.floor(k / 5)).alias("title"), F.concat_ws(" ", fill(SNIPPETS, F.floor(k / 7)), own).alias("snippet"), "url",
    )


@query()
def person_signals(spark: SparkSession, d: str) -> DataFrame:
    rows = rows_about_people(spark, d).withColumn("s", signs.signals(F.col("name"), F.col("title"), F.col("snippet"), F.col("url")))
    return rows.select("scope", "row", "s.has_name", "s.roles", "s.orgs", "s.locs", "s.paren", "s.sig")


@query()
def person_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Rows about a name into persons: clusters under refusals, those of a qualified page merged, weak rows attached, each described."""
    rows = rows_about_people(spark, d).withColumn("s", signs.signals(F.col("name"), F.col("title"), F.col("snippet"), F.col("url"))).where("s.has_name")
    rows = entities.settled(rows).withColumns({"sig": F.col("s.sig"), "roles": F.col("s.roles"), "orgs": F.col("s.orgs"), "locs": F.transform("s.locs", lambda v: F.lower(v))})
    rows = rows.withColumn("parens", F.when(F.col("s.paren").isNull(), F.array().cast("array<string>")).otherwise(F.array("s.paren")))
    strong = people.compatible_clusters(rows, "scope", "row", "sig", ["roles", "locs", "parens"])
    own = signs.tokens(F.col("name"))
    qualifying = F.when(F.size("parens") > 0, F.filter("sig", lambda w: (F.length(w) >= 4) & ~F.array_contains(own, w)))
    carried = rows.select("scope", "row", F.array_distinct(signs.tokens(F.concat_ws(" ", "title", "snippet"))).alias("words"), qualifying.alias("qualifying"))
    merged = people.merge_qualified(strong.join(carried, ["scope", "row"]), "scope", "row", "words", "qualifying")
    members = people.attach_weak(merged, rows.where(F.size("sig") == 0), "scope", "row")
    return people.described(members.join(rows.select("scope", "row", "roles", "orgs", "locs"), ["scope", "row"]), "scope", {"roles": "role", "orgs": "org", "locs": "place"})


WORDS_SQL = r"list_filter(list_transform(string_split_regex(regexp_replace(lower({t}), '[‘’]', '''', 'g'), '[^\p{{L}}\p{{N}}%$''.]+'), lambda w: regexp_replace(w, '\.$', '')), lambda w: length(w) > 2)"


CUT_SQL = r"string_split(regexp_replace(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))"
FLAT_SQL = r"trim(regexp_replace(unnest(s), '[ \t\n\r\f\v]+', ' ', 'g'))"


@query(rf"""WITH bs AS (SELECT item_id, {CUT_SQL} AS s FROM benchmark), b AS (SELECT item_id, generate_subscripts(s, 1) - 1 AS part, string_split({FLAT_SQL}, ' ') AS w FROM bs),
q AS (SELECT item_id * 1000 + part AS quote_id, array_to_string(list_transform(w, lambda x, i: CASE WHEN i % 10 = 0 THEN 'altered' ELSE x END), ' ') AS quote FROM b),
qw AS (SELECT quote_id, quote, {WORDS_SQL.format(t="quote")} AS want FROM q), d AS (SELECT doc_id, {CUT_SQL} AS s FROM documents),
u AS (SELECT doc_id, {FLAT_SQL} AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM d), uw AS (SELECT *, {WORDS_SQL.format(t="sentence")} AS have FROM u WHERE length(sentence) BETWEEN 1 AND 400),
m AS (SELECT quote_id, doc_id, pos, sentence, len(list_filter(want, lambda w: list_contains(have, w))) AS found, len(want) AS n FROM qw JOIN uw ON list_has_any(want, have) AND length(sentence) <= length(quote) * 1.6 + 20 WHERE len(want) >= 6)
SELECT quote_id, doc_id, CAST(pos AS INTEGER) AS pos, sentence, round(found / n, 6) AS share FROM m WHERE found * 100 >= n * 85 QUALIFY row_number() OVER (PARTITION BY quote_id ORDER BY found DESC, doc_id, pos) = 1""")
def reworded_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of benchmark passages with each tenth word altered find the sentence of a document that they come from."""
    parts = table(spark, d, "benchmark").select("item_id", F.posexplode(quotations.source_sentences(F.col("text"))).alias("part", "sentence"))
    altered = F.array_join(F.transform(F.split("sentence", " "), lambda x, i: F.when((i + 1) % 10 == 0, "altered").otherwise(x)), " ")
    quotes = parts.select((F.col("item_id") * 1000 + F.col("part")).alias("quote_id"), altered.alias("quote"))
    return quotations.nearest_sentences(quotes, table(spark, d, "documents"), "quote_id", "quote", "doc_id", "text")


@query()
def whole_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Turns that quote a passage: one exactly but cut short, one altered, one that no document has."""
    words = F.split("text", " ")
    cut = F.array_join(F.slice(words, 2, 12), " ")
    altered = F.array_join(F.transform(words, lambda x, i: F.when((i + 1) % 10 == 0, "altered").otherwise(x)), " ")
    body = F.concat(F.lit('It says "'), cut, F.lit('" and “'), F.substring(altered, 1, 390), F.lit('” but not "no source has these words at all, or does it".'))
    return quotations.whole_quotes(table(spark, d, "benchmark").select("item_id", body.alias("body")), table(spark, d, "documents"), "item_id", "body", "doc_id", "text")
