"""Queries of the scalar functions over identifiers, names, dates, hosts and amounts; texts are composed from the tables' keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomlake.functions import hosts, reading
from fathomlake.plans.catalogue import HOST_SQL, PATH_SQL, query, table

#: An @ stands for the row's key.
NOTES = (
    "See https://doi.org/10.1000/ABC.@), and arXiv: 2101.0@v2.", "doi:10.5555/x@; http://example.org/a?b=@ and arxiv.org/abs/2203.1234", "no identifier, $@,500.00 and $12 in May", "Between 2019-21 and 2@, on 2024-03-05", "In the 1900s? 1999/2003, 5/6/2021 and Oct 7",
    "Paid €@.50, £7.00 or 1,@ euros by december", "It may rain; since May 2020", "1. 5 degrees and 2. 25 more", "sept. 9 and Aug @", "",
)
DOIS = ("https://doi.org/10.1000/AB/", "doi:10.1/X", "", "10.48550/arXiv.2101.00001", "arXiv:2101.12345v3", "https://arxiv.org/pdf/1901.01234v2.pdf", "hep-th/9901001", "nothing")
NAMES = ("Dr. Ada Lovelace", "Martin Luther King Jr.", "Ana María de la Cruz, Ph.D.", "Prof.", "plato", "J. R. Tolkien MD", "Mr. Do", "…", "Élodie Durand III")
TITLES = ("empire state building height", "mcdonald's menu prices today", "The lord of the rings", "iPhone price", "price list", "NASA Launch Schedule", "met museum opening Hours", "")
PAIRS = (("define", "defined"), ("walk", "walking"), ("near-term", "nearterm"), ("bleuflame", "blueflame"), ("cats", "cat"), ("quick", "quicker"), ("abc", "ab-c"), ("Nvdia", "Nvidia"), ("aeon", "eaon"))
UNIT_WORDS = ("lbs", "Hrs.", "kg", "USD", "percent", "kcal", "users", "furlong", "years old", "%")
SCALE_WORDS = (None, "k", "Million", "bn", "trillion", "dozen")
HOSTS = ("en.wikipedia.org", "dnr.state.mn.us", "mit.edu", "health.gov.au", "wired.com", "me.blogspot.com", "old.reddit.com", "youtu.be", "arxiv.org", "notwikipedia.org", "newlibraryjgza.web.app", "docs.web.app", "x7k9m2qp.web.app", "game.fandom.com", "pornozavr.net", "essex.ac.uk", "localhost", "10.0.0.1", "a.local", "bbc.co.uk")
URL_FORMS = ("https://@/a", "http://@:8080/a", "https://user@@/", "ftp://@/x", "http://@:80/xxx/y", "https://@/page?q=1#f", "//@/a")
PAGES = ("Just a moment... checking your browser", "Your IP address 1.2.3.4 has been blocked", "An article about bread", "Please verify you are a human", "Access denied")


def sql_list(values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (1 + at % len(values)).cast("int"))


def pick_sql(values: tuple, at: str = "p_partkey") -> str:
    return f"({sql_list(values)})[1 + {at} % {len(values)}]"


def key() -> Column:
    return F.col("p_partkey")


NOTES_SQL = f"notes AS (SELECT p_partkey, replace({pick_sql(NOTES)}, '@', CAST(p_partkey AS VARCHAR)) AS note FROM part)"
CLOSING = "regexp_replace(regexp_replace(lower(x), '[.,;:)]+$', ''), '^arxiv:\\s?', 'arxiv:')"
IDS_SQL = f"list_transform(regexp_extract_all(note, '({reading.IDENTIFIER.replace(chr(39), chr(39) * 2)})', 1), lambda x: {CLOSING})"


def notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.replace(pick(NOTES, key()), F.lit("@"), key().cast("string")).alias("note"))


@query(f"""WITH {NOTES_SQL}, i AS (SELECT *, {IDS_SQL} AS ids FROM notes)
SELECT p_partkey, array_to_string(ids, '|') AS ids, array_to_string(list_transform(ids, lambda x: CASE WHEN regexp_extract(x, '{reading.DOI}', 1) <> '' THEN regexp_replace(lower(regexp_extract(x, '{reading.DOI}', 1)), '[.,;:)]+$', '')
  WHEN regexp_extract(x, '(\\d{{4}}\\.\\d{{4,5}})(?:v\\d+)?', 1) <> '' THEN regexp_extract(x, '(\\d{{4}}\\.\\d{{4,5}})(?:v\\d+)?', 1) ELSE lower(x) END), '|') AS records,
  regexp_replace(note, '{reading.IDENTIFIER.replace(chr(39), chr(39) * 2)}', ' ', 'g') AS rest FROM i""")
def text_identifiers(spark: SparkSession, d: str) -> DataFrame:
    ids = reading.identifiers_in(F.col("note"))
    return notes(spark, d).select("p_partkey", F.array_join(ids, "|").alias("ids"), F.array_join(F.transform(ids, reading.record_key), "|").alias("records"), reading.without_identifiers(F.col("note")).alias("rest"))


ARXIV_SQL = f"CASE WHEN regexp_extract(raw, '{reading.ARXIV}', 1) <> '' THEN regexp_extract(raw, '{reading.ARXIV}', 1) ELSE regexp_replace(raw, '(?i)^arxiv:', '') END"
CLEAN_ARXIV_SQL = f"lower(regexp_replace(regexp_replace({ARXIV_SQL}, '(?i)v\\d+$', ''), '(?i)\\.pdf$', ''))"


@query(f"""WITH r AS (SELECT p_partkey, {pick_sql(DOIS)} AS raw FROM part)
SELECT p_partkey, nullif(lower(regexp_replace(regexp_replace(regexp_replace(raw, '(?i)^https?://doi\\.org/', ''), '(?i)^doi:', ''), '/+$', '')), '') AS doi, CASE WHEN regexp_matches({CLEAN_ARXIV_SQL}, '{reading.ARXIV_ID}') THEN {CLEAN_ARXIV_SQL} END AS arxiv FROM r""")
def record_ids(spark: SparkSession, d: str) -> DataFrame:
    raw = pick(DOIS, key())
    return table(spark, d, "part").select("p_partkey", reading.normalize_doi(raw).alias("doi"), reading.normalize_arxiv(raw).alias("arxiv"))


YEARS_SQL = r"""list_sort(list_distinct(list_concat(flatten(list_transform(regexp_extract_all(note, '\b((?:19|20)\d{2}\s*[-–/]\s*(?:\d{4}|\d{2}))\b', 1), lambda x: [CAST(substr(x, 1, 4) AS INTEGER),
  CASE WHEN length(regexp_extract(x, '(\d+)$', 1)) = 4 THEN CAST(regexp_extract(x, '(\d+)$', 1) AS INTEGER) WHEN CAST(substr(x, 1, 2) || regexp_extract(x, '(\d+)$', 1) AS INTEGER) < CAST(substr(x, 1, 4) AS INTEGER) THEN CAST(substr(x, 1, 2) || regexp_extract(x, '(\d+)$', 1) AS INTEGER) + 100
  ELSE CAST(substr(x, 1, 2) || regexp_extract(x, '(\d+)$', 1) AS INTEGER) END])), list_transform(regexp_extract_all(note, '\b((?:19|20)\d{2})\b', 1), lambda y: CAST(y AS INTEGER)))))"""
MONTHS_SQL = "list_sort(list_distinct(list_concat(list_concat(list_filter([{}], lambda x: x IS NOT NULL), {}), {})))".format(
    ", ".join(f"CASE WHEN regexp_matches(note, '{reading.MAY}') THEN 5 END" if k == 5 else f"CASE WHEN regexp_matches(note, '(?i)\\b{n}\\b') OR regexp_matches(note, '(?i)\\b{a}\\.?\\s+\\d{{1,2}}\\b') THEN {k} END" for k, (n, a) in enumerate(zip(reading.MONTHS, reading.ABBREVIATIONS), 1)),
    r"list_transform(regexp_extract_all(note, '\b(?:19|20)\d{2}-(0[1-9]|1[0-2])-\d{2}\b', 1), lambda x: CAST(x AS INTEGER))",
    r"list_transform(regexp_extract_all(note, '\b(1[0-2]|0?[1-9])/\d{1,2}/(?:19|20)?\d{2}\b', 1), lambda x: CAST(x AS INTEGER))",
)


@query(f"""WITH {NOTES_SQL} SELECT p_partkey, array_to_string({YEARS_SQL}, ',') AS years, array_to_string({MONTHS_SQL}, ',') AS months,
  array_to_string(list_transform(regexp_extract_all(note, '({reading.MONEY})', 1), lambda x: regexp_replace(replace(regexp_extract(x, '{reading.NUMBER}', 1), ',', ''), '\\.0+$', '')), ',') AS money,
  regexp_replace(note, '(\\d{{1,3}})\\.\\s+(\\d{{1,3}}\\b)', '\\1.\\2', 'g') AS joined FROM notes""")
def text_dates(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("note")
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return notes(spark, d).select("p_partkey", show(reading.years_of(n)).alias("years"), show(reading.months_in(n)).alias("months"), show(reading.money_in(n)).alias("money"), reading.join_spaced_decimals(n).alias("joined"))


@query("""WITH y AS (SELECT o_orderkey, o_orderdate AS t, o_orderkey % 2100 + 1 AS y FROM orders), c AS (SELECT *, CAST(ceil(y / 100.0) AS INTEGER) AS n FROM y)
SELECT o_orderkey, 'the ' || n || CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END || ' century' AS century,
  strftime(t, '%b %-d, %Y') AS as_of, CAST(date_trunc('day', t) AS TIMESTAMP) + INTERVAL 1 DAY AS next_day, t BETWEEN TIMESTAMP '1996-06-01 12:00:00' - INTERVAL 36 HOUR AND TIMESTAMP '1996-06-01 12:00:00' + INTERVAL 24 HOUR AS within_day FROM c""")
def date_labels(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("o_orderdate")
    now = F.lit("1996-06-01 12:00:00").cast("timestamp")
    century = reading.century_of(F.col("o_orderkey") % 2100 + 1)
    return table(spark, d, "orders").select("o_orderkey", century.alias("century"), reading.as_of_label(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).alias("as_of"), reading.next_midnight(t).alias("next_day"), reading.within_day(t, now).alias("within_day"))


USD_SQL = "CASE WHEN r < 0 THEN '-$' ELSE '$' END || CASE WHEN r = floor(r) THEN format('{:,.0f}', abs(r)) ELSE format('{:,.2f}', abs(r)) END"
BARE_SQL = "regexp_replace(regexp_replace(format('{:,.2f}', r), '0+$', ''), '\\.$', '')"


@query(f"""WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN floor(p_retailprice) ELSE (p_retailprice - 1200) / CASE p_partkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1000.0::DOUBLE WHEN 2 THEN 100000.0::DOUBLE ELSE 7.0::DOUBLE END END AS x, CASE WHEN p_partkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS c, p_partkey % 5 = 0 AS seat, p_partkey % 7 = 0 AS yearly FROM part),
m AS (SELECT *, floor(x * 100 + 0.5) / 100 AS r FROM a), f AS (SELECT *, CASE WHEN c = 'USD' THEN {USD_SQL} ELSE {BARE_SQL} || ' ' || c END AS money FROM m)
SELECT p_partkey, money, coalesce(money, '—') || CASE WHEN seat THEN ' per seat' ELSE ' flat' END || CASE WHEN yearly THEN ' / year' ELSE ' / month' END AS label,
  CASE WHEN abs(x) >= 1 THEN format('{{:,.2f}}', x) WHEN abs(x) >= 0.01 THEN format('{{:,.4f}}', x) WHEN x IS NOT NULL THEN format('{{:,.8f}}', x) END AS price FROM f""")
def money_labels(spark: SparkSession, d: str) -> DataFrame:
    scale = F.when(key() % 4 == 0, 1.0).when(key() % 4 == 1, 1000.0).when(key() % 4 == 2, 100000.0).otherwise(7.0)
    x = F.when(key() % 9 == 0, F.lit(None)).when(key() % 3 == 0, F.floor("p_retailprice")).otherwise((F.col("p_retailprice") - 1200) / scale).cast("double")
    c = F.when(key() % 2 == 0, "USD").otherwise("EUR")
    label = reading.published_label(x, c, key() % 5 == 0, key() % 7 == 0)
    return table(spark, d, "part").select("p_partkey", reading.format_money(x, c).alias("money"), label.alias("label"), reading.price_text(x).alias("price"))


UNITS_SQL = "CASE " + " ".join(f"WHEN u IN ({', '.join(repr(n) for n in names.split())}) THEN '{unit}'" for unit, names in reading.UNITS.items()) + " WHEN u = 'years old' THEN 'years' ELSE u END"


@query(f"""WITH a AS (SELECT p_partkey, p_size, regexp_replace(lower({pick_sql(UNIT_WORDS)}), '\\.$', '') AS u, lower({pick_sql(SCALE_WORDS)}) AS s FROM part)
SELECT p_partkey, {UNITS_SQL} AS unit, (1000.5 + p_partkey) * CASE s WHEN 'k' THEN 1e3 WHEN 'million' THEN 1e6 WHEN 'bn' THEN 1e9 WHEN 'trillion' THEN 1e12 ELSE 1.0::DOUBLE END AS amount,
  CASE WHEN p_partkey % 2 = 0 THEN p_size * 0.621371::DOUBLE ELSE p_size::DOUBLE END AS miles, CAST(ceil(p_size / 4.0) AS BIGINT) AS tokens, CAST(greatest(1, ceil((p_partkey * 25608.0 + p_size * 75147.0) / 1000000)) AS BIGINT) AS cost FROM a""")
def unit_amounts(spark: SparkSession, d: str) -> DataFrame:
    raw = F.format_number(1000.5 + key(), 1)
    size = F.col("p_size")
    distance = reading.miles(size.cast("double"), F.when(key() % 2 == 0, "km").otherwise("mi"))
    cost = reading.weighted_cost(key(), size, F.lit(25608), F.lit(75147))
    return table(spark, d, "part").select("p_partkey", reading.canonical_unit(pick(UNIT_WORDS, key())).alias("unit"), reading.parse_amount(raw, pick(SCALE_WORDS, key())).alias("amount"), distance.alias("miles"), reading.chars_to_tokens(size).alias("tokens"), cost.cast("long").alias("cost"))


@query("""WITH s AS (SELECT l_orderkey, list(l_discount * 10 ORDER BY l_linenumber, l_discount) AS s FROM lineitem GROUP BY 1), e AS (SELECT l_orderkey, list_transform(s, lambda x: exp(x - list_max(s))) AS e FROM s)
SELECT l_orderkey, unnest(list_transform(e, lambda x: round(x / list_sum(e), 9))) AS weight, generate_subscripts(e, 1) - 1 AS pos FROM e""")
def softmax_weights(spark: SparkSession, d: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_discount"))), lambda x: x["l_discount"] * 10)
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(lines.alias("scores"))
    flat = rows.select("l_orderkey", F.posexplode(reading.softmax(F.col("scores"))).alias("pos", "weight"))
    return flat.select("l_orderkey", F.round("weight", 9).alias("weight"), F.col("pos").cast("long").alias("pos"))


def among_sql(known: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"ends_with('.' || host, '.{h}')" for h in known) + ")"


SPAM_SQL = r"(length(regexp_extract(host, '^([^.-]+)\.web\.app$', 1)) >= 12 OR (length(regexp_extract(host, '^([^.-]+)\.web\.app$', 1)) >= 8 AND regexp_matches(regexp_extract(host, '^([^.-]+)\.web\.app$', 1), '\d')))"
SITES_SQL = f"""raw AS (SELECT p_partkey, replace({pick_sql(URL_FORMS)}, '@', {pick_sql(HOSTS, '(p_partkey // 3)')}) AS url, replace({pick_sql(URL_FORMS, '(p_partkey // 2)')}, '@', {pick_sql(HOSTS, '(p_partkey // 3)')}) AS other FROM part),
sites AS (SELECT *, {HOST_SQL} AS host, {PATH_SQL} AS path FROM raw)"""


def sites(spark: SparkSession, d: str) -> DataFrame:
    form = lambda at: F.replace(pick(URL_FORMS, at), F.lit("@"), pick(HOSTS, F.floor(key() / 3)))
    rows = table(spark, d, "part").select("p_partkey", form(key()).alias("url"), form(F.floor(key() / 2)).alias("other"))
    return rows.withColumn("host", hosts.host_of(F.col("url")))


@query(f"""WITH {SITES_SQL} SELECT p_partkey, CASE WHEN host = '' THEN 2 WHEN {among_sql(hosts.AUTHORITY)} OR regexp_matches(host, '{hosts.OFFICIAL[0]}') OR regexp_matches(host, '{hosts.OFFICIAL[1]}') THEN 0 WHEN {among_sql(hosts.PRESS)} THEN 1 WHEN {among_sql(hosts.WEAK)} THEN 3 ELSE 2 END AS tier,
  {among_sql(hosts.NEWSROOM)} AS newsroom, {among_sql(hosts.SOCIAL)} AS social, {among_sql(hosts.SCHOLAR)} AS scholar, {among_sql(hosts.VIDEO)} AS video, regexp_matches(host, '{hosts.FICTION}') AS fiction FROM sites""")
def host_kinds(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("host")
    kinds = {"newsroom": hosts.NEWSROOM, "social": hosts.SOCIAL, "scholar": hosts.SCHOLAR, "video": hosts.VIDEO}
    return sites(spark, d).select("p_partkey", hosts.tier(h).alias("tier"), *(hosts.among(h, known).alias(n) for n, known in kinds.items()), h.rlike(hosts.FICTION).alias("fiction"))


def parts_sql(k: int) -> str:
    return rf"coalesce(regexp_extract(url, '^(?i:https?)://([^/?#]*@)?(\[[^\]]*\]|[^/?#:@]*)(?::(\d*))?(?:[/?#]|$)', {k}), '')"


KEY_SQL = "lower(regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(regexp_replace({0}, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', ''))"


@query(f"""WITH {SITES_SQL} SELECT p_partkey, regexp_matches(host, '{hosts.BLOCKED_HOST}') OR regexp_matches(host, '{hosts.BLOCKED_IN_HOST}') OR {SPAM_SQL} OR regexp_matches(path, '{hosts.BLOCKED_PATH}') AS blocked,
  contains(lower({parts_sql(2)}), '.') AND {parts_sql(1)} = '' AND {parts_sql(3)} IN ('', '80', '443') AND NOT regexp_matches(lower({parts_sql(2)}), '{hosts.UNREACHABLE}') AS fetchable,
  host <> '' AND {KEY_SQL.format('url')} = {KEY_SQL.format('other')} AS same FROM sites""")
def url_rules(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return sites(spark, d).select("p_partkey", hosts.blocked(u).alias("blocked"), hosts.fetchable(u).alias("fetchable"), hosts.same_source(u, F.col("other")).alias("same"))


@query(f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {pick_sql(PAGES, 'doc_id')} || ' ' || text ELSE text || ' captcha' END AS text FROM documents)
SELECT doc_id, length(text) < 4000 AND regexp_matches(substr(text, 1, 800), '{hosts.BLOCK_PAGE}') AS refused FROM t""")
def block_pages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    text = F.when(k % 3 == 0, F.concat(pick(PAGES, k), F.lit(" "), F.col("text"))).otherwise(F.concat("text", F.lit(" captcha")))
    return table(spark, d, "documents").select("doc_id", hosts.is_block_page(text).alias("refused"))


PAIRS_SQL = f"{sql_list(tuple(a for a, _ in PAIRS))}", f"{sql_list(tuple(b for _, b in PAIRS))}"
FOLD_SQL = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


@query(f"""WITH w AS (SELECT p_partkey, ({PAIRS_SQL[0]})[1 + p_partkey % {len(PAIRS)}] AS a, ({PAIRS_SQL[1]})[1 + p_partkey % {len(PAIRS)}] AS b FROM part),
o AS (SELECT *, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM w)
SELECT p_partkey, starts_with(l, s) AND regexp_matches(substr(l, length(s) + 1), '^(?:s|es|ed|d|ing|er|est|ly)$') AS inflection, length({FOLD_SQL.format('a')}) >= 4 AND {FOLD_SQL.format('a')} = {FOLD_SQL.format('b')} AS same_letters,
  sha256('salt' || a) AS hashed, CASE WHEN length(a || b) <= 12 THEN a || b ELSE substr(a || b, 1, 5) || chr(10) || '…' || chr(10) || right(a || b, 4) END AS cut FROM o""")
def word_relations(spark: SparkSession, d: str) -> DataFrame:
    a, b = pick(tuple(x for x, _ in PAIRS), key()), pick(tuple(y for _, y in PAIRS), key())
    return table(spark, d, "part").select("p_partkey", reading.is_inflection(a, b).alias("inflection"), reading.same_letters(a, b).alias("same_letters"), reading.salted_hash(F.lit("salt"), a).alias("hashed"), reading.head_and_tail(F.concat(a, b), 12).alias("cut"))


@query()
def name_labels(spark: SparkSession, d: str) -> DataFrame:
    """Initials, titles, subjects, slugs, file words: checked on literals against plain values."""
    name, title = pick(NAMES, key()), pick(TITLES, key())
    return table(spark, d, "part").select("p_partkey", reading.initials(name).alias("initials"), reading.title_query(title).alias("title"), reading.title_subject(title).alias("subject"), reading.answer_slug(title).alias("slug"), reading.normalize_prefix(title).alias("prefix"), reading.vowel_swap(F.col("p_name")).alias("swapped"), reading.file_words(F.concat(F.lit("https://a.org/x/"), F.regexp_replace("p_name", " ", "-"), F.lit(".jpg?w=1"))).alias("file"))
