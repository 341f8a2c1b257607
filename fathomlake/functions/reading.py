"""Identifiers, names, dates, units and amounts in text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import round_half_up
from .text import answer_key, collapsed, fnv1a, let

# The forms of identifiers, the words of titles and names, months and units.
IDENTIFIER = r"(?i)\b10\.\d{4,9}/[-._;()/:a-z0-9]+|\barxiv:\s?\d{4}\.\d{4,5}(?:v\d+)?|\barxiv\.org/(?:abs|pdf)/\d{4}\.\d{4,5}(?:v\d+)?|\bhttps?://[^\s<>\"')\]]+"
DOI = r"(?i)(10\.\d{4,9}/[-._;()/:a-z0-9]+)"
ARXIV = r"(?i)(?:arxiv\.org/(?:abs|pdf|html)/|arxiv:\s*|/arxiv\.)(\d{4}\.\d{4,5}|[a-z-]+/\d{7})(?:v\d+)?"
ARXIV_ID = r"^(?:\d{4}\.\d{4,5}|[a-z-]+/\d{7})$"
SMALL_WORDS = "a an and as at but by for in of on or the to vs via".split()
HONORIFICS = "mr mrs ms miss mx dr prof sir dame rev".split()
SUFFIXES = "jr sr ii iii iv".split()
CREDENTIALS = "md phd dds dmd jd esq rn mbbs pharmd psyd edd dvm od facp facs".split()
ATTRIBUTES = (
    "height heights price prices pricing cost costs hours opening admission tickets specs specifications review reviews stock quote forecast weather score scores schedule tax "
    "taxes ranking rankings comparison guide overview facts history timeline explained today now update updates status results stats standouts size distance launch location menu "
    "fees fee rate rates battery storage release date details summary profile news tonight mirror sales"
).split()
MONTHS = "january february march april may june july august september october november december".split()
ABBREVIATIONS = "jan feb mar apr may jun jul aug sept? oct nov dec".split()
MAY = r"\bMay\s+\d|\b(?:[iI]n|[oO]n|[sS]ince|[fF]rom|[bB]y|[uU]ntil|[bB]efore|[aA]fter|[tT]hrough|[eE]arly|[mM]id-?|[lL]ate|[oO]f|[lL]ast|[nN]ext)\s+May\b"
UNITS = {
    "kg": "kg kilogram kilograms",
    "lb": "lb lbs pound pounds",
    "minutes": "minute minutes min mins",
    "hours": "hour hours hr hrs",
    "seconds": "second seconds sec secs",
    "points": "point points pts ppg",
    "rebounds": "rebound rebounds reb rpg",
    "assists": "assist assists ast apg",
    "steals": "steal steals",
    "blocks": "block blocks",
    "games": "game games",
    "$": "dollar dollars usd $",
    "%": "percent %",
    "cups": "cup cups",
    "calories": "calorie calories kcal",
    "people": "person people user users",
    "days": "day days",
    "servings": "serving servings",
    "items": "item items",
}
SCALES = {"k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6, "bn": 1e9, "billion": 1e9, "trillion": 1e12}
MONEY = r"(?i)(?:[$€£¥]\s?\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?\s?(?:USD|EUR|GBP|dollars|euros|pounds)\b)"
NUMBER = r"(\d[\d,]*(?:\.\d+)?)"
ANNUAL = r"(?i)\b(billed annually|billed yearly|annual billing|yearly billing|per year|a year|/\s?yr|/\s?year)\b"
MONTHLY = r"(?i)\b(billed monthly|month-to-month|month to month|pay monthly|no commitment)\b"


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


# Identifiers.
def identifiers_in(text: Column) -> Column:
    """DOIs, arXiv ids and links, in lower case and without closing marks, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({IDENTIFIER})"), 1), lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), "[.,;:)]+$", ""), "^arxiv:\\s?", "arxiv:"))


def without_identifiers(text: Column) -> Column:
    return F.regexp_replace(text, IDENTIFIER, " ")


def record_key(identifier: Column) -> Column:
    """The DOI or arXiv number in an identifier, or all of it in lower case: one key for one record."""
    doi = F.regexp_replace(F.lower(F.regexp_extract(identifier, DOI, 1)), "[.,;:)]+$", "")
    number = F.regexp_extract(identifier, "(\\d{4}\\.\\d{4,5})(?:v\\d+)?", 1)
    return F.when(doi != "", doi).when(number != "", number).otherwise(F.lower(identifier))


def normalize_doi(doi: Column) -> Column:
    """A DOI in lower case without resolver, scheme and closing slashes; null for an empty one."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(doi, "(?i)^https?://doi\\.org/", ""), "(?i)^doi:", ""), "/+$", "")
    return F.nullif(F.lower(bare), F.lit(""))


def normalize_arxiv(raw: Column) -> Column:
    """An arXiv id without version; null for what is none."""
    linked = F.regexp_extract(F.trim(raw), ARXIV, 1)
    bare = F.when(linked != "", linked).otherwise(F.regexp_replace(F.trim(raw), "(?i)^arxiv:", ""))
    bare = F.lower(F.regexp_replace(F.regexp_replace(bare, "(?i)v\\d+$", ""), "(?i)\\.pdf$", ""))
    return F.when(bare.rlike(ARXIV_ID), bare)


# Words and names.
def join_spaced_decimals(text: Column) -> Column:
    return F.regexp_replace(text, "(\\d{1,3})\\.\\s+(?=\\d{1,3}\\b)", "$1.")


def salted_hash(salt: Column, value: Column) -> Column:
    return F.sha2(F.concat(salt, value), 256)


def normalize_prefix(raw: Column, most: int = 80) -> Column:
    return F.substring(F.lower(collapsed(raw)), 1, most)


def title_query(raw: Column) -> Column:
    """Words with a capital each, small ones only in front; what has inner capitals stays."""

    def word(x: Column, i: Column) -> Column:
        low = F.lower(x)
        cap = lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))
        mixed = (x != low) & (x != F.upper(x))
        return F.when((i > 0) & low.isin(*SMALL_WORDS), low).when(low.rlike("^mc[a-z].+$"), F.concat(F.lit("Mc"), cap(F.substring(low, F.lit(3), F.length(low))))).when(mixed, x).otherwise(cap(low))

    return F.array_join(F.transform(F.filter(F.split(collapsed(raw), " "), lambda x: x != ""), word), " ")


def initials(name: Column) -> Column:
    """First letters of the first and the last word of a name, without titles in front and degrees behind."""
    bare = lambda x: F.lower(F.regexp_replace(x, "[.,]", ""))
    degree = lambda x: x.rlike("^(?:[A-Za-z]\\.){2,}[A-Za-z]?\\.?,?$") | bare(x).isin(*CREDENTIALS) | x.rlike("^(DO|D\\.O)\\.?,?$")
    front = lambda x: bare(x).isin(*HONORIFICS) | degree(x)
    back = lambda x: bare(x).isin(*SUFFIXES) | degree(x)
    at = lambda kept: F.sequence(F.lit(0), F.greatest(F.size(kept) - 1, F.lit(0)))
    first = lambda x: F.upper(F.regexp_extract(x, "([\\p{L}\\p{N}])", 1))

    def from_first(words: Column) -> Column:
        after = F.array_min(F.filter(at(words), lambda i: ~F.coalesce(front(F.get(words, i)), F.lit(False))))
        return F.slice(words, F.coalesce(after, F.size(words) - 1) + 1, F.greatest(F.size(words), F.lit(1)))

    def to_last(named: Column) -> Column:
        until = F.array_max(F.filter(at(named), lambda i: ~F.coalesce(back(F.get(named, i)), F.lit(False))))
        return F.slice(named, 1, F.coalesce(until, F.lit(0)) + 1)

    def letters(own: Column) -> Column:
        return F.when(F.size(own) > 1, F.concat(first(F.get(own, F.lit(0))), first(F.element_at(own, -1)))).otherwise(first(F.get(own, F.lit(0))))

    words = F.filter(F.split(F.trim(name), "\\s+"), lambda x: x.rlike("[\\p{L}\\p{N}]"))
    return let(words, lambda ws: F.when(F.size(ws) == 0, "").otherwise(let(let(from_first(ws), to_last), letters)))


def answer_slug(question: Column) -> Column:
    """A path for a question: its words, at most 48 characters, and a hash of its key."""

    def slug(key: Column) -> Column:
        words = F.substring(F.regexp_replace(F.regexp_replace(key, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 48)
        return F.concat(F.when(words == "", "answer").otherwise(words), F.lit("-"), fnv1a(key))

    return let(answer_key(question), slug)


def head_and_tail(text: Column, cap: int) -> Column:
    """A text within `cap` characters: its beginning and its end (two fifths, at most 1600), and an ellipsis between."""
    tail = min(1600, int(cap * 0.4))
    cut = F.concat(F.substring(text, 1, cap - tail - 3), F.lit("\n…\n"), F.substring(text, -tail, tail))
    return F.when(F.length(text) <= cap, text).otherwise(cut)


def is_inflection(a: Column, b: Column) -> Column:
    """Whether the longer word is the shorter one with an ending."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return F.startswith(long, short) & F.substring(long, F.length(short) + 1, F.length(long)).rlike("^(?:s|es|ed|d|ing|er|est|ly)$")


def same_letters(a: Column, b: Column) -> Column:
    fold = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    return (F.length(fold(a)) >= 4) & (fold(a) == fold(b))


def vowel_swap(word: Column) -> Column:
    """The word with its first two different neighbouring vowels swapped; '' if there are none."""
    low = F.lower(word)
    swapped = F.regexp_replace(low, "^(.*?)(?:([a])([eiou])|([e])([aiou])|([i])([aeou])|([o])([aeiu])|([u])([aeio]))", "$1$3$2$5$4$7$6$9$8$11$10")
    return F.when(low.rlike("a[eiou]|e[aiou]|i[aeou]|o[aeiu]|u[aeio]"), swapped).otherwise("")


def file_words(url: Column) -> Column:
    """The file name of a URL with -, _ and . as spaces."""
    name = F.try_url_decode(F.regexp_extract(url, "([^/?#]*)(?:[?#].*)?$", 1))
    return collapsed(F.regexp_replace(name, "[-_.]+", " "))


def title_subject(title: Column) -> Column:
    """The words of a title before its first attribute ("height", "price"); all of them if it begins with one."""

    def head(words: Column) -> Column:
        at = F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: F.coalesce(F.regexp_replace(F.lower(F.get(words, i)), "[^a-z]", "").isin(*ATTRIBUTES), F.lit(False))))
        return F.array_join(F.slice(words, F.lit(1), F.coalesce(at, F.greatest(F.size(words), F.lit(1)))), " ")

    return let(F.filter(F.split(F.trim(title), "\\s+"), lambda x: x != ""), head)


# Dates.
def within_day(date: Column, now: Column) -> Column:
    """From 36 hours before to 24 hours after now; a missing date isn't."""
    return F.coalesce(date.between(now - F.expr("INTERVAL 36 HOURS"), now + F.expr("INTERVAL 24 HOURS")), F.lit(False))


def years_of(text: Column) -> Column:
    """Distinct years 1900 to 2099 of a text, sorted, with both ends of ranges such as 2025-26."""
    pairs = F.regexp_extract_all(text, F.lit("\\b((?:19|20)\\d{2}\\s*[-–/]\\s*(?:\\d{4}|\\d{2}))\\b"), 1)

    def both(x: Column) -> Column:
        start, end = F.substring(x, 1, 4).cast("int"), F.regexp_extract(x, "(\\d+)$", 1)
        short = F.floor(start / 100) * 100 + end.cast("int")
        return F.array(start, F.when(F.length(end) == 4, end.cast("int")).when(short < start, short + 100).otherwise(short).cast("int"))

    alone = F.transform(F.regexp_extract_all(text, F.lit("\\b((?:19|20)\\d{2})\\b"), 1), lambda y: y.cast("int"))
    return F.array_sort(F.array_distinct(F.concat(F.flatten(F.transform(pairs, both)), alone)))


def century_of(year: Column) -> Column:
    n = F.ceil(year / 100)
    suffix = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(F.lit("the "), n.cast("string"), suffix, F.lit(" century"))


def months_in(text: Column) -> Column:
    """Months (1 to 12) that a text names, by name, by abbreviation before a day, or in a numeric date; May only where it is a date."""
    named = []
    for k, (name, short) in enumerate(zip(MONTHS, ABBREVIATIONS), 1):
        hit = text.rlike(MAY) if k == 5 else text.rlike(f"(?i)\\b{name}\\b") | text.rlike(f"(?i)\\b{short}\\.?\\s+\\d{{1,2}}\\b")
        named.append(F.when(hit, k))
    iso = F.transform(F.regexp_extract_all(text, F.lit("\\b(?:19|20)\\d{2}-(0[1-9]|1[0-2])-\\d{2}\\b"), 1), lambda x: x.cast("int"))
    slashed = F.transform(F.regexp_extract_all(text, F.lit("\\b(1[0-2]|0?[1-9])/\\d{1,2}/(?:19|20)?\\d{2}\\b"), 1), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*named)), iso, slashed)))


def as_of_label(raw: Column) -> Column:
    """ "Oct 7, 2026" of an ISO date; a written date with month and year stays, cut to 40 characters; null for anything else."""
    iso = F.regexp_extract(F.trim(raw), "^(\\d{4}-\\d{2}-\\d{2})", 1)
    written = raw.rlike("\\b(?:19|20)\\d{2}\\b") & raw.rlike("(?i)\\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)") & ~raw.rlike("(?i)\\b(?:ago|today|yesterday)\\b")
    return F.when(iso != "", F.date_format(iso.try_cast("date"), "MMM d, yyyy")).when(written, F.substring(F.trim(raw), 1, 40))


def next_midnight(time: Column) -> Column:
    return F.date_trunc("DAY", time) + F.expr("INTERVAL 1 DAY")


# Amounts.
def grouped(x: Column, digits: int | None = None) -> Column:
    """A number with thousands commas; `digits` decimals, or up to two without closing zeros."""
    if digits is not None:
        return F.format_number(x, digits)
    return F.regexp_replace(F.regexp_replace(F.format_number(round_half_up(x), 2), "0+$", ""), "\\.$", "")


def format_money(amount: Column, currency: Column) -> Column:
    """ "$1,234" or "$1,234.50"; other currencies behind the number."""
    rounded = round_half_up(amount)
    dollars = F.concat(F.when(rounded < 0, "-$").otherwise("$"), F.when(rounded == F.floor(rounded), F.format_number(F.abs(rounded), 0)).otherwise(F.format_number(F.abs(rounded), 2)))
    return F.when(currency == "USD", dollars).otherwise(F.concat(grouped(amount), F.lit(" "), currency))


def published_label(amount: Column, currency: Column, per_seat: Column, yearly: Column) -> Column:
    each, per = F.when(per_seat, "per seat").otherwise("flat"), F.when(yearly, "year").otherwise("month")
    return F.concat(F.coalesce(format_money(amount, currency), F.lit("—")), F.lit(" "), each, F.lit(" / "), per)


def parse_amount(raw: Column, scale: Column) -> Column:
    """ "1,200" and "million" as a number; null for what is none."""
    return F.replace(raw, F.lit(","), F.lit("")).try_cast("double") * F.coalesce(lookup(SCALES, F.lower(scale)), F.lit(1.0))


def canonical_unit(unit: Column) -> Column:
    """One name for a unit's spellings; others in lower case."""
    low = F.regexp_replace(F.lower(unit), "\\.$", "")
    names = {name: unit for unit, names in UNITS.items() for name in names.split()} | {"years old": "years"}
    return F.coalesce(lookup(names, low), low)


def money_in(text: Column) -> Column:
    """Amounts beside a currency's sign or name, without commas and zero decimals, distinct, in order."""
    number = lambda x: F.replace(F.regexp_extract(x, NUMBER, 1), F.lit(","), F.lit(""))
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({MONEY})"), 1), lambda x: F.regexp_replace(number(x), "\\.0+$", "")))


def price_text(x: Column) -> Column:
    """A price with two, four or eight decimals by its size."""
    size = F.abs(x)
    return F.when(size >= 1, F.format_number(x, 2)).when(size >= 0.01, F.format_number(x, 4)).otherwise(F.format_number(x, 8))


def miles(n: Column, unit: Column) -> Column:
    return F.when(unit == "km", n * 0.621371).otherwise(n)


def softmax(scores: Column) -> Column:
    """The weights of an array of scores, which add up to one; an empty array stays."""
    exps = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(exps, F.lit(0.0), lambda a, b: a + b)
    return F.transform(exps, lambda e: e / total)


def chars_to_tokens(chars: Column) -> Column:
    return F.when(chars > 0, F.ceil(chars / 4)).otherwise(0)


def weighted_cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Tokens by rates a million, rounded up; one at least, unless there are none."""
    total = F.ceil((F.greatest(tokens_in, F.lit(0)) * rate_in + F.greatest(tokens_out, F.lit(0)) * rate_out) / 1_000_000)
    return F.when((tokens_in <= 0) & (tokens_out <= 0), 0).otherwise(F.greatest(total, F.lit(1)))


def billing_near(text: Column, amount: Column, reach: int = 120) -> Column:
    """annual or monthly, as the text says within `reach` characters behind the amount and before the next dollar sign; null if it says neither or both."""
    spelled = F.replace(amount, F.lit("."), F.lit("\\."))
    behind = F.transform(F.slice(F.split(text, F.concat(F.lit("(?<![\\d.])"), spelled, F.lit("(?![\\d.])"))), 2, 1000), lambda x: F.regexp_extract(F.substring(x, 1, reach), "^([^$]*)", 1))
    annual, monthly = F.exists(behind, lambda x: x.rlike(ANNUAL)), F.exists(behind, lambda x: x.rlike(MONTHLY))
    return F.when(annual & ~monthly, "annual").when(monthly & ~annual, "monthly")
