"""Searches made of a question: its subject, the sides and items that it compares, cleaner and looser wordings, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .asks import cashtags, says, words_of
from .text import collapsed, let

# Wordings and word lists, matched without regard to case unless said otherwise.
TRAILING = "standout standouts highlights analysis report recap review preview takeaways performance breakdown update latest news rumors stats".split()
END_MARKS = r"[),.;:!?]+$"
SAID_TWICE = r"(?iu)\b([\p{L}\p{N}][\p{L}\p{N}'’.-]*(?:\s+[\p{L}\p{N}][\p{L}\p{N}'’.-]*){1,4})\s+\1(?![\p{L}\p{N}])"
SITE_FILTER = r"^site:"
DOMAIN = r"(?:https?:\/\/\S+|(?:[a-z0-9-]+\.)+[a-z]{2,}(?:\/\S*)?)"
QUESTION_LEAD = r"(?i)^(?:who|what|where|when|which|how)\s+(?:is|are|was|were|does|do|did)\s+(?:the\s+)?"
FRAME = r"(?i)^(?:pros and cons(?:\s+of)?|which is better(?:\s+value)?|compare(?:\s+top picks for)?|how to|should i|is it worth(?: it)?(?: to)?)\s*[:\-—]?\s*"
LEAD = r"(?i)^(?:(?:who|what|when|where|why|how)(?:'s|\s+(?:is|are|was|were|did|does|do|much|many|long|old|to|can|should|would|will))?|tell me about|is it worth|latest on|more on|news on|the|is|are)\s+"
TAIL = (
    "injury injuries injured stats stat news update updates today now latest tonight price prices stock stocks share shares earnings forecast contract salary worth net "
    "age height wife husband girlfriend boyfriend schedule score scores highlights trade rumors rumours dropping falling rising up down crashing surging drop fall rise "
    "jump jumping explained meaning profile bio career record status return game games so going doing today? yesterday tomorrow recap recaps"
).split()
SPORTS = r"\b(injur\w*|stats?|games?|score[sd]?|trade[sd]?|contract|season|playoffs?|nba|nfl|mlb|nhl|wnba|draft|roster|highlights)\b"
WHO = r"^(?:who\s+(?:is|was)|tell me about)\b"
TICKER = r"(?:^|\s)\$([A-Za-z]{1,5})\b"
MARKET = r"^(stocks?|shares?|earnings|price)$"
BETTER = r"(?i)^(?:which is better(?: value)?|compare)\s*:\s*"
SIDE_BY_SIDE = r"(?i)[\s,]+(?:side[\s-]by[\s-]side|head[\s-]to[\s-]head)\s*$"
LEAD_VERB = r"(?i)^(?:(?:compare|explain|show|find|watch|describe|summarize|list)\b[\s:,-]*)+"
SCOPE = r"(?i)\s+(?:for|in)\s+(?:(?:19|20)\d\d|the U\.?S\.?|the United States)$"
ASPECTS = r"(?i)(?:\s+(?:full|tech(?:nical)?|spec(?:s|ification)?s?|sheet|prices?|pricing|costs?|reviews?|comparison|compared|differences?))+$"
LEAGUE = r"(?i)\b(NBA|NFL|MLB|NHL|WNBA)\b"
COMPARISON = r"\b(?:versus|which|compar\w*)\b|\bvs\b\.?"
SEPARATOR = r"(?i)\s*(?:,|\bvs\b\.?|\bversus\b|\bcompared\s+(?:to|with)\b|\bor\b|\band\b)\s*"
ITEM_FILLER = (
    r"(?i)\bwhich\s+is\s+better\b",
    r"(?i)\bwhich\s+should\s+i\s+buy\b",
    r"(?i)\bwhat\s+do\s+they\s+cost\b",
    r"(?i)\bshould\s+i\s+buy\b",
    r"(?i)\bcurrent\s+prices\b",
    r"(?i)\bwhich\s+one\b",
    r"(?i)\bhow\s+much\b",
    r"\bfor\s+\p{Ll}[\p{Ll}\p{N}-]*",
    r"(?i)\bwhich\b",
)


def without_repeated_lead(q: Column) -> Column:
    """A text without its lead where it says this twice: the shortest lead of three words or more, marks and case aside."""
    plain = lambda words: F.transform(words, lambda x: F.regexp_replace(F.lower(x), "[:?.!,]+$", ""))

    def cut(words: Column, norm: Column) -> Column:
        lengths = F.when(F.size(words) >= 6, F.sequence(F.lit(3), F.floor(F.size(words) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
        again = lambda n: (F.get(norm, n) == F.get(norm, F.lit(0))) & (F.slice(norm, F.lit(1), n) == F.slice(norm, n + 1, n)) & F.exists(F.slice(norm, F.lit(1), n), lambda x: x != "")
        first = F.get(F.filter(lengths, again), F.lit(0))
        return F.when(first.isNull(), F.trim(q)).otherwise(F.array_join(F.slice(words, first + 1, F.size(words)), " "))

    return let(words_of(q), lambda words: let(plain(words), lambda norm: cut(words, norm)))


def peel_frame(q: Column) -> Column:
    """A text without the labels and the repeated lead in front of it, up to four of them; never empty where the text isn't."""

    def once(s: Column) -> Column:
        return let(collapsed(F.regexp_replace(without_repeated_lead(s), FRAME, "")), lambda rest: F.when(rest == "", s).otherwise(rest))

    def peeled(s: Column, left: int) -> Column:
        return let(once(s), lambda rest: peeled(rest, left - 1)) if left else s

    return let(collapsed(q), lambda s: peeled(s, 4))


def _last_where(words: Column, test: Callable[[Column], Column]) -> Column:
    """How many words at the end pass a test without a break."""
    back = F.reverse(words)
    stop = F.array_position(F.transform(back, lambda x: ~test(x)), F.lit(True)).cast("int")
    return F.when(stop == 0, F.size(words)).otherwise(stop - 1)


def subject_of(q: Column) -> Column:
    """struct(subject, topic, kind): what a question is about, what it asks of that, and ticker, sports, person or general."""
    tail = lambda x: F.lower(x).isin(*TAIL)

    def named(s: Column, who: Column) -> Column:
        def parts(words: Column) -> Column:
            def cut(n: Column) -> Column:
                subject = F.array_join(F.slice(words, F.lit(1), F.size(words) - n), " ")
                topic = F.slice(words, F.size(words) - n + 1, n)
                market = subject.rlike("^[A-Z]{2,5}$") & F.exists(topic, lambda x: says(x, MARKET))
                kind = F.when(market, "ticker").when(says(q, SPORTS), "sports").when(who, "person").otherwise("general")
                return F.struct(subject.alias("subject"), F.array_join(topic, " ").alias("topic"), kind.alias("kind"))

            return let(F.least(_last_where(words, tail), F.greatest(F.size(words) - 1, F.lit(0))), cut)

        return let(words_of(s), parts)

    def of_ticker(s: Column) -> Column:
        topic = F.filter(words_of(F.regexp_replace(s, f"^(.*?){TICKER}", "$1 ")), tail)
        return F.struct(F.upper(F.regexp_extract(s, TICKER, 1)).alias("subject"), F.array_join(topic, " ").alias("topic"), F.lit("ticker").alias("kind"))

    def judged(s: Column) -> Column:
        bare = s
        for _ in range(3):
            bare = F.regexp_replace(bare, LEAD, "")
        return let(bare, lambda b: F.when(F.regexp_extract(b, TICKER, 1) != "", of_ticker(b)).otherwise(named(b, says(s, WHO))))

    return let(collapsed(F.regexp_replace(peel_frame(q), "[?!.]+$", "")), judged)


def _site(word: Column) -> Column:
    return says(F.regexp_replace(word, END_MARKS, ""), SITE_FILTER)


def _domain(word: Column) -> Column:
    return ~_site(word) & says(F.regexp_replace(word, END_MARKS, ""), f"^{DOMAIN}$")


def _tidy(q: Column) -> Column:
    return F.trim(F.regexp_replace(collapsed(q), END_MARKS, ""))


def without_domains(q: Column) -> Column:
    """A search without URLs and hosts; site filters stay, without the marks behind them."""
    kept = F.filter(words_of(q), lambda x: ~_domain(x))
    return F.array_join(F.transform(kept, lambda x: F.when(_site(x), F.regexp_replace(x, END_MARKS, "")).otherwise(x)), " ")


def source_tails(title: Column) -> Column:
    """What of a source's title may stand behind a search: the title, its hosts and the names of these, the longest first."""
    hosts = F.regexp_extract_all(title, F.lit(f"(?i)({DOMAIN})"), 1)
    names = F.transform(hosts, lambda x: F.regexp_extract(F.regexp_replace(F.regexp_replace(x, "(?i)^https?://", ""), "(?i)^www\\.", ""), "^([^/.]*)", 1))
    every = F.filter(F.concat(F.array(collapsed(title)), hosts, names), lambda x: F.length(x) > 1)
    return F.transform(F.sort_array(F.transform(every, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))), asc=False), lambda s: s["x"])


def without_source_tail(q: Column, title: Column) -> Column:
    ends = lambda x: F.endswith(F.concat(F.lit(" "), F.lower(q)), F.concat(F.lit(" "), F.lower(x))) & (F.length(x) < F.length(q))
    tail = F.get(F.filter(source_tails(F.coalesce(title, F.lit(""))), ends), F.lit(0))
    return let(tail, lambda x: F.when(x.isNull(), q).otherwise(F.trim(F.substring(q, F.lit(1), F.length(q) - F.length(x)))))


def sanitized(q: Column, title: Column) -> Column:
    """A search without phrases said twice in a row, hosts, closing marks and the title of the card it came from; never empty where the question isn't."""

    def chosen(said: Column) -> Column:
        return let(_tidy(without_domains(said)), lambda bare: F.coalesce(*(F.nullif(x, F.lit("")) for x in (_tidy(without_source_tail(bare, title)), bare)), said))

    return let(F.regexp_replace(collapsed(q), SAID_TWICE, "$1"), chosen)


def relaxed(q: Column, most: int = 6) -> Column:
    """A looser search: a question's capitalised words and numbers, or its words where it has none, without filler at the end; tickers and "stock" where it has these."""
    plain = collapsed(F.array_join(F.filter(words_of(q), lambda x: ~_site(x) & ~_domain(x)), " "))
    plain = F.regexp_replace(F.regexp_replace(plain, "[\"'“”‘’()\\[\\]{}]", " "), "[^A-Za-z0-9\\s'-]+", " ")
    bare = F.filter(F.transform(words_of(plain), lambda x: F.regexp_replace(x, "^['-]+|['-]+$", "")), lambda x: x != "")

    def looser(words: Column) -> Column:
        entities = F.filter(words, lambda x: x.rlike("^[A-Z0-9]"))
        return F.array_join(F.slice(F.when(F.size(entities) > 0, entities).otherwise(words), 1, most), " ")

    without = let(bare, lambda words: F.slice(words, F.lit(1), F.size(words) - _last_where(words, lambda x: F.lower(x).isin(*TRAILING))))
    return let(cashtags(q), lambda tags: F.when(F.size(tags) > 0, F.concat(F.upper(F.array_join(tags, " ")), F.lit(" stock"))).otherwise(let(without, looser)))


def entity_query(q: Column, most: int = 4) -> Column:
    """The capitalised words that a question begins with, its question words aside; '' where there are none."""
    asked = F.regexp_replace(F.regexp_replace(F.trim(q), QUESTION_LEAD, ""), "[\"'“”‘’()\\[\\]{}]", " ")
    kept = F.filter(words_of(without_domains(asked)), lambda x: ~_site(x))
    bare = F.filter(F.transform(kept, lambda x: F.regexp_replace(x, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")), lambda x: x != "")

    def run(words: Column) -> Column:
        stop = F.array_position(F.transform(words, lambda x: ~x.rlike("^[A-Z]")), F.lit(True)).cast("int")
        return F.array_join(F.slice(words, F.lit(1), F.least(F.when(stop == 0, F.size(words)).otherwise(stop - 1), F.lit(most))), " ")

    return let(bare, run)


def _named(side: Column) -> Column:
    named = F.trim(F.regexp_replace(F.regexp_replace(F.trim(side), "(?i)^(?:the|a|an)\\s+", ""), SCOPE, ""))
    return let(named, lambda x: let(F.trim(F.regexp_replace(x, ASPECTS, "")), lambda bare: F.when(F.length(bare) >= 2, bare).otherwise(x)))


def _long(parts: Column) -> Column:
    return F.filter(parts, lambda x: F.length(x) >= 2)


def _listed(text: Column) -> Column:
    """The parts of a list with commas, the last one split at "and"."""
    parts = F.split(text, "\\s*,\\s*")
    bare = lambda x: F.trim(F.regexp_replace(x, "(?i)^(?:and|with|to)\\s+", ""))
    each = lambda x, i: F.when(i == F.size(parts) - 1, F.transform(F.split(bare(x), "(?i)\\s+\\band\\b\\s+"), lambda s: F.trim(s))).otherwise(F.array(bare(x)))
    return F.when(F.contains(text, F.lit(",")), _long(F.flatten(F.transform(parts, each)))).otherwise(F.array().cast("array<string>"))


def _sides(asked: Column) -> Column:
    lead = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(asked, SIDE_BY_SIDE, ""), "[.?!]+$", "")), "(?i)^.*?\\bcomparing\\s+", "compare ")
    pair = "(?i)^compare\\s+(.+?)\\s+(?:and|with|to)\\s+(.+)$"

    def judged(s: Column) -> Column:
        versus = _long(F.transform(F.split(s, "(?i)\\s+(?:vs\\.?|versus)\\s+"), lambda x: F.trim(F.regexp_replace(F.trim(x), LEAD_VERB, ""))))
        two = F.when(s.rlike(pair), _long(F.array(_named(F.regexp_extract(s, pair, 1)), _named(F.regexp_extract(s, pair, 2))))).otherwise(F.array().cast("array<string>"))
        listed = let(_listed(F.regexp_extract(s, "(?i)^compare\\s+(.+)$", 1)), lambda x: F.when(F.size(x) >= 2, F.transform(x, _named)).otherwise(two))
        return let(versus, lambda x: F.when(F.size(x) >= 2, F.transform(x, _named)).otherwise(listed))

    return let(lead, judged)


def compare_sides(q: Column) -> Column:
    """The things that a comparison names, in order; what stands behind a colon is what to compare them on, unless the comparison itself does."""

    def judged(asked: Column) -> Column:
        behind = F.regexp_extract(asked, ":\\s+(.+)$", 1)
        after = F.when(behind != "", _sides(behind)).otherwise(F.array().cast("array<string>"))
        later = let(after, lambda x: F.when(F.size(x) > 0, x).otherwise(_sides(asked)))
        return let(_sides(F.regexp_replace(asked, "\\s*:\\s+.*$", "")), lambda x: F.when(F.size(x) > 0, x).otherwise(later))

    return let(F.trim(F.regexp_replace(q, BETTER, "")), judged)


def compare_count(sides: Column) -> Column:
    """How many options a comparison has room for: two to four."""
    return F.least(F.greatest(F.size(sides), F.lit(2)), F.lit(4))


def side_queries(q: Column, sides: Column) -> Column:
    """A search for each side beside the whole question: the second and third with the league named elsewhere, then the first."""
    league = F.upper(F.regexp_extract(q, LEAGUE, 1))
    full = lambda x: F.when((league != "") & ~F.array_contains(F.transform(F.regexp_extract_all(x, F.lit(LEAGUE), 1), F.upper), league), F.concat(league, F.lit(" "), x)).otherwise(x)
    return F.when(F.size(sides) >= 2, F.concat(F.transform(F.slice(sides, 2, 2), full), F.slice(sides, 1, 1))).otherwise(F.array().cast("array<string>"))


def split_entities(q: Column) -> Column:
    """The items that a comparison names, each once whatever its case; words without a capital or digit aren't items; empty where nothing is compared."""

    def item(part: Column) -> Column:
        out = F.replace(part, F.lit("?"), F.lit(" "))
        for pattern in ITEM_FILLER:
            out = F.regexp_replace(out, pattern, " ")
        return F.trim(F.regexp_replace(collapsed(out), "^[\\s,:;.-]+|[\\s,:;.-]+$", ""))

    looks = lambda x: F.exists(words_of(x), lambda w: F.regexp_replace(w, "^[^\\p{L}\\p{N}]+", "").rlike("^\\p{Lu}") | w.rlike("[0-9]"))
    items = F.filter(F.transform(F.split(F.trim(q), SEPARATOR), item), looks)

    def once(found: Column, low: Column) -> Column:
        return F.filter(found, lambda x, i: F.array_position(low, F.get(low, i)) == i + 1)

    distinct = let(items, lambda found: let(F.transform(found, F.lower), lambda low: once(found, low)))
    return F.when(says(q, COMPARISON), distinct).otherwise(F.array().cast("array<string>"))
