"""Figures by priority: passes of patterns over a text, each taking only what no earlier pass has taken."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomlake.functions.text import let


# The passes, in the order of their priority, and how units and labels are named.
CLOCK = r"(?i)\b(\d{1,2}):(\d{2})(?::(\d{2}))?\b(?:\s*(minutes|minute|mins|min|hours|hour|hrs|hr|seconds|second|secs|sec))?"
MONEY = r"(?i)[$€£¥]\s?(\d[\d,]*(?:\.\d+)?)(?:\s?(k|m|bn|million|billion|trillion|thousand))?"
RATE_NAMES = "PPG|RPG|APG|SPG|BPG|MPG|FG%|FT%|3P%"
RATE = rf"(?i)\b({RATE_NAMES})\s*[:=]?\s*(\d[\d,]*(?:\.\d+)?)\b|\b(\d[\d,]*(?:\.\d+)?)\s*({RATE_NAMES})\b"
LEAD = (
    r"(?i)\b(points|point|pts|rebounds|rebound|reb|assists|assist|ast|steals|steal|blocks|block|games|game|minutes|minute|hours|hour|dollars|dollar|calories|kcal|people|cups|cup|kg|lb|lbs)"
    r"\s*[:=]?\s*(\d[\d,]*(?:\.\d+)?)(?!\s*(?:%|percent|kg|lb|lbs|pounds|minutes|minute|hours|hour|points|point|games|game))"
)
UNIT = (
    r"(?i)\b(\d[\d,]*(?:\.\d+)?)(?:\s*(million|billion|trillion|thousand))?\s*(%|percent|kg|kilograms|lb|lbs|pounds|minutes|minute|mins|min|hours|hour|hrs|hr|seconds|second|secs|sec|miles|mph"
    r"|km\/h|km|meters|metres|feet|ft|people|users|years old|GB|TB|points|point|pts|rebounds|rebound|assists|assist|steals|steal|blocks|block|games|game|cups|cup|calories|kcal|dollars|dollar"
    r"|servings|serving|items|item|days|day)"
)
SCALES = {"k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6, "bn": 1e9, "billion": 1e9, "trillion": 1e12}
SAME_UNIT = {
    "kg": "kilogram kilograms", "lb": "lbs pound pounds", "minutes": "minute min mins", "hours": "hour hr hrs", "seconds": "second sec secs", "points": "point pts ppg",
    "rebounds": "rebound reb rpg", "assists": "assist ast apg", "steals": "steal", "blocks": "block", "games": "game", "$": "dollar dollars usd", "%": "percent", "cups": "cup",
    "calories": "calorie kcal", "people": "person user users", "days": "day", "servings": "serving", "items": "item",
}
KEPT_SMALL = ("kg", "lb", "km", "mph", "gb", "tb", "%")
LABELS = (
    "weight|weighs|weighing|rent|rents|utility|utilities|flour|sugar|population|populations|distance|price|prices|cost|costs|tax|taxes|calorie|calories|salary|revenue|income|fare|fee|budget"
    "|height|age|temperature|speed|length|width|area|volume"
)
LABEL_STOP = (
    "a an the of in on for and or with over from his her their its at to by per than that this into during after before about just only played scored recorded had has have was were is are be"
    " been he she they who also notes note under across through while when where"
).split()
CHARS_BEFORE, WORDS_BEFORE = 48, 4

HIT = "array<struct<start:int,end:int,text:string,pass:string>>"


def spans(text: Column, pattern: str, name: str) -> Column:
    """(start, end, text, pass) of all matches of a pattern, places from 0: the parts between matches say where these stand."""
    empty = F.array().cast(HIT)

    def placed(found: Column, parts: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            start = s["at"] + F.length(x["part"])
            hit = F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("text"), F.lit(name).alias("pass"))
            return F.struct((start + F.length(x["hit"])).alias("at"), F.concat(s["hits"], F.array(hit)).alias("hits"))

        pairs = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda p, h: F.struct(p.alias("part"), h.alias("hit")))
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("hits")), step)["hits"]

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: let(F.split(text, pattern), lambda p: placed(f, p)))).otherwise(empty)


def without_overlaps(passes: list[Column]) -> Column:
    """Hits of all passes, by place, without those that overlap a hit of an earlier pass."""
    overlaps = lambda h, k: (h["start"] < k["end"]) & (h["end"] > k["start"])

    def joined(held: Column, more: Column) -> Column:
        return let(held, lambda hs: F.concat(hs, F.filter(more, lambda h: ~F.exists(hs, lambda k: overlaps(h, k)))))

    return F.array_sort(reduce(joined, passes))


def _looked_up(word: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), word)


def canonical_unit(word: Column) -> Column:
    names = {n: unit for unit, others in SAME_UNIT.items() for n in others.split()} | {"years old": "years"}
    return let(F.lower(F.regexp_replace(word, r"\.$", "")), lambda w: F.coalesce(_looked_up(w, names), w))


def pretty_unit(word: Column) -> Column:
    low = F.lower(word)
    short = (F.length(word) <= 4) & (word == F.upper(word)) & word.rlike("[A-Z]")
    return F.when(low.isin(*KEPT_SMALL), low).when(short, word).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1000))))


def label_before(text: Column, start: Column) -> Column:
    """The nearest of the last four words before a place that names a measure; null if there is none."""
    begin = F.greatest(F.lit(0), start - CHARS_BEFORE)
    words = F.regexp_extract_all(F.substr(text, begin + 1, start - begin), F.lit("[A-Za-z][A-Za-z%]*"), F.lit(0))
    near = lambda ws: F.slice(F.reverse(ws), 1, WORDS_BEFORE)
    fits = lambda w: ~F.array_contains(F.array(*map(F.lit, LABEL_STOP)), F.lower(w)) & w.rlike(f"(?i)^(?:{LABELS}|weigh|weighs|weighing)$")
    return let(F.get(F.filter(near(words), fits), F.lit(0)), lambda w: F.when(w.rlike("(?i)^weigh(?:s|ing)?$"), "Weight").otherwise(pretty_unit(w)))


def _amount(raw: Column) -> Column:
    return F.regexp_replace(raw, ",", "").try_cast("double")


def figures(text: Column) -> Column:
    """(start, label, unit, amount, display, clock, rate) of the figures of a text by place: times, then money, then rates, then units before and behind numbers.

    Of figures that say the same only the first is given. Null texts have none.
    """
    passes = [spans(text, p, n) for n, p in (("clock", CLOCK), ("money", MONEY), ("rate", RATE), ("lead", LEAD), ("unit", UNIT))]

    def figure(h: Column) -> Column:
        kind, t = h["pass"], h["text"]
        group = lambda p, i: F.regexp_extract(t, p, i)
        clock_unit = canonical_unit(group(CLOCK, 4))
        seconds = group(CLOCK, 1).cast("double") * 3600 + group(CLOCK, 2).cast("double") * 60 + F.coalesce(group(CLOCK, 3).try_cast("double"), F.lit(0.0))
        rate_name = F.upper(F.concat(group(RATE, 1), group(RATE, 4)))
        scale = lambda s: F.coalesce(_looked_up(F.lower(s), SCALES), F.lit(1.0))
        lead_unit, unit = canonical_unit(group(LEAD, 1)), canonical_unit(group(UNIT, 3))
        near = label_before(text, h["start"])
        amount = (
            F.when(kind == "clock", seconds)
            .when(kind == "money", _amount(group(MONEY, 1)) * scale(group(MONEY, 2)))
            .when(kind == "rate", _amount(F.concat(group(RATE, 2), group(RATE, 3))))
            .when(kind == "lead", _amount(group(LEAD, 2)))
            .otherwise(_amount(group(UNIT, 1)) * scale(group(UNIT, 2)))
        )
        units = F.when(kind == "clock", F.when(clock_unit == "", "time").otherwise(clock_unit)).when(kind == "money", F.substring(t, 1, 1)).when(kind == "rate", rate_name).when(kind == "lead", lead_unit).otherwise(unit)
        label = F.when(kind == "clock", F.when(clock_unit == "", "Time").otherwise(pretty_unit(clock_unit))).when(kind == "money", F.coalesce(near, F.lit("Dollars")))
        label = label.when(kind == "rate", rate_name).when(kind == "lead", pretty_unit(lead_unit)).otherwise(F.coalesce(near, pretty_unit(unit)))
        shown = F.when(kind == "clock", F.regexp_extract(t, r"^\d{1,2}:\d{2}(?::\d{2})?", 0))
        return F.struct(h["start"].alias("start"), label.alias("label"), units.alias("unit"), amount.alias("amount"), shown.alias("clock"), (kind == "rate").alias("rate"))

    def once(fs: Column) -> Column:
        same = lambda a, b: (F.abs(a["amount"] - b["amount"]) <= 0.001) & (a["clock"].isNotNull() == b["clock"].isNotNull()) & (a["unit"] == b["unit"])
        start = F.slice(fs, 1, 0)
        return F.aggregate(fs, start, lambda kept, f: F.when(F.exists(kept, lambda k: same(k, f)), kept).otherwise(F.concat(kept, F.array(f))))

    found = F.filter(F.transform(without_overlaps(passes), figure), lambda f: f["amount"].isNotNull())
    return let(found, lambda fs: F.when(F.size(fs) > 0, once(fs)).otherwise(fs))


# Amounts and breaks between clauses.
PLAIN_MONEY = r"[$£€¥]\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?"
AMOUNT = r"(?i)[$£€¥]\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?|\d+(?:\.\d+)?\s*(?:%|percent\b)"
NEXT_AMOUNT = r"(?i)[$£€¥]\s?\d|\d+(?:\.\d+)?\s*(?:%|percent\b)"
BREAK = r"[\n|;•·・]|(?<!\.[A-Za-z])\.(?=\s|$)"
ADDON = r"(?i)\b(?:add-?on|optional|extra|additional|expedited|expedite|rush|surcharge)\b"


def _last_end(text: Column, pattern: str) -> Column:
    """The place behind the last match, 0 if there is none, and whether there is one."""
    return F.coalesce(F.try_element_at(spans(text, pattern, ""), F.lit(-1))["end"], F.lit(-1))


def money_clauses(text: Column) -> Column:
    """(figure, value, line) of every amount of money with the clause that names it: after the amount before it, and up to the next one.

    A clause ends at a line end, a bar, a semicolon, a dot or a full stop (not the one of U.S.), 48 characters behind the
    amount at the latest; without an amount before it begins 80 characters before, or at a break within 180.
    """

    def clause(h: Column, breaks: Column) -> Column:
        before = F.substr(text, F.lit(1), h["start"])
        after = F.substr(text, h["end"] + 1, F.length(text))

        def begin(prev: Column, stop: Column) -> Column:
            with_prev = F.when(stop > prev, stop).otherwise(h["start"])
            alone = F.when((stop >= 0) & (h["start"] - stop + 1 < 180), stop).otherwise(F.greatest(F.lit(0), h["start"] - 80))
            return F.when(prev >= 0, with_prev).otherwise(alone)

        last_break = F.coalesce(F.try_element_at(F.filter(breaks, lambda b: b["end"] <= h["start"]), F.lit(-1))["end"], F.lit(-1))
        start = let(_last_end(before, AMOUNT), lambda prev: let(last_break, lambda stop: begin(prev, stop)))
        first = lambda p: F.coalesce(F.nullif(F.regexp_instr(after, F.lit(p)), F.lit(0)) - 1, F.length(after))
        tail = F.least(first(NEXT_AMOUNT), first(BREAK), F.lit(48))
        line = let(start, lambda s: F.substr(text, s + 1, h["end"] - s + tail))
        figure = F.regexp_replace(h["text"], r"\s", "")
        return F.struct(h["start"].alias("start"), figure.alias("figure"), F.regexp_replace(figure, r"[^\d.]", "").try_cast("double").alias("value"), F.trim(F.regexp_replace(line, r"\s+", " ")).alias("line"))

    found = let(spans(text, BREAK, ""), lambda breaks: F.transform(spans(text, PLAIN_MONEY, ""), lambda h: clause(h, breaks)))
    return F.filter(found, lambda c: c["value"].isNotNull())


def lead_figures(texts: DataFrame, key: str, question: str, text: str, words: str) -> DataFrame:
    """(key, figure, value, line, score): per question the amount whose clause is most about it, if the score is 4 or more; the first on ties.

    `words` is the array of the question's subject words. Each counts 3 in the clause and 2 within 28 characters of the
    amount; a clause about an extra that wasn't asked for loses 8, one that joins items by `and` 6.
    """
    rows = texts.select(key, question, words, text, F.explode(money_clauses(F.col(text))).alias("c_"))
    lone = F.regexp_replace("c_.line", r"\s", "")
    near = F.lower(F.concat(F.substr(text, F.greatest(F.lit(1), F.col("c_.start") - 27), F.least(F.lit(28), F.col("c_.start"))), F.lit(" "), F.substr(text, F.col("c_.start") + F.length("c_.figure") + 1, F.lit(28))))
    low = F.lower("c_.line")
    score = F.lit(1) + F.aggregate(words, F.lit(0), lambda n, w: n + F.when(F.contains(low, w), 3).otherwise(0) + F.when(F.contains(near, w), 2).otherwise(0))
    score = score - F.when(~F.col(question).rlike(ADDON) & F.col("c_.line").rlike(ADDON), 8).otherwise(0)
    score = score - F.when(F.col("c_.line").rlike(r"(?i)\band\s+[a-z]") & ~F.col(question).rlike(r"(?i)\band\b"), 6).otherwise(0)
    scored = rows.where(F.length(lone) > 0).withColumn("score", score).where("score >= 4")
    best = scored.groupBy(key).agg(F.min_by(F.struct("c_.figure", "c_.value", "c_.line", "score"), F.struct(-F.col("score"), "c_.start")).alias("b_"))
    return best.select(key, "b_.*")
