"""Figures in text as rows, and arithmetic over them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NUMBER = re.compile(r"\d(?:[\d,]*\d)?(?:\.\d+)?")
WORD = re.compile(r"[ \t\u00a0-]?(%|°[CF]?|[A-Za-z]+)")
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
SCALES = {
    "hundred": 1e2,
    **dict.fromkeys(("k", "thousand"), 1e3),
    **dict.fromkeys(("m", "mn", "million", "millions"), 1e6),
    **dict.fromkeys(("b", "bn", "billion", "billions"), 1e9),
    **dict.fromkeys(("tn", "trillion", "trillions"), 1e12),
}
#: Letters that scale an amount of money and nothing else: 5 m is a length.
MONEY_SCALES = frozenset({"k", "m", "b"})
UNITS = {
    name: unit
    for unit, names in {
        "money": "dollar dollars usd eur euro euros gbp pound-sterling",
        "percent": "% percent pct",
        "mi": "mi mile miles",
        "km": "km kilometer kilometers kilometre kilometres",
        "m": "m meter meters metre metres",
        "ft": "ft foot feet",
        "in": "inch inches",
        "kg": "kg kilogram kilograms kilo kilos",
        "lb": "lb lbs pound pounds",
        "mg": "mg milligram milligrams",
        "g": "g gram grams",
        "oz": "oz ounce ounces",
        "hour": "h hr hrs hour hours",
        "minute": "min mins minute minutes",
        "second": "sec secs second seconds",
        "day": "day days",
        "week": "week weeks",
        "month": "month months",
        "year": "yr yrs year years",
        "people": "people persons person",
        "celsius": "°c celsius",
        "fahrenheit": "°f fahrenheit",
        "degree": "° degree degrees",
        "points": "pt pts point points",
        "gb": "gb gigabyte gigabytes",
        "mph": "mph",
    }.items()
    for name in names.split()
}
#: What a bare number may be named by, when it stands before it.
LABELS = frozenset("price cost total fee rate tax weight height length distance population revenue score age salary budget speed temperature average sum share".split())
LABEL_REACH = 48


def label_before(text: str, at: int) -> str | None:
    """The nearest measure word within LABEL_REACH characters before a place, in the same sentence."""
    words = re.findall(r"[a-z]+|[.!?;](?=\s)", text[max(0, at - LABEL_REACH) : at].lower())
    for w in reversed(words):
        if not w.isalpha():
            return None
        if w in LABELS or w.removesuffix("s") in LABELS:
            return w if w in LABELS else w.removesuffix("s")
    return None


def word_after(text: str, at: int) -> tuple[str, int]:
    """The word or sign that follows a place, in lower case, and its end; '' if there is none."""
    m = WORD.match(text, at)
    return (m.group(1).lower(), m.end()) if m else ("", at)


def figures_of(text: str) -> list[tuple[int, str, float, str, str | None]]:
    """(start, unit, amount, display, label) of a text's figures, in order.

    A number is read with what stands beside it: a currency sign before it, then a scale, then a unit behind it; hour
    and minutes with a colon are a time of day. A number without any of these counts if a label stands before it.
    """
    found, at = [], 0
    while m := NUMBER.search(text, at):
        start, end = m.span()
        at = end
        if start and (text[start - 1].isalnum() or text[start - 1] in "._"):
            continue
        minutes = text[end + 1 : end + 3]
        if text[end : end + 1] == ":" and len(minutes) == 2 and minutes.isdigit() and not text[end + 3 : end + 4].isdigit() and m.group().isdigit() and int(m.group()) < 24 and int(minutes) < 60:
            word, after = word_after(text, end + 3)
            half = {"am": 0, "pm": 12}.get(word)
            hour = int(m.group()) if half is None else int(m.group()) % 12 + half
            at = end + 3 if half is None else after
            found.append((start, "clock", hour * 60.0 + int(minutes), text[start:at], label_before(text, start)))
            continue
        amount, unit = float(m.group().replace(",", "")), None
        sign = start - 1 - (text[start - 1 : start] == " ")
        if sign >= 0 and text[sign] in CURRENCIES:
            unit, start = "money", sign
        word, after = word_after(text, end)
        if word in SCALES and (unit == "money" or word not in MONEY_SCALES):
            amount, at = amount * SCALES[word], after
            word, after = word_after(text, after)
        if unit is None and word in UNITS:
            unit, at = UNITS[word], after
        label = label_before(text, start)
        if unit or label:
            found.append((start, unit or "number", amount, text[start:at], label))
    return found


def read_figures(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, unit, amount, display, label). What a number means hangs on what is beside it, so a text is read in Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *f) for k, t in zip(batch[key], batch[text]) if isinstance(t, str) for f in figures_of(t)]
            yield pd.DataFrame(rows, columns=[key, "start", "unit", "amount", "display", "label"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, start int, unit string, amount double, display string, label string")


def combined(figures: DataFrame, key: str, unit: str, amount: str) -> DataFrame:
    """Per key and unit: number, sum, mean, and difference of the largest and the smallest."""
    a = F.col(amount)
    return figures.groupBy(key, unit).agg(F.count("*").alias("n"), F.round(F.sum(a), 4).alias("total"), F.round(F.avg(a), 4).alias("mean"), F.round(F.max(a) - F.min(a), 4).alias("spread"))


def largest_measure(figures: DataFrame, key: str, unit: str, least: int = 2) -> DataFrame:
    """Per key the unit with most figures, at least `least`; the first by name on ties."""
    counts = figures.groupBy(key, unit).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    w = Window.partitionBy(key).orderBy(F.desc("n"), unit)
    return counts.withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")


def first_distinct(figures: DataFrame, key: str, unit: str, amount: str, position: str, tolerance: float = 0.001) -> DataFrame:
    """Figures, in order, that are not within a tolerance of one kept before them, of their key and unit.

    What goes shields nothing: of 1.0, 1.0009 and 1.0018 the last stays. A key is one text; its figures are folded in an array.
    """
    rest = [c for c in figures.columns if c not in (key, unit, amount, position)]
    row = F.struct(F.col(position).alias("p_"), F.col(amount).alias("a_"), *rest)
    rows = F.array_sort(F.collect_list(row)).alias("rows_")
    grouped = figures.groupBy(key, unit).agg(rows)
    near = lambda kept, x: F.exists(kept, lambda k: F.abs(k["a_"] - x["a_"]) <= tolerance)
    kept = F.aggregate("rows_", F.slice("rows_", 1, 0), lambda out, x: F.when(near(out, x), out).otherwise(F.concat(out, F.array(x))))
    flat = grouped.select(key, unit, F.explode(kept).alias("r_"))
    return flat.select(key, unit, F.col("r_.p_").alias(position), F.col("r_.a_").alias(amount), *(F.col(f"r_.{c}").alias(c) for c in rest)).select(figures.columns)


def pick_scored(candidates: DataFrame, key: str, scores: dict[str, float], tie: str) -> DataFrame:
    """Per key the candidate whose flags weigh most; flags are boolean columns."""
    score = sum((F.when(F.col(flag), F.lit(weight)).otherwise(F.lit(0.0)) for flag, weight in scores.items()), F.lit(0.0))
    w = Window.partitionBy(key).orderBy(F.desc("score"), tie)
    return candidates.withColumn("score", score).withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")


def compared(rows: DataFrame, side: str, sides: list[str], label: str, value: str) -> DataFrame:
    """A comparison table: a row for each label, a column for each side; a side without rows is null."""
    return rows.groupBy(label).pivot(side, sides).agg(F.round(F.avg(value), 2))


def estimated_cost(calls: DataFrame, prices: DataFrame, key: str, engine: str, n: str, price: str) -> DataFrame:
    """Per key the calls and what they cost by list price; engines without a price cost nothing."""
    priced = calls.join(prices, engine, "left")
    return priced.groupBy(key).agg(F.sum(n).alias("calls"), F.round(F.sum(F.col(n) * F.coalesce(price, F.lit(0.0))), 6).alias("cost"))
