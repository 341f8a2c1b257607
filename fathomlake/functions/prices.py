"""Prices inside prose: stray ones dropped, those above a budget cleared, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .asks import says
from .money import round_half_up
from .text import replaced

# The forms of a price, the words in front of a budget.
PRICE = r"(?<![\w£€])(?:US)?\$\s?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d{1,2})?(?:\s?[kK]\b)?"
BUDGET_BEFORE = r"(?i)(under|below|less than|fewer than|≤|<=|<|up to|max(?:imum)?|budget(?: of)?|cap of|within|over|above|more than)\s*$"
MONEY = r"\$\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?"
CEILING = r"\b(?:under|below|less than|cheaper than|up to|at most)\b"
OFFERED = r"(?i)\b(?:under|below|less than|cheaper than|up to|at most)\s+" + MONEY


def _value(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9.]", "").try_cast("double")


def stated_amount(token: Column) -> Column:
    """The number of "$1,299.99", "US$7" or "$5k"."""
    return round_half_up(_value(token) * F.when(token.rlike("[kK]$"), 1000).otherwise(1))


def without_stray_prices(text: Column, keep: Column) -> Column:
    """A text without its dollar amounts, budgets ("under $50") and the amounts of `keep` aside; one that loses none stays as it is."""
    budget = lambda before: F.substring(before, -24, 24).rlike(BUDGET_BEFORE)
    stays = lambda x, before: budget(before) | F.coalesce(F.array_contains(F.coalesce(keep, F.array().cast("array<double>")), stated_amount(x)), F.lit(False))
    out = replaced(text, PRICE, lambda x, before, after: F.when(stays(x, before), x).otherwise(""))
    tidy = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "[ \\t]{2,}", " "), "\\s+([,.;:])", "$1"), "\\(\\s*\\)", ""))
    return F.when(out == text, text).otherwise(tidy)


def within_budget(text: Column, cap: Column) -> Column:
    """A text without the dollar amounts above a cap, and without "under" in front of them; '' where nothing is left."""
    over = lambda x: F.coalesce(_value(F.regexp_extract(x, f"({MONEY})", 1)) > cap, F.lit(False))
    cut = lambda s, pattern: replaced(s, pattern, lambda x, before, after: F.when(over(x), "").otherwise(x))
    flat = F.regexp_replace(F.regexp_replace(cut(cut(text, OFFERED), MONEY), "\\s{2,}", " "), "\\s+([,.;:])", "$1")
    return F.trim(F.regexp_replace(flat, "^[\\s,·-]+|[\\s,·-]+$", ""))


def chip_within(text: Column, cap: Column) -> Column:
    """A label within a budget; null where it was only an amount above that."""
    kept = within_budget(text, cap)
    gone = (kept == "") | ((kept != F.trim(text)) & ~kept.rlike("[0-9]"))
    return F.when(cap.isNull() | (F.coalesce(text, F.lit("")) == ""), text).when(~gone, kept)


def states_price(text: Column, ceilings: Column) -> Column:
    """Whether a text has a dollar amount that is more than the budget of the question said again."""
    amounts = F.transform(F.regexp_extract_all(text, F.lit(f"({MONEY})"), 1), _value)
    said_again = says(text, CEILING) & F.forall(amounts, lambda x: F.array_contains(ceilings, x))
    return F.coalesce((F.size(amounts) > 0) & ~said_again, F.lit(False))
