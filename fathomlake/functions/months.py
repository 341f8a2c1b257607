"""Months in prose that no source states, as columns; known months are bits of a whole number, bit 0 for January."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .reading import ABBREVIATIONS, MAY, MONTHS, months_in
from .text import replaced

# A month as cards write it, with what dates it: a preposition, a part of the month, a day, a year.
_NAMES = "|".join(m.capitalize() for m in MONTHS)
_SHORT = "|".join(m.capitalize() for k, m in enumerate(ABBREVIATIONS) if k != 4)
CLAIM = (
    r"(?:\b(?:in|on|since|from|by|as of|effective|starting)\s+)?(?:\b(?:early|mid-?|late)\s+)?"
    rf"\b(?:{_NAMES}|(?:{_SHORT})\.?(?=\s+\d))(?:\s+\d{{1,2}}(?:st|nd|rd|th)?\b)?(?:,?\s+(?:19|20)\d{{2}}\b)?"
)
PREPOSITION = r"^(?:in|on|since|from|by|as of|effective|starting)\s"


def month_bits(text: Column) -> Column:
    """The months that a text states, as bits; 0 for none and for null."""
    return F.coalesce(F.aggregate(months_in(text), F.lit(0), lambda a, m: a.bitwiseOR(F.call_function("shiftleft", F.lit(1), m.cast("int") - 1))), F.lit(0))


def _month(claim: Column) -> Column:
    word = F.lower(F.regexp_extract(claim, rf"\b({'|'.join(m.capitalize()[:3] for m in MONTHS)})[a-z]*", 1))
    return F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), word).cast("int")


def without_unsourced_months(text: Column, known: Column) -> Column:
    """A text without the months that aren't known; a year behind one stays. May stays where it is no date. One that loses none stays as it is."""

    def claim(x: Column, before: Column, after: Column) -> Column:
        verb = (x == "May") & ~F.concat(F.substring(before, -12, 12), x, F.substring(after, 1, 3)).rlike(MAY)
        year = F.regexp_extract(x, r"((?:19|20)\d{2})$", 1)
        stated = known.bitwiseAND(F.call_function("shiftleft", F.lit(1), _month(x) - 1)) != 0
        return F.when(verb | stated, x).when(year != "", F.concat(F.when(x.rlike(PREPOSITION), "in ").otherwise(""), year)).otherwise("")

    out = replaced(text, CLAIM, claim)
    tidy = out
    for pattern, to in (("\\s+([,.;:)])", "$1"), ("\\(\\s*\\)", ""), ("\\s{2,}", " "), (",\\s*,", ",")):
        tidy = F.regexp_replace(tidy, pattern, to)
    return F.when(out == text, text).otherwise(F.trim(tidy))
