"""Scalar functions over numbers, money and dates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, places: int = 2) -> Column:
    """Halves go up, also below zero."""
    scale = 10**places
    return F.floor(x * F.lit(float(scale)) + F.lit(0.5)) / F.lit(float(scale))


def monthly_total(amount: Column, seats: Column, per_seat: Column, yearly: Column, least_seats: Column) -> Column:
    """What a plan costs a month: by seats (a least number of them) or flat, a twelfth if billed by year; null without an amount."""
    base = F.when(per_seat, amount * F.greatest(seats, F.coalesce(least_seats, F.lit(1)))).otherwise(amount)
    return round_half_up(F.when(yearly, base / F.lit(12.0)).otherwise(base))


def range_change(price: Column, base: Column) -> tuple[Column, Column]:
    """Amount and percentage by which a price is off its base; null percentage on a base of zero."""
    return round_half_up(price - base), F.when(base != 0, round_half_up((price - base) / base * F.lit(100.0)))


def completed_years(start: Column, end: Column) -> Column:
    """Full years between two dates: one less before the day of the year comes."""
    before = (F.month(end) * 100 + F.dayofmonth(end)) < (F.month(start) * 100 + F.dayofmonth(start))
    return F.year(end) - F.year(start) - F.when(before, 1).otherwise(0)


def ttl_seconds(tier: Column) -> Column:
    """How long an answer of a freshness tier may be served; unknown tiers like the longest."""
    return F.when(tier == "live", 30).when(tier == "hour", 300).when(tier == "day", 10800).otherwise(86400)


def month_label(date: Column) -> Column:
    return F.date_format(date, "MMM yyyy")


def parsed_date(text: Column, as_of: Column) -> Column:
    """The day that "3 weeks ago", "Oct 7, 2026" or an ISO date (with or without a time) means; null for anything else."""
    low = F.lower(F.trim(text))
    n = F.regexp_extract(low, "^(\\d{1,4}) +(minute|hour|day|week|month|year)s? +ago$", 1).try_cast("int")
    unit = F.regexp_extract(low, "^(\\d{1,4}) +(minute|hour|day|week|month|year)s? +ago$", 2)
    day = F.to_date(as_of)
    back = F.when(unit.isin("minute", "hour"), day).when(unit == "day", F.date_sub(day, n)).when(unit == "week", F.date_sub(day, n * 7))
    back = back.when(unit == "month", F.add_months(day, -n)).when(unit == "year", F.add_months(day, -12 * n))
    named = F.to_date(F.try_to_timestamp(F.trim(text), F.lit("MMM d, yyyy")))
    iso = F.regexp_extract(text, "^\\s*(\\d{4}-\\d{2}-\\d{2})", 1).try_cast("date")
    return F.coalesce(back, named, iso)
