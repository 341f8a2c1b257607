"""Scalar functions over names, identifiers, dates and amounts on literals."""

import datetime

import pytest
from pyspark.sql import functions as F

from fathomlake.functions import hosts, reading
from fathomlake.operators import usage


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expr(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


CASES = [
    (reading.initials, {"Dr. Ada Lovelace": "AL", "Martin Luther King Jr.": "MK", "Ana de la Cruz, Ph.D.": "AC", "Prof.": "P", "plato": "P", "J. R. Tolkien MD": "JT", "…": "", "Sam Do": "SD", "élan (vital)": "ÉV"}),
    (reading.title_query, {"the lord of the rings": "The Lord of the Rings", "mcdonald menu": "McDonald Menu", "iPhone  vs pixel": "iPhone vs Pixel", "NASA": "Nasa", "": ""}),
    (reading.title_subject, {"Empire State Building Height": "Empire State Building", "Nintendo Switch 2 Price With Tax": "Nintendo Switch 2", "Price list": "Price list", "": ""}),
    (reading.vowel_swap, {"bleuflame": "blueflame", "cat": "", "Aeon": "eaon", "bookie": "bookei"}),
    (reading.file_words, {"https://a.org/b/kobo-clara_bw.jpg?x=1": "kobo clara bw jpg", "My%20File.png": "My File png"}),
    (reading.identifiers_in, {"See https://doi.org/10.1/ab). arXiv: 2101.00001v2, 10.1000/X-y.": ["https://doi.org/10.1/ab", "arxiv:2101.00001v2", "10.1000/x-y"], "": []}),
    (reading.record_key, {"https://doi.org/10.1111/X.": "10.1111/x", "arxiv:2101.00001v2": "2101.00001", "Other": "other"}),
    (reading.normalize_arxiv, {"arXiv:2101.12345v3": "2101.12345", "https://arxiv.org/pdf/1901.01234v2.pdf": "1901.01234", "hep-th/9901001": "hep-th/9901001", "x": None}),
    (reading.years_of, {"2025-26, 1999/2003 and 1998-02": [1998, 1999, 2002, 2003, 2025, 2026], "12020": []}),
    (reading.months_in, {"It may rain in march": [3], "Since May 2020, 2024-11-05 and 7/4/21": [5, 7, 11], "dec 3": [12], "decide": []}),
    (reading.as_of_label, {"2026-10-07T1": "Oct 7, 2026", "October 2024": "October 2024", "3 days ago": None}),
    (reading.canonical_unit, {"Lbs.": "lb", "years old": "years", "Furlong": "furlong"}),
    (reading.join_spaced_decimals, {"1. 5°C and 2. 25": "1.5°C and 2.25", "End. 5": "End. 5"}),
    (lambda t: reading.billing_near(t, F.lit("7.50")), {"$7.50 per month, billed annually": "annual", "$7.50 month to month $9 billed yearly": "monthly", "17.50 a year": None, "$7.50": None}),
    (hosts.fetchable, {"https://a.org": True, "http://a.org:8080/": False, "https://u@a.org/": False, "http://10.0.0.1/": False, "http://localhost/": False, "https://x.pages.dev": False, "ftp://a.org": False}),
    (hosts.blocked, {"https://pornozavr.net": True, "https://essex.ac.uk/": False, "https://a.org/nude/1": True, "https://newlibraryjgza.web.app": True, "https://docs.web.app": False}),
    (lambda u: hosts.tier(hosts.host_of(u)), {"https://en.wikipedia.org/x": 0, "https://dnr.state.mn.us": 0, "https://www.wired.com": 1, "https://me.blogspot.com": 3, "https://a.org": 2, "": 2}),
]


@pytest.mark.parametrize(("rule", "cases"), CASES, ids=range(len(CASES)))
def test_function(spark, rule, cases):
    assert dict(zip(cases, column(spark, list(cases), rule))) == cases
    column(spark, [None], rule)


def test_amounts(spark):
    row = spark.range(1).select(
        reading.format_money(F.lit(1234.5), F.lit("USD")), reading.format_money(F.lit(-7.0), F.lit("USD")), reading.format_money(F.lit(1234.5), F.lit("EUR")), reading.price_text(F.lit(0.0123)), reading.parse_amount(F.lit("1,200"), F.lit("Million")),
        reading.century_of(F.lit(2011)), reading.century_of(F.lit(1100)), reading.softmax(F.array(F.lit(1.0), F.lit(1.0))), reading.weighted_cost(F.lit(0), F.lit(0), F.lit(1), F.lit(1)), reading.next_midnight(F.lit("2024-02-28 10:00:00").cast("timestamp")),
    ).first()
    assert list(row) == ["$1,234.50", "-$7", "1,234.5 EUR", "0.0123", 1.2e9, "the 21st century", "the 11th century", [0.5, 0.5], 0, datetime.datetime(2024, 2, 29)]


def test_counters(spark):
    """A counter with shares rises only when it admits; starts keep their distance."""
    at = lambda n: datetime.datetime(2024, 1, 1, 0, 0, n)
    rows = [(i, at(i), "x", 10, 0.5 if i < 20 else 1.0) for i in range(26)] + [(100 + i, at(i), "y", None if i % 2 else 0, 1.0) for i in range(4)] + [(200 + i, at(i), "z", 1, 0.1) for i in range(3)]
    df = spark.createDataFrame(rows, "n int, ts timestamp, k string, cap int, share double")
    got = {r.n: r.admitted for r in usage.share_limited(df, ["k"], "ts", "n", "cap", "share").collect()}
    assert [n for n in range(26) if got[n]] == [0, 1, 2, 3, 4, 20, 21, 22, 23, 24]
    assert [got[100 + i] for i in range(4)] == [False, True, False, True] and [got[200 + i] for i in range(3)] == [True, False, False]
    starts = {r.n: r.start for r in usage.spaced_starts(df.where("k = 'z'"), "k", "ts", "n", 3_000_000).collect()}
    assert starts == {200: at(0), 201: at(3), 202: at(6)}


def test_initials_name_their_words_once(spark):
    frame = spark.range(1).select(reading.initials(F.concat(F.lit("Dr. Ada "), F.col("id")).cast("string")).alias("x"))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("Dr. Ada ") == 1
