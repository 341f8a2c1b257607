"""Question rules on literals; the same rules are compared with SQL over all questions in test_queries."""

import time

import pytest
from pyspark.sql import functions as F

from fathomlake.functions import asks


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expr(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


CASES = [
    (asks.route, {"solar vs wind": "deep", "Lions vs Bears score": "quick", "one? two?": "deep", "pizza near me": "quick", "why does ice float": "deep"}),
    (asks.layout, {"weather in Oslo": "spotlight", "best phones": "ranked", "what is Ada Lovelace": "profile", "what is a neuron": "explainer", "temperature of the sun": "spotlight", "what is temperature": "explainer", "fix this bug": "code", "zebra": "answer"}),
    (asks.operation, {"points per game": "rate", "the mean of it": "average", "3 times 4": "product", "and?": "bare"}),
    (asks.category, {"should I lease or buy": "decision", "buy a bike": "shopping", "hm": "other"}),
    (asks.is_shopping, {"best hdmi cable": True, "best ways to sleep": False, "find a tv under $400": True, "what is best": False, "best sales tax": False}),
    (asks.split_count, {"split it three ways": 3, "my wife and I share it": 2, "my son and our dog and me": 3, "the 4 of us": 4, "both of us": 2, "alone": None}),
    (asks.budget_amounts, {"under $1,200 or below 300.50": [1200, 300], "none": []}),
    (asks.seats, {"a 3-person agency": 3, "team of 12": 12, "40 engineers": 40, "0 users": None, "seven": None}),
    (asks.bare_term, {" Mercury ": "Mercury", "two words": None, "ab": None}),
    (asks.asked_specs, {"4-port hub for 3 devices, 2.0 inches and 4 ports": ["4 port", "3 device", "2 inch"]}),
    (asks.introduced_names, {"Does Zurich have a Lake?": ["Zurich", "Lake"], "What about Google": ["Google"], "what now": [], "NASA and Xi": ["NASA"]}),
    (asks.cashtags, {"why $rdw and $NVDA, $rdw? a$b $toolong": ["rdw", "nvda"]}),
    (asks.expand_cashtags, {"why $rdw dropping": "why RDW stock dropping", "$rdw shares!": "RDW shares!", "costs $5": "costs $5"}),
    (asks.ticker_queries, {"$a $b $c": ["A stock news today", "B stock news today"]}),
    (asks.without_loose_one, {"Ricky Cheuk one bleuflame": "Ricky Cheuk bleuflame", "Capital One card": "Capital One card", "one": "one", "One Direction": "One Direction"}),
    (asks.diagram, {"flowchart of the water cycle": "flow", "explain how a jet engine works": "concept", "how to draw": None, "cats vs dogs diagram": "concept"}),
    (lambda q: asks.with_place(q, F.lit(" Bergen ")), {"weather": "weather in Bergen", "What's the weather like today?": "What's the weather like today in Bergen", "weather in Oslo": "weather in Oslo", "Oslo weather": "Oslo weather"}),
    (lambda q: asks.model_conflict(q, F.lit("Xiaomi Mi Band 8 review, 20 hours")), {"Mi Band 11": True, "Mi Band 8": False, "Pixel 11": False, "20 hours": False}),
    (lambda q: asks.gap_query(q, F.lit("example.org"), 40), {"a  b": "a b site:example.org", "x" * 60: "x" * 23 + " site:example.org", "a site:example.org": "a site:example.org"}),
    (lambda q: asks.covered_by(q, F.lit("the phone"), F.lit("It has a battery of 20 hours")), {"what about batteries": False, "phone hours": True, "tell me more": True, "battery": True}),
    (lambda q: asks.fact_kind(q), {"how much is the tax": "levy", "battery life": "spec", "exact words of the fee": "quote", "hello": None}),
    (lambda q: asks.cache_tier(q, F.lit("week")), {"weather": "live", "scores": "short", "hello": "medium"}),
]


@pytest.mark.parametrize(("rule", "cases"), CASES, ids=range(len(CASES)))
def test_rule(spark, rule, cases):
    assert dict(zip(cases, column(spark, list(cases), rule))) == cases


def test_nulls_and_empty_texts(spark):
    for rule, _ in CASES:
        column(spark, [None, "", " "], rule)


def test_words_end_at_letters_beyond_ascii(spark):
    """As in SQL, "best" stands for itself next to a letter such as ä."""
    assert column(spark, ["bestä shoes", "übest shoes", "bests"], asks.layout) == ["ranked", "ranked", "answer"]
    assert column(spark, ["bestä", "bests"], asks.category) == ["shopping", "other"]
    assert column(spark, ["bestö phone", "bests phone"], asks.is_shopping) == [True, False]


def test_words_of_long_texts_are_cut_once(spark):
    """A text of 8,000 words, half of them numbers of models, against one that names others: its words aren't cut again for each word."""
    rows = spark.createDataFrame([("band 8 " * 4_000, "band 9 " * 4_000)], "q string, t string")
    began = time.time()
    got = rows.select(F.size(asks.model_mentions(F.col("q"))).alias("n"), asks.model_conflict(F.lit("Band 8"), F.col("t")).alias("other"), F.length(asks.without_loose_one(F.col("q"))).alias("left")).first()
    assert (got.n, got.other, got.left) == (4_000, True, 27_999) and time.time() - began < 10
