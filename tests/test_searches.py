"""Searches made of questions: literals, and whole tables beside plain Python that walks words instead of columns."""

import re

import pytest
from pyspark.sql import functions as F

from fathomlake.functions import searches as s
from fathomlake.plans import searches as plans

SF = "/root/testdata/sf0.001"


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expr(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


CASES = [
    (s.without_repeated_lead, {"Which Is Better Value: which is better value: a or b": "which is better value: a or b", "a b a b": "a b a b", "x y z x y z": "x y z", " ": "", None: None}),
    (s.peel_frame, {"pros and cons: pros and cons of heat pumps": "heat pumps", "how to": "how to", "should i lease a car": "lease a car", "": ""}),
    (lambda q: s.sanitized(q, F.lit("Solar guide energy.gov")), {"Blueflame AI Blueflame AI at Datasite": "Blueflame AI at Datasite", "solar panels energy.gov": "solar panels", "solar panels Energy": "solar panels", "energy.gov": "energy.gov", "news site:nhl.com, now.": "news site:nhl.com now", "": ""}),
    (s.relaxed, {"Jalen Hurts injury report latest": "Jalen Hurts", "why $rdw drops": "RDW stock", "cold widgets for promo news": "cold widgets for promo", "A B C D E F G": "A B C D E F", "news": ""}),
    (s.entity_query, {"Who is Ada Lovelace of London?": "Ada Lovelace", "what are cats": "", "The Big Red Fox Jumps High": "The Big Red Fox", "site:x.org Ada": "Ada"}),
    (s.compare_sides, {
        "Compare the iPhone 17, Pixel 10 and Galaxy S25": ["iPhone 17", "Pixel 10", "Galaxy S25"], "Phones: iPhone 17 vs Pixel 10": ["iPhone 17", "Pixel 10"], "compare Harbor and Plank side by side: price and storage": ["Harbor", "Plank"],
        "Fitbit Edge vs Mi Band 10 specs": ["Fitbit Edge", "Mi Band 10"], "Make a table comparing A1 and a traditional IRA for 2026": ["A1", "traditional IRA"], "weather": [], "": [], None: [],
    }),
    (lambda q: s.side_queries(q, s.compare_sides(q)), {"AJ vs 2026 NBA rookies vs past draft classes": ["2026 NBA rookies", "NBA past draft classes", "AJ"], "a1 vs b1": ["b1", "a1"], "x": []}),
    (lambda q: s.compare_count(s.compare_sides(q)), {"a1 vs b1 vs c1 vs d1 vs e1": 4, "a1 vs b1 vs c1": 3, "x": 2}),
    (s.split_entities, {"iPhone 17 vs Pixel 10, which is better for gaming?": ["iPhone 17", "Pixel 10"], "which Kobo or kobo or Kindle": ["Kobo", "Kindle"], "Kobo or Kindle": [], "cats vs dogs": []}),
]


@pytest.mark.parametrize(("rule", "cases"), CASES, ids=range(len(CASES)))
def test_rule(spark, rule, cases):
    assert dict(zip(cases, column(spark, list(cases), rule))) == cases


def test_nulls_and_empty_texts(spark):
    for rule, _ in CASES:
        column(spark, [None, "", " ", ",", "x" * 50_000], rule)


def test_subjects(spark):
    want = {
        "jaylen brown injuries": ("jaylen brown", "injuries", "sports"), "why is $rdw dropping today": ("RDW", "dropping today", "ticker"), "RDW stock price": ("RDW", "stock price", "ticker"),
        "who is Ada Lovelace?": ("Ada Lovelace", "", "person"), "how to bake bread": ("bake bread", "", "general"), "news": ("news", "", "general"), "": ("", "", "general"),
    }
    assert dict(zip(want, map(tuple, column(spark, list(want), s.subject_of)))) == want


def peeled(text):
    out = " ".join(text.split())
    for _ in range(4):
        words = out.split(" ")
        plain = [re.sub(r"[:?.!,]+$", "", w.lower()) for w in words]
        twice = [n for n in range(3, len(words) // 2 + 1) if plain[:n] == plain[n : 2 * n]]
        rest = " ".join(re.sub(s.FRAME, "", " ".join(words[twice[0] :] if twice else words)).split())
        if not rest or rest == out:
            break
        out = rest
    return out


def subject(text):
    text = re.sub(r"[?!.]+$", "", peeled(text))
    bare = text
    for _ in range(3):
        bare = re.sub(s.LEAD, "", bare)
    if m := re.search(s.TICKER, bare):
        rest = bare[: m.start()] + " " + bare[m.end() :]
        return m[1].upper(), " ".join(w for w in rest.split() if w.lower() in s.TAIL), "ticker"
    words, topic = bare.split(), []
    while len(words) > 1 and words[-1].lower() in s.TAIL:
        topic.insert(0, words.pop())
    return " ".join(words), " ".join(topic), text


def test_subjects_of_all_questions(spark):
    asked = {(r.conv_id, r.turn): r.ask for r in plans.questions(spark, SF).collect()}
    got = {(r.conv_id, r.turn): r for r in plans.ask_subject_topics(spark, SF).collect()}
    assert got.keys() == asked.keys() and {r.kind for r in got.values()} == {"ticker", "sports", "person", "general"}
    for k, ask in asked.items():
        name, topic, rest = subject(ask)
        if rest != "ticker":
            market = re.fullmatch("[A-Z]{2,5}", name) and any(re.search(s.MARKET, t, re.I) for t in topic.split())
            rest = "ticker" if market else "sports" if re.search(s.SPORTS, ask, re.I) else "person" if re.search(s.WHO, rest, re.I) else "general"
        assert (got[k].peeled, got[k].subject, got[k].topic, got[k].kind) == (peeled(ask), name, topic, rest)


def test_sides_of_all_questions(spark):
    rows = plans.ask_sides(spark, SF).collect()
    asked = {(r.conv_id, r.turn): r.ask for r in plans.questions(spark, SF).collect()}
    assert len(rows) == len(asked) and {r.n for r in rows} == {2, 3, 4}
    for r in rows:
        sides = [x for x in r.sides.split("|") if x]
        assert r.n == min(max(len(sides), 2), 4) and len(sides) != 1
        assert all(x in re.sub(r"\s+", " ", asked[r.conv_id, r.turn]) or "\n" in x for x in sides)
        found = [x for x in r.searches.split("|") if x]
        assert [re.sub("^NBA ", "", x) for x in found] == ([*sides[1:3], sides[0]] if sides else []) or "NBA" in r.sides
