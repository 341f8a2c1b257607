"""The relevance gate, fusion and grounding on literals."""

import pytest
from pyspark.sql import functions as F

from fathomlake.operators import entities, fusion, gate, grounding, ranking
from fathomlake.plans import catalogue

TERMS = {
    "Ada Lovelace notes on the engine": {"ada": 3, "lovelace": 3, "notes": 1, "engine": 1},
    "why is $rdw dropping in 2024-25": {"rdw": 3, "dropping": 1, "2024": 2, "2025": 2, "25": 2, "2024 25": 0},
    "NASA budget": {"nasa": 2, "budget": 1},
    "best price": {},
    "new ed chu song": {"chu": 1, "song": 1},
}


def test_terms(spark):
    rows = spark.createDataFrame([(q,) for q in TERMS], "q string")
    got = {r.q: {t.token: t.weight for t in r.t} for r in rows.select("q", gate.terms_of(F.col("q")).alias("t")).collect()}
    for q, want in TERMS.items():
        have = {k: v for k, v in got[q].items() if k not in ("2024 25", "25")}
        assert have == {k: v for k, v in want.items() if k not in ("2024 25", "25")}


def test_forms(spark):
    words = ["printers", "printing", "dropped", "stories", "glass", "cats", "falling"]
    got = [r.f for r in spark.createDataFrame([(w,) for w in words], "w string").select(gate.forms(F.col("w")).alias("f")).collect()]
    assert got == [["printers", "print", "printer"], ["printing", "print"], ["dropped", "dropp", "drop"], ["stories", "story", "storie"], ["glass"], ["cats"], ["falling", "fall"]]


ROWS = [
    # question, title, snippet, passes, hard
    ("Ada Lovelace biography", "Ada Lovelace", "mathematician", True, False),
    ("Ada Lovelace biography", "Lovelace Inc", "a firm", True, False),
    ("Ada Lovelace biography", "Apple pie", "recipe", False, False),
    ("2019 floods", "2012 floods", "long ago", False, True),
    ("2019 floods", "Floods of 2020", "rain", True, False),
    ("Mi Band 11 battery", "Mi Band 8 battery", "lasts", False, True),
    ("Mi Band 11 battery", "Mi Band 11 and Mi Band 8", "battery", True, False),
    ("miband printers sale", "Mi Band printing", "x", True, False),
    ("what is it", "anything", "", True, False),
    ("iPhone 15 price", "iPhone 15 Pro Max price", "", False, True),
    ("iPhone 15 price", "iPhone 15 and iPhone 15 Pro price", "", True, False),
    ("iPhone15 Pro price", "Apple iPhone 15 price", "", False, True),
    ("iPhone 15 price", "Galaxy S24 Ultra price", "iPhone price", True, False),
]


def test_judgement(spark):
    rows = spark.createDataFrame([(i, *r[:3], "https://a.org/") for i, r in enumerate(ROWS)], "id int, q string, title string, snippet string, url string")
    got = {r.id: (r.passes, r.hard) for r in gate.judged(rows, "q", "title", "snippet", "url").collect()}
    assert got == {i: r[3:] for i, r in enumerate(ROWS)}


def test_gate(spark):
    rows = [(1, "Ada Lovelace biography", t, "", u, e) for t, u, e in [
        ("Ada Lovelace", "https://a.org/", ["x"]), ("Lovelace's life", "https://b.org/", ["x"]), ("Apple pie", "https://c.org/", ["x"]), ("Ada Lovelace", "https://pornozavr.net/", ["x"]), ("Pie", "https://w.org/", ["wikipedia"])]]
    rows += [(2, "Ada Lovelace biography", t, "", "https://a.org/", ["x"]) for t in ("Apple pie", "Cherry pie", "Ada Lovelace")] + [(3, "zebra yak xenon", t, "", "https://a.org/", ["x"]) for t in ("yaks", "pies")]
    df = spark.createDataFrame(rows, "k int, q string, title string, snippet string, url string, engines array<string>")
    got = sorted((r.k, r.title) for r in gate.gated(df, "k", "q", "title", "snippet", "url", "engines").collect())
    assert got == [(1, "Ada Lovelace"), (1, "Lovelace's life"), (2, "Ada Lovelace"), (2, "Apple pie"), (2, "Cherry pie")]
    assert gate.gated(df.limit(0), "k", "q", "title", "snippet", "url", "engines").count() == 0


def test_gate_refuses_another_person(spark):
    titles = {"Who is Ray Lee?": {"Ray Lee, actor": 1, "Ray Lee Smith, painter": 0, "Lee Ray": 0, "Ray K. Lee at work": 1}, "Ada Bell": {"Ada Lovelace": 1, "Bell, Ada": 1}, "Ray Lee biography": {"Ray Lee Smith": 1}}
    rows = [(q, q, t, "", "https://a.org/", ["x"]) for q, ts in titles.items() for t in ts]
    df = spark.createDataFrame(rows, "k string, q string, title string, snippet string, url string, engines array<string>")
    got = {(r.k, r.title) for r in gate.of_person(df, "k", "q", "title", "snippet").collect()}
    assert got == {(q, t) for q, ts in titles.items() for t, keep in ts.items() if keep}
    kept = {(r.k, r.title) for r in gate.gated(df, "k", "q", "title", "snippet", "url", "engines").collect()}
    assert ("Who is Ray Lee?", "Ray Lee, actor") in kept and ("Who is Ray Lee?", "Ray Lee Smith, painter") not in kept


@pytest.mark.parametrize(("question", "text", "want"), [("watching injuries", "Watch the injury report", 1.0), ("blueflame news", "All about Bleuflame", 0.5), ("the a", "x", 1.0), ("dropped calls", "drop a call", 1.0)])
def test_coverage(spark, question, text, want):
    assert spark.range(1).select(fusion.coverage(F.lit(question), F.lit(text)).alias("c")).first().c == want


def test_named_sites_lead(spark):
    hosts = ["a.org", "a.org", "a.org", "postgresql.org", "b.org", "wiki.postgresql.org", "postgresql.org", "postgresql.org", "postgresql.org"]
    df = spark.createDataFrame([(1, "PostgreSQL docs", h, i) for i, h in enumerate(hosts)], "k int, q string, host string, pos int")
    got = [r.pos for r in ranking.diversify_named(df, "k", "q", "host", "pos").orderBy("new_position").collect()]
    assert got == [3, 5, 6, 0, 1, 4, 7, 8, 2]


LINES = {
    "It costs $499.99 plus 8.875%, that is $544.36": True,
    "6.5 m against 2.4 m is 2.7 times": True,
    "about 81,942 or 4.3": True,
    "in 2 steps [17]": True,
    "$80.5K": True,
    "a total of 57": False,
    "": True,
}


def test_grounding(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(LINES)], "s int, line int, text string")
    tokens = ["499.99", "8.875", "6.5", "2.4", "81942.16", "4.33", "80500", "23", "34"]
    evidence = spark.createDataFrame([(1, t) for t in tokens] + [(2, "57")], "s int, token string")
    got = {r.line: r.backed for r in grounding.ground_lines(lines, evidence, "s", "line", "text", "token").collect()}
    assert got == dict(enumerate(LINES.values()))


def test_lists_are_dealt_to_more_partitions_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(entities, "TASK_ROWS", 500)
    assert catalogue.result_lists(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 10


def test_best_citation_by_shuffle_is_that_by_broadcast(spark, monkeypatch):
    claims = spark.createDataFrame([(1, "a", t, 3) for t in range(6)] + [(1, "b", 9, 3), (2, "a", 0, 3)], "scope int, claim string, token int, preferred int")
    evidence = spark.createDataFrame([(1, s, t) for s in (2, 3, 4) for t in range(4)] + [(1, 5, 9), (1, 6, 9), (1, 5, 9)], "scope int, source int, token int")
    for most in (500_000, 0):
        monkeypatch.setattr(grounding, "BROADCAST_CLAIMS", most)
        got = grounding.best_citation(claims, evidence, "scope", "claim", "source", "token", "preferred").collect()
        assert sorted(map(tuple, got)) == [(1, "a", 3, 4), (1, "b", 5, 1)]
