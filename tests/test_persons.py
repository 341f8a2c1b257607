"""Signs of persons on literals; clusters under refusals against plain union-find; quotations against all pairs."""

import itertools
import random
import re
import time

import pytest

from pyspark.sql import functions as F

from fathomlake.functions import people as signs
from fathomlake.operators import entities, people, quotations
from fathomlake.plans import persons

ROWS = [
    ("Ray Lee", "Ray Lee (actor)", "Born in Salem. He works at the Blue Door Theatre Company. More text", "https://a.org/x", True, ["actor"], ["salem"], "actor"),
    ("Ray Lee", "Ray Lee Smith", "nothing", "https://a.org", False, [], [], None),
    ("Ray Lee", "Ray K. Lee, Mayor of New Dover. He", "", "https://a.org", True, ["mayor"], ["new dover"], None),
    ("Ray Lee", "Ray Ray Lee", "x", "", False, [], [], None),
    ("Ray Lee", "Ray Lee STATS", "software engineer at U.S. Bank", "", True, ["software engineer", "engineer"], [], None),
    ("Ray Lee", "Ray Lee Foundation", None, None, True, [], [], None),
    ("Lee", "Lee", "Lee", "", False, [], [], None),
    ("Ray Lee", None, None, None, False, [], [], None),
    ("José Núñez", "Jose Nunez", "presidential politician (b. 1979)", "", True, ["president", "politician"], [], None),
]


def test_signals(spark):
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(ROWS)], "i int, name string, title string, snippet string, url string")
    got = {r.i: r.s for r in df.select("i", signs.signals(F.col("name"), F.col("title"), F.col("snippet"), F.col("url")).alias("s")).collect()}
    for i, (_, _, _, _, named, roles, locs, paren) in enumerate(ROWS):
        assert (got[i].has_name, got[i].roles, [v.lower() for v in got[i].locs], got[i].paren) == (named, roles, locs, paren), ROWS[i]
    assert "Blue Door Theatre" in got[0].orgs and {"actor", "salem", "blue", "door", "theatre"} <= set(got[0].sig)


def test_clean_capture(spark):
    cases = {"China. He": "China", "J. Smith Co. Ltd": "J. Smith Co. Ltd", "Wikipedia Page": "", "The": "", "George II": "", "1979": "", "U.S. Bank": "U.S. Bank", "Salem,": "Salem", "A": ""}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.c for r in df.select("v", signs.clean_capture(F.col("v")).alias("c")).collect()} == cases


def plain_clusters(rows):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    strong = {(s, r): v for s, r, *v in rows if v[0]}
    for k in strong:
        parent[k] = k
    for a, b in itertools.combinations(strong, 2):
        va, vb = strong[a], strong[b]
        if a[0] == b[0] and set(va[0]) & set(vb[0]) and all(not x or not y or set(x) & set(y) for x, y in zip(va[1:], vb[1:])):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {(*k, find(k)[1]) for k in strong}


SCHEMA = "scope int, row int, sig array<string>, roles array<string>, places array<string>, parens array<string>"


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_union_find_with_refusals(spark, seed):
    rng = random.Random(seed)
    some = lambda what, n, most: [f"{what}{x}" for x in rng.sample(range(n), rng.randint(0, most))]
    rows = [(i % 6, i, some("w", 9, 2), some("r", 4, 2), some("p", 3, 1), some("q", 2, 1)) for i in range(150)]
    rows += [(7, 900 + i, [f"c{i}", f"c{i + 1}"], [], [], []) for i in range(100)]
    got = people.compatible_clusters(spark.createDataFrame(rows, SCHEMA).repartition(3), "scope", "row", "sig", ["roles", "places", "parens"])
    assert {tuple(r) for r in got.collect()} == plain_clusters(rows)
    assert {r[2] for r in plain_clusters(rows) if r[0] == 7} == {900}


def test_empty_clusters(spark):
    assert people.compatible_clusters(spark.createDataFrame([], SCHEMA), "scope", "row", "sig", ["roles"]).count() == 0


def test_rows_of_small_scopes_are_shuffled_once(spark, monkeypatch):
    """No rounds, each of which left its rows and signals on disk."""
    rows = spark.createDataFrame([(i // 5, i, ["w", f"v{i % 3}"], ["r"] if i % 2 else [], [], []) for i in range(40)], SCHEMA)
    monkeypatch.setattr(entities, "clusters", lambda *_: pytest.fail("rounds"))
    got = people.compatible_clusters(rows, "scope", "row", "sig", ["roles", "places", "parens"])
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert got.count() == 40


@pytest.mark.parametrize("most", [0, 200, 10_000])
def test_folded_and_dealt_scopes_equal_union_find(spark, monkeypatch, most):
    """One scope holds half of the rows; some texts need escapes, some arrays hold or are nulls, which agree with none or with nulls."""
    rng = random.Random(most)
    some = lambda what, n, most: rng.sample([f'{what}"\\{{x}} é\n{x}' for x in range(n)], rng.randint(0, most))
    rows = [(i % 8 if i % 2 else 9, i, some("w", 7, 2), some("r", 4, 2), some("p", 3, 1), some("q", 2, 1)) for i in range(160)]
    rows += [(s, 500 + r, *v) for s, r, *v in rows[::3]]
    monkeypatch.setattr(people, "SCOPE_SIGNALS", most)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = people.compatible_clusters(df, "scope", "row", "sig", ["roles", "places", "parens"])
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain_clusters(rows))
    odd = [(1, 1, ["a", None], [None], [], []), (1, 2, ["b", None], [], [], []), (1, 3, ["a", "a"], [None, "r"], None, None), (1, 4, ["a"], ["s"], [], []), (1, 5, None, [], [], []), (None, 6, ["a"], [], [], [])]
    odd = spark.createDataFrame(odd, SCHEMA)
    got = people.compatible_clusters(odd, "scope", "row", "sig", ["roles", "places", "parens"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 1), (1, 2, 2), (1, 3, 1), (1, 4, 4)]


def test_weak_rows(spark):
    strong = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 3), (1, 4, 3), (2, 9, 9)], "scope int, row int, cluster int")
    weak = spark.createDataFrame([(1, 7), (3, 6), (3, 5)], "scope int, row int")
    got = {tuple(r) for r in people.attach_weak(strong, weak, "scope", "row").collect()}
    assert got == {(1, 1, 1), (1, 2, 1), (1, 3, 3), (1, 4, 3), (2, 9, 9), (1, 7, 1), (3, 5, 5), (3, 6, 5)}


def test_qualified_clusters_take_in_others(spark):
    rows = [
        (1, 1, 1, ["x"], ["explorer", "dover"]), (1, 2, 1, ["x"], None), (1, 3, 3, ["dover", "y"], []), (1, 4, 3, ["z"], None), (1, 5, 5, ["z"], None),
        (1, 6, 6, ["explorer"], ["painter"]), (1, 7, 7, ["painter", "dover"], None), (2, 8, 8, ["explorer"], None),
    ]
    df = spark.createDataFrame(rows, "scope int, row int, cluster int, words array<string>, q array<string>")
    got = {r.row: r.cluster for r in people.merge_qualified(df, "scope", "row", "words", "q").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 1, 8: 8}


def test_person_clusters_hold_each_row_once(spark):
    sf = "/root/testdata/sf0.001"
    named = [r for r in persons.person_signals(spark, sf).collect() if r.has_name]
    got = persons.person_clusters(spark, sf).collect()
    assert sum(r.n_rows for r in got) == len(named) and {r.scope for r in got} == {r.scope for r in named}


def test_nearest_sentences_equal_all_pairs(spark):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(30)]
    docs = [(i, " ".join(" ".join(rng.choices(words, k=rng.randint(1, 14))).capitalize() + rng.choice((".", "!", "\n")) for _ in range(6))) for i in range(40)]
    split = lambda t: [" ".join(s.split()) for part in re.split(r"(?<=[.!?])\s+|\n+", t) for s in [part]]
    bare = lambda t: [w for w in (w.rstrip(".") for w in re.split(r"[^\w%$'.]+", t.lower())) if len(w) > 2]
    sentences = [(i, p, s) for i, t in docs for p, s in enumerate(split(t))]
    quotes = []
    for j, (_, _, s) in enumerate(rng.sample([s for s in sentences if s[2]], 60)):
        w = s.split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(words)
        quotes.append((j, " ".join(w)))
    quotes += [(100, None), (101, ""), (102, quotes[0][1])]
    want = {}
    for j, q in quotes:
        n = len(bare(q or ""))
        found = [(-sum(w in bare(s) for w in bare(q)), i, p, s) for i, p, s in sentences if q and n >= 6 and len(s) <= len(q) * 1.6 + 20]
        if found and -min(found)[0] * 100 >= 85 * n:
            want[j] = min(found)[1:]
    got = quotations.nearest_sentences(spark.createDataFrame(quotes, "j int, q string"), spark.createDataFrame(docs, "i int, t string"), "j", "q", "i", "t")
    assert {r.j: (r.i, r.pos, r.sentence) for r in got.collect()} == want and len(want) > 5
    big, quotations.BROADCAST_WORDS = quotations.BROADCAST_WORDS, 0
    try:
        got = quotations.nearest_sentences(spark.createDataFrame(quotes, "j int, q string"), spark.createDataFrame(docs, "i int, t string"), "j", "q", "i", "t")
        assert {r.j: (r.i, r.pos, r.sentence) for r in got.collect()} == want
    finally:
        quotations.BROADCAST_WORDS = big


def test_whole_quotes(spark):
    sources = [(1, "First thing. The seven long rivers of the north run into a wide and very cold sea. Last."), (2, "Adults need to move for at least two hours each week, they say.")]
    answers = {
        1: ('He wrote "long rivers of the north run" there.', 'He wrote "The seven long rivers of the north run into a wide and very cold sea." there.'),
        2: ("“Adults need to walk for at least two hours each week, they say.” ok", "“Adults need to move for at least two hours each week, they say.” ok"),
        3: ('"None of these words stand in any source" x', "None of these words stand in any source x"),
        4: ('"short one only" and "long rivers … sea of words"', '"short one only" and "long rivers … sea of words"'),
        5: ("no marks", "no marks"),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in answers.items()], "a int, body string")
    got = quotations.whole_quotes(df, spark.createDataFrame(sources, "s int, t string"), "a", "body", "s", "t")
    assert {r.a: r.text for r in got.collect()} == {k: v[1] for k, v in answers.items()}


def test_signals_of_persons_are_not_broadcast(spark):
    """They grow with the rows, and only classes that a word's rows have make any."""
    rows = spark.createDataFrame([(1, i, ["w"], ["r"] if i % 2 else [], [], []) for i in range(4)] + [(2, 9, ["w", "v"], [], [], [])], SCHEMA)
    signals = people.refusing_signals(rows, "scope", "row", "sig", ["roles", "places", "parens"])
    assert "Broadcast" not in signals._jdf.queryExecution().executedPlan().toString()
    assert sorted({r.row for r in signals.collect()}) == [0, 1, 2, 3] and signals.count() == 8


def test_names_with_the_same_words_are_compared_once(spark):
    """Twice 20,000 names of two sets of words, none within the other: pairs of all names would be 400 million."""
    rows = [(1, 2 * i, "Red bolt") for i in range(20_000)] + [(1, 2 * i + 1, "nut big red") for i in range(20_000)] + [(1, -1, "red, BIG"), (1, -2, ""), (2, -3, "red")]
    began = time.time()
    got = entities.drop_covered(spark.createDataFrame(rows, "s int, p int, n string"), "s", "n", "p").select("p").collect()
    assert sorted(r.p for r in got) == sorted(p for _, p, _ in rows if p != -1)
    assert time.time() - began < 20


def test_words_of_sentences_are_cut_once_and_as_before(spark):
    """Stops at the ends of words and trimmed sentences as by one pattern a word and a sentence; words aren't cut again to filter by them."""
    texts = ["Dr. Ab.. c.d . e... .Fgh 12.5% ’tis", "x.\t\n\n y!  Zed.\nabc.\n", "end..", " . ", ""]
    old_words = F.filter(F.transform(F.split(F.regexp_replace(F.lower("t"), "[‘’]", "'"), r"[^\p{L}\p{N}%$'.]+"), lambda w: F.regexp_replace(w, r"\.$", "")), lambda w: F.length(w) > 2)
    marked = F.regexp_replace(F.regexp_replace("t", r"([.!?])[ \t\n\r\f\u000b]+", "$1\u0001"), r"\n+", "\u0001")
    old_sentences = F.transform(F.split(marked, "\u0001"), lambda s: F.trim(F.regexp_replace(s, "[ \\t\\n\\r\\f\\u000b]+", " ")))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select(old_words.alias("a"), quotations.quote_words(F.col("t")).alias("b"), old_sentences.alias("c"), quotations.source_sentences(F.col("t")).alias("d")).collect():
        assert r.a == r.b and r.c == r.d
    plan = quotations.whole_sentences(df, df, "i", "t", "i", "t")._jdf.queryExecution().optimizedPlan().toString()
    sentences = [line for line in plan.splitlines() if "split(lower(translate(sentence" in line and "Filter" in line]
    assert not sentences and plan.count("split(lower(translate(sentence") >= 1
