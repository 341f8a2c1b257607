"""Near-duplicate groups against all pairs compared outright."""

import random

import duckdb
import numpy as np
import pytest

from fathomlake.llm import ngram_join
from fathomlake.llm.components import components


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((-1 if d is None else d, len(sets[i]), -1 if d is None else least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    line = "this same line stands in very many of the documents here".split()
    texts = [None, "", " \n", "one", "ONE", "two words", "Two\twords", "x " * 30]
    for n in (3, 8, 20, 60, 150):
        for _ in range(4):
            base = [rng.choice(vocabulary) + str(rng.randint(0, 40)) for _ in range(n)]
            if n >= 20:
                base[2:2] = line
            texts.append(" ".join(base))
            for _ in range(rng.randint(0, 9)):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, n // 25))):
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
                texts.append(rng.choice([" ", "\n", "  "]).join(copy))
    rng.shuffle(texts)
    rows = [(None if i % 23 == 5 else i * 3, t) for i, t in enumerate(texts)]
    return rows + rows[-3:]


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (1, 60, 3)])
def test_groups_equal_brute_force(spark, k, percent, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id long, text string, id long, component string").repartition(5)
    got = ngram_join.near_duplicates(docs, k, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got.collect())
    want = brute(rows, k, percent)
    assert have == want
    if k == 5:
        kept = ngram_join.one_of_each(docs, k, percent)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({d for d, _, c in want if d == c and d >= 0})
        assert kept.where("doc_id is null").count() == sum(d is None for d, _ in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(docs).count() == 0
    assert ngram_join.one_of_each(docs).count() == 0


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_small_table_equals_its_oracle(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{path}'")
    want = sorted(con.sql(ngram_join.oracle_sql(3, 90)).fetchall())
    got = ngram_join.near_duplicates(spark.read.parquet(path), 3, 90)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want
    assert any(d != c for d, _, c in want)


def brute_links(rows, k, percent):
    """Links between different texts' sets, by the smallest ids of the sets, and each id's number of links."""
    sets = {}
    for d, t in rows:
        w = words(t)
        own = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else None
        if d is not None and own:
            sets.setdefault(own, []).append(d)
    found, counts = set(), {}
    for a, ids in sets.items():
        beside = [b for b in sets if b != a and 100 * len(a & b) >= percent * len(a | b)]
        found |= {(min(ids), min(sets[b])) for b in beside if min(ids) < min(sets[b])}
        for d in ids:
            counts[d] = counts.get(d, 0) + len(ids) - 1 + sum(len(sets[b]) for b in beside)
    return found, counts


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 90, 4), (2, 70, 5)])
def test_all_links_equal_brute_force(spark, k, percent, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want, counts = brute_links(rows, k, percent)
    got = [(r.a, r.b) for r in ngram_join.links(docs, k, percent)[0].collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5
    assert {r.doc_id: r.n_links for r in ngram_join.with_link_counts(docs, k, percent).collect()} == counts


def test_one_id_with_two_texts_has_the_links_of_both(spark):
    a, b = ("one two three four five six seven eight nine ten", "red green blue white black pink grey brown gold lime")
    docs = spark.createDataFrame([(5, a), (5, b), (6, a + " end"), (7, b + " end"), (8, "alone " * 3)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, 3, 80).collect())
    assert got == [(5, 8, 5), (5, 8, 5), (6, 9, 5), (7, 9, 5), (8, 1, 8)]
    kept = [(r.doc_id, r.text) for r in ngram_join.one_of_each(docs, 3, 80).collect()]
    assert sorted(kept) == [(5, min(a, b)), (8, "alone " * 3)]


def test_very_long_texts(spark):
    rng = random.Random(9)
    long = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    other = list(long)
    for i in range(0, len(other), 400):
        other[i] = "changed"
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long[:30_000])), (4, "short text of five words")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, 3, 90).collect()}
    assert got[1] == (59_998, 1) and got[2][1] == 1 and got[3] == (29_998, 3) and got[4] == (3, 4)


def test_counts_are_of_fixed_size_and_don_t_depend_on_tasks(spark):
    docs = spark.createDataFrame([(i, f"very common words here and number {i % 7} {i}") for i in range(400)], "doc_id long, text string")
    few, many = (ngram_join.document_counts(docs.repartition(n), 2, bits=8) for n in (1, 40))
    assert len(few) == 256 and (few == many).all()
    assert few.sum() == 400 * 7
    order = ngram_join.rare_first(np.array([1 << 56, 2 << 56, 3 << 56], np.uint64), np.array([9, 5, 7, 1] + [0] * 252, np.uint32))
    assert [int(x) >> 56 for x in order] == [3, 1, 2]
