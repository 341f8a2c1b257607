"""Held-out accuracy of the classifiers, and their edge cases."""

import random

import numpy as np
import pytest
from zlib import crc32

from fathomlake.llm import quality, toxicity

EDGES = [None, "", " \n", "x", "é" * 10, "word " * 30000, "!!!", "ALL CAPS!! ALL CAPS!!"]


def corpus(spark, seed=2, n=900):
    rng = random.Random(seed)
    syllables = "an the ing on er ti re ed nd ou ea to it is or es".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 120))]
        toxic, good = int(rng.random() < 0.2), int(rng.random() < 0.7)
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["moron", "Scum", "zarq" + word(), "zarq" + word()]))
        if not good:
            words = rng.choice([[w.upper() + "!!" for w in words], words[:2] * 40, [w + " |" for w in words]])
        toxic = int(any(w.lower().startswith(("moron", "scum", "zarq")) for w in words))
        rows.append((i, " ".join(words), "en", "s", i))
        labels.append((i, good, toxic))
    rows += [(n + k, t, "en", "s", 0) for k, t in enumerate(EDGES)] + [(None, "moron scum idiot trash", "en", "s", 0), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, y long").repartition(3)
    return docs, spark.createDataFrame(labels + [(10_000_000, 1, 0)], "doc_id long, quality int, toxic int"), labels, n


@pytest.mark.parametrize(("module", "column", "modulus", "rest"), [(toxicity, 2, 5, 0), (quality, 1, 3, 1)])
def test_held_out_accuracy(spark, module, column, modulus, rest):
    docs, labels, known, n = corpus(spark)
    got = module.scored(docs, labels).collect()
    assert len(got) == n + len(EDGES) + 2
    truth = {k[0]: k[column] for k in known}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % modulus == rest)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert len({r.score for r in got if r.doc_id == 0}) == 1


def test_filters_keep_columns_and_clean_rows(spark):
    docs, labels, known, _ = corpus(spark)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len({k[0] for k in known if not k[2]} - ids) <= 3 and len({k[0] for k in known if k[2]} & ids) <= 8
    kept = quality.of_quality(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len({k[0] for k in known if k[1]} - ids) <= 6 and len({k[0] for k in known if not k[1]} & ids) <= 6


def test_terms_do_not_depend_on_partitions(spark):
    docs, labels, _, n = corpus(spark)
    docs = docs.where(f"doc_id < {n}").distinct()
    one, many = (toxicity.Toxicity.fit(docs.repartition(k, "doc_id"), labels) for k in (1, 100))
    assert len(one.terms.voter) > sum(map(len, toxicity.LEXICONS))
    assert many.terms == one.terms
    assert np.allclose(many.weights, one.weights) and np.isclose(many.intercept, one.intercept)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_no_rows_or_no_labels(spark, module):
    docs, labels, _, n = corpus(spark, n=30)
    assert module.scored(docs.limit(0), labels).count() == 0
    got = module.scored(docs, labels.limit(0)).collect()
    assert len(got) == 30 + len(EDGES) + 2 and all(0 <= r.score <= 1 for r in got)
    if module is toxicity:
        assert [r.predicted for r in got if r.doc_id is None] == [1]


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.15
    side = toxicity.FOR_TOXIC
    good = rng.random((4000, toxicity.VOTERS)) < np.where(y[:, None] == side, 0.7, 0.03)
    good[:, 1] = good[:, 0]  # two that always agree
    good[:, 2] = rng.random(4000) < 0.3  # one that knows nothing
    votes, counts = np.unique(good, axis=0, return_counts=True)
    on_toxic, on_clean, share, weights = toxicity.label_model(votes.astype(float), counts.astype(float))
    assert abs(share - 0.15) < 0.03 and abs(on_toxic[3] - 0.7) < 0.06 and abs(on_clean[3] - 0.03) < 0.02
    assert weights[0] < 0.6 < weights[3] and abs(on_toxic[2] - on_clean[2]) < 0.06
    p = toxicity.posterior(good.astype(float), on_toxic, on_clean, share, weights)
    assert ((p > 0.5) == y).mean() > 0.99


@pytest.mark.parametrize(
    ("text", "voter"),
    [
        ("scum and scum and again scum", toxicity.REPEATED), ("so they say that you are a moron", toxicity.ADDRESSED), ("what an 1d1ot or m0ron or st*pid thing", toxicity.MASKED),
        ("LOUD WORDS", toxicity.SHOUTING), ("moron, clown, scum", toxicity.SEVERAL), ("one clown in a circus", toxicity.FEW), ("ten to 4the price$$$ and a*b", toxicity.NONE), ("", toxicity.NONE),
    ],
)
def test_patterns_fire(text, voter):
    votes = toxicity.Terms.build([], []).reader()(text)[1]
    assert votes >> voter & 1
    assert (votes >> toxicity.MASKED & 1) == (voter == toxicity.MASKED)


def test_label_model_without_mined_terms(spark):
    docs, labels, known, _ = corpus(spark)
    model = toxicity.Toxicity.fit(docs, labels, mine=False)
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = np.array([model.voted(texts[d]) > 0.5 for d, _, _ in known])
    truth = np.array([bool(t) for _, _, t in known])
    fixed = np.array([any(w in texts[d].lower().split() for w in ("moron", "scum")) for d, _, _ in known])
    assert (found & ~truth).sum() <= 5 and (found[fixed]).mean() > 0.6


def test_contradicting_labels_and_extra_columns(spark):
    docs, labels, known, _ = corpus(spark, n=200)
    doubled = labels.unionByName(labels.selectExpr("doc_id", "1 - quality AS quality", "0 AS toxic").where("doc_id % 3 = 0")).withColumn("text", labels.doc_id)
    one, other = (toxicity.scored(docs, x).orderBy("doc_id", "score").collect() for x in (labels, doubled))
    assert [r.score for r in one] == pytest.approx([r.score for r in other])
    assert quality.scored(docs, doubled).count() == docs.count()


def test_ridge_equals_one_dense_solve_and_its_features_an_exact_kernel(spark, monkeypatch):
    monkeypatch.setattr(quality, "FEATURES", 2048)
    docs, labels, known, n = corpus(spark, n=300)
    docs = docs.where(f"doc_id < {n}").distinct()
    model = quality.Quality.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    train = [(texts[d], y) for d, y, _ in known if crc32(str(d).encode()) % 3 != 1]
    x, y = np.array([quality.statistics(t) for t, _ in train]), np.array([y for _, y in train], float)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-3))
    z = model.mapped(x)
    ridge = np.eye(2049) * quality.RIDGE * len(y) / 2048
    ridge[-1, -1] = 0
    dense = np.linalg.solve(z.T @ z + ridge, z.T @ y)
    assert np.allclose(z @ model.weights, z @ dense, atol=1e-5)
    scaled = np.clip((x[:80] - model.mean) / model.scale, -6, 6)
    exact = np.exp(-((scaled[:, None] - scaled[None]) ** 2).sum(axis=2) / 2 / scaled.shape[1])
    assert np.abs(z[:80, :-1] @ z[:80, :-1].T - exact).max() < 0.1


def test_pooled_is_isotonic():
    x, v = quality.pooled(np.arange(6.0), np.array([0, 1, 0, 1, 0.5, 1]), np.ones(6))
    assert (np.diff(v) > 0).all() and (np.diff(x) > 0).all()
    assert np.allclose(v, [0, 0.5, 0.75, 1])
