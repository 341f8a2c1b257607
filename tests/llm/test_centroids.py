"""Clusters against all distances in plain whole numbers, with ties, repeated and unfit vectors."""

import hashlib
import math
import random

import numpy as np
import pytest

from fathomlake.llm import centroids as ce

KIND = "vec_id long, embedding array<double>, cluster string, v int"


def plain(rows, k, rounds, size):
    """(sorted results, distances that a full search computes) by Python's whole numbers."""
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    at = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        at = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(at)]
    placed = [(i, *near(v)) for i, v in kept]
    total = lambda j: sum(d for _, d, c in placed if j in (None, c))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, c, d, total(c), total(None), sha[c]) for i, d, c in placed), key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], KIND).repartition(3)
    return sorted((tuple(r) for r in ce.cluster(df, **kw).collect()), key=str)


@pytest.mark.parametrize("scale", [0.03, 1.0, 30_000.0])
def test_equals_full_search(spark, scale):
    rng = random.Random(int(scale * 100))
    rows = [(i, [rng.gauss(i % 5, 0.5) * scale for _ in range(64)]) for i in range(250)]
    assert run(spark, rows) == plain(rows, 16, 3, 64)


def test_ties_and_unfit_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice((-1, 0, 1)) / 64 for _ in range(4)]) for i in range(150)]
    rows += rows[:40] + [(None, [0.0] * 4), (None, [0.0] * 4), (7, [1 / 64, 0.0, 0.0, 0.0])]
    rows += [(900, None), (901, []), (902, [0.0] * 3), (903, [0.0] * 5), (904, [0.0, None, 0.0, 0.0]), (905, [math.nan] * 4), (906, [0.0, math.inf, 0.0, 0.0]), (907, [0.0, -math.inf, 0.0, 0.0])]
    assert run(spark, rows, k=9, size=4) == plain(rows, 9, 3, 4)


def test_fewer_vectors_than_centroids_and_one_hot_vector(spark):
    few = [(1, [0.5, 0.25]), (2, [-0.5, 1.0]), (3, [0.5, 0.25])]
    assert run(spark, few, size=2) == plain(few, 16, 3, 2)
    hot = [(i, [0.1, 0.2]) for i in range(300)] + [(1000 + i, [i / 7, -i / 3]) for i in range(30)]
    assert run(spark, hot, k=4, size=2) == plain(hot, 4, 3, 2)


def test_empty_and_huge(spark):
    assert run(spark, [(1, None)]) == []
    got = run(spark, [(1, [1e300, 0.0]), (2, [0.0, -1e300])], k=1, size=2)
    assert len(got) == 2 and all(r[2] > 0 for r in got)


def test_bounds_hold_and_save_work():
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(m, 8, (300, 16)) for m in rng.normal(0, 60, (8, 16))]).astype(np.int64)
    c = v[::300].copy()
    b, work = ce.assigned(v, c, None)
    assert work == len(v) * len(c)
    for _ in range(4):
        after = np.stack([v[b.cluster == j].mean(axis=0).astype(np.int64) if (b.cluster == j).any() else c[j] for j in range(len(c))])
        b, work = ce.assigned(v, after, ce.moved(b, c, after))
        c = after
        d2 = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        assert (b.cluster == d2.argmin(axis=1)).all() and work < len(v) * len(c) / 2
        assert (b.upper.astype(float) ** 2 >= d2.min(axis=1)).all() and (b.lower.astype(float) ** 2 <= d2).all()
