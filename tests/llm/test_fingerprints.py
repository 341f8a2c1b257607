"""Fingerprints against a walk of one step at a time, edited texts against plain Python, near copies found by banding."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fathomlake.llm import fingerprints as f


def slow(text):
    bits, records = f.tables()
    classes, written, at = f.char_classes(text), [], 0
    for j in range(2 * len(text)):
        c = int(classes[at]) if at < len(text) else f.PAD
        written.append(c)
        at += int(bits[j % f.PERIOD][c])
    steps = [r[np.searchsorted(r, 2 * len(text)) - 1] for r in records]
    return "".join("0123456789abcdef"[(written[s] if text else f.PAD) & 15] for s in steps)


def prose(rng, n):
    return " ".join(rng.choice("the an ing of tion ära été".split()) + rng.choice("abc") for _ in range(n))


def test_walks_equal_single_steps():
    rng = random.Random(1)
    strings = ["", "a", "ab", "ab", "😀é" * 40, prose(rng, 300), prose(rng, 20), " " * 500]
    assert f.fingerprints(strings) == [slow(s) for s in strings]
    assert f.fingerprints([]) == []


def rows_of(docs):
    tie = lambda t: (xxhash.xxh64_intdigest(t.encode(), seed=42) + (1 << 63)) % (1 << 64)  # noqa: E731  in the order of signed longs
    named = sorted(((d, t or "") for d, t in docs if d is not None), key=lambda r: (r[0], tie(r[1])))
    out = []
    for i, (d, t) in enumerate(named):
        out.append((d, t, named[(i + 1) % len(named)][1]))
    return out


@pytest.mark.parametrize("bucket_rows", [3, 1000])
def test_edited_equals_plain_python(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(f, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(2)
    docs = [(i * 5, prose(rng, rng.randint(0, 60))) for i in range(40)] + [(201, None), (202, ""), (203, "abc"), (204, "abcd"), (None, "no id here"), (None, None), (15, "a tie"), (204, "abcd")]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, bucket string").repartition(4)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in f.edited(frame).collect())
    want = []
    for d, t, following in rows_of(docs):
        e = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        p, q, n = f.fingerprints([t, e, following])
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), p, q, f.likeness(p, q), f.likeness(p, n)))
    for t in ("no id here", ""):
        e = t[: len(t) - len(t) // 4]
        p, q = f.fingerprints([t, e])
        want.append((-1, len(t), hashlib.sha256(e.encode()).hexdigest(), p, q, f.likeness(p, q), 0.0))
    assert got == sorted(want)


def test_edited_of_few_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert f.edited(empty).count() == 0
    (only,) = f.edited(spark.createDataFrame([(3, "one document")], "doc_id long, text string")).collect()
    assert only.near_next == 1.0 and only.edited_sha256 == hashlib.sha256(b"one documone").hexdigest()


def test_likeness_follows_the_edits():
    rng = random.Random(3)
    for _ in range(5):
        a, b = prose(rng, 400), prose(rng, 400)
        p, q, r = f.fingerprints([a, f.edited_text(a, b), b])
        assert f.likeness(p, q) > 0.65 and f.likeness(p, r) < 0.45


def test_near_copies(spark):
    rng = random.Random(4)
    rows = []
    for i in range(12):
        base = prose(rng, 250)
        rows.append((i * 10, base))
        rows += [(i * 10 + k, base + " end" * k if k < 3 else base) for k in range(1, 4)]
    docs = spark.createDataFrame([*rows, (None, "x"), (500, "")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in f.near_copies(docs).collect()}
    assert got == {d: d // 10 * 10 for d, _ in rows} | {500: 500}
    assert f.near_copies(docs.limit(0)).count() == 0


def test_bands_find_what_brute_force_finds(spark):
    """Recall of banding against all pairs of fingerprints, on copies with few and with many edits."""
    rng = random.Random(6)
    rows = []
    for i in range(25):
        base = prose(rng, 220).split(" ")
        rows.append((i * 10, " ".join(base)))
        for k in range(1, 5):
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy) * 3 // 4, len(copy))] = "changed"
            rows.append((i * 10 + k, " ".join(copy)))
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), rows[3]], "doc_id long, text string")
    got = f.edited_and_grouped(docs).collect()
    prints = {r.doc_id: r.fingerprint for r in got if r.doc_id is not None}
    groups = {r.doc_id: r.component_id for r in got}
    assert groups.pop(None) is None and len(got) == len(rows) + 2
    alike = [(a, b) for a in prints for b in prints if a < b and f.likeness(prints[a], prints[b]) >= f.LEAST]
    assert len(alike) > 40 and np.mean([groups[a] == groups[b] for a, b in alike]) >= 0.95
    assert all(groups[d] // 10 == d // 10 for d in groups)
    assert f.edited_and_grouped(docs.limit(0)).count() == 0


def test_no_link_at_the_least_likeness_is_left_out(spark):
    """Fingerprints that differ in as many slots as links may, anywhere or one in each stretch of five, whole and in split bands."""
    rng = random.Random(16)
    prints = []
    for k in range(60):
        a = [rng.choice("0123456789abcdef") for _ in range(f.SLOTS)]
        at = rng.sample(range(f.SLOTS), 51) if k % 2 else [i * 5 + rng.randrange(5) for i in range(51)]
        b = ["0123456789abcdef"[(int(c, 16) + 1) % 16] if i in at else c for i, c in enumerate(a)]
        prints += ["".join(a), "".join(b)]
    rows = spark.createDataFrame([(i, bytearray.fromhex(p)) for i, p in enumerate(prints)], "doc_id long, print binary")
    want = {(bytes.fromhex(p), i // 2 * 2) for i, p in enumerate(prints)}
    for n in (10**9, 0):
        assert {(bytes(r.print), r.component_id) for r in f.classed(rows, f.LEAST, f.BANDS, n).collect()} == want
    longs = rows.select(F.col("doc_id").alias("id"), *f.as_longs(F.hex("print")), F.lit(1).alias("key"))
    split = f.split_bands(longs).select("id", "split")
    met = split.alias("a").join(split.alias("b"), F.col("a.split") == F.col("b.split")).where("a.id % 2 = 0 AND b.id = a.id + 1")
    assert met.select("a.id").distinct().count() == 60


def test_split_slots_leave_no_difference_room():
    rng = random.Random(17)
    for telling, rows in ((256, 10), (256, 3000), (256, 10**7), (180, 10**4), (60, 10**6), (0, 50)):
        lists = f.split_slots(rng.sample(range(f.SLOTS), f.SLOTS), telling, rows, 51)
        assert len(lists) <= 2 * f.SPLIT_KEYS
        for _ in range(300):
            differ = set(rng.sample(range(f.SLOTS), 51))
            assert any(not differ.intersection(x) for x in lists)


def test_very_long_texts(spark):
    rng = random.Random(8)
    long = prose(rng, 80_000)
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in f.edited_and_grouped(docs).collect()}
    assert got[1].n_chars == len(long) and got[2].component_id == 1 and got[3].component_id == 3
    assert got[1].near_next > 0.95 and got[4].n_chars == 0


def test_likeness_of_longs_is_that_of_digits(spark):
    rng = random.Random(3)
    prints = ["".join(rng.choice("0f8a") for _ in range(f.SLOTS)) for _ in range(12)]
    prints += [p[:100] + q[100:] for p, q in zip(prints, prints[1:])] + ["f" * f.SLOTS]
    rows = spark.createDataFrame(list(enumerate(prints)), "id int, h string").select("id", *f.as_longs(F.col("h")))
    got = rows.alias("a").join(rows.alias("b"), F.col("a.id") <= F.col("b.id")).select("a.id", F.col("b.id").alias("other"), f.likeness_of("a", "b").alias("x")).collect()
    assert all(r.x == f.likeness(prints[r.id], prints[r.other]) for r in got) and len(got) > 200


def headed(rng, n, copies):
    """Texts with one common head and other words behind it, and near copies of some of them."""
    head = prose(rng, 12)[:88]
    bodies = [head + " " + prose(rng, 60) for _ in range(n)]
    rows = [(i * 10, t) for i, t in enumerate(bodies)]
    return rows + [(i * 10 + 1, bodies[i] + " end") for i in range(copies)]


def test_a_band_of_one_head_is_split_and_keeps_its_copies(spark):
    rng = random.Random(4)
    pairs = {}
    for n in (400, 800, 1600):
        rows = headed(rng, n, 40)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        prints = f.fingerprinted(docs).withColumn("print", F.unhex("fingerprint")).select(F.col("doc_id").alias("id"), *f.as_longs(F.col("fingerprint"))).withColumn("key", F.lit(1))
        split = f.split_bands(prints).groupBy("split").count()
        pairs[n] = split.agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
        groups = {r.doc_id: r.component_id for r in f.near_copies(docs).collect()}
        alike = [i * 10 + 1 for i in range(40) if f.likeness(*f.fingerprints([rows[i][1], rows[i][1] + " end"])) >= f.LEAST]
        assert len(alike) > 30 and np.mean([groups[d] == d - 1 for d in alike]) >= 0.95
    assert pairs[1600] / pairs[400] <= 4**1.2


def test_split_bands_find_what_whole_ones_find(spark):
    rng = random.Random(9)
    rows = [(i, t) for i, (_, t) in enumerate(headed(rng, 150, 60))]
    prints = f.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.unhex("fingerprint").alias("print"))
    whole, split = ({(bytes(r.print), r.component_id) for r in f.classed(prints, f.LEAST, f.BANDS, n).collect()} for n in (10**9, 0))
    assert len(whole) > 80 and len(whole & split) / len(whole) >= 0.95


def test_likeness_by_number_of_edits(spark):
    """What a likeness of LEAST finds of texts with edits anywhere: all with one, most with three, fewer in long texts with more."""
    rng = random.Random(12)
    share = {}
    for edits in (1, 3, 6):
        pairs = []
        for _ in range(60):
            base = prose(rng, rng.randint(70, 1000))
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice("abcdefgh")
            pairs += [base, "".join(copy)]
        prints = f.fingerprints(pairs)
        share[edits] = np.mean([f.likeness(a, b) >= f.LEAST for a, b in zip(prints[::2], prints[1::2])])
    assert share[1] >= 0.95 and share[3] >= 0.8 and share[6] >= 0.7, share


def test_keys_are_wide_and_leave_no_difference_room():
    """Keys of more than nine slots on average, which unrelated texts seldom share; two blocks of four slots are eight."""
    rng = random.Random(18)
    differ = f.differing(f.LEAST)
    sets = f.widest_sets(f.BANDS, differ)
    assert len(sets) <= f.KEYS and len(sets[0]) * f.SLOTS / f.BANDS > 9
    for _ in range(2_000):
        away = {s * f.BANDS // f.SLOTS for s in rng.sample(range(f.SLOTS), differ)} if rng.random() < 0.5 else set(rng.sample(range(f.BANDS), differ))
        assert any(not away.intersection(s) for s in sets)


def test_a_bands_hub_meets_its_rows_once(spark, monkeypatch):
    """Unlike rows that share bands meet as hub and row, not again afterwards; two that are alike but not the hub's still do."""
    rng = random.Random(19)
    flipped = lambda p, at: "".join("0123456789abcdef"[(int(c, 16) + 1) % 16] if i in at else c for i, c in enumerate(p))
    pairs, threes = [], []
    for _ in range(20):
        p = "".join(rng.choice("0123456789abcdef") for _ in range(f.SLOTS))
        far = flipped(p, range(100, 170))
        pairs += [p, far]
        threes += [p, far, flipped(far, range(0, 20))]
    tables, saved = {}, f.saved
    monkeypatch.setattr(f, "saved", lambda df, name: tables.setdefault(name, saved(df, name)))
    grouped = lambda prints: {bytes(r.print).hex(): r.component_id for r in f.classed(spark.createDataFrame([(i, bytearray.fromhex(p)) for i, p in enumerate(prints)], "doc_id long, print binary"), f.LEAST, f.BANDS).collect()}
    monkeypatch.setattr(f, "PASS_KEYS", f.KEYS)  # one pass, so that each table has a name of its own
    assert grouped(pairs) == {} and not tables["bands"].isEmpty() and tables["mixed-bands"].isEmpty()
    tables.clear()
    assert grouped(threes) == {p: i // 3 * 3 + 1 for i, p in enumerate(threes) if i % 3}


def test_prints_join_documents_not_rows_of_bands(spark):
    rows = spark.createDataFrame([(i, 7, k, 3) for i in range(5) for k in range(30)], "id long, component long, key long, main long")
    told = spark.createDataFrame([(i, *range(i, i + f.LONGS)) for i in range(9)], "id long, " + ", ".join(f"f{i} long" for i in range(f.LONGS)))
    got = f.with_prints(rows, told)
    want = rows.join(told, "id")
    assert got.count() == 150 and got.select(*want.columns).exceptAll(want).isEmpty()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") < plan.index("Aggregate")
