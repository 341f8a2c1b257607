"""Objects against the ordered fold, levels, contexts, packed answers and figures against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from fathomlake.operators import context, objects, spans
from fathomlake.plans import answers as plans

SF = "/root/testdata/sf0.001"


def test_clean_name(spark):
    cases = {
        "Nikon Zf What is the battery life?": "Nikon Zf", "Please add the Contax T3": "Contax T3", "the": "the", "Compare": "Compare", "Show me that": "me that", "Also, the a Leica M6 how much": "Leica M6",
        "What": "What", "iPhone 15??": "iPhone 15", "X what now": "X what now",
    }
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r.n: r.c for r in df.select("n", objects.clean_name(F.col("n")).alias("c")).collect()} == cases


def parts(name):
    return [w for w in re.split("[^a-z0-9]+", name.lower()) if len(w) >= 2 and w not in objects.NAME_STOP]


def same_object(a, b):
    ma, mb = ([w for w in x if re.search(r"\d", w)] for x in (a, b))
    wa, wb = ([w for w in x if not re.search(r"\d", w) and len(w) >= 4] for x in (a, b))
    if not a or not b or bool(ma) != bool(mb) or ma and not set(ma) & set(mb):
        return False
    if not wa or not wb:
        return bool(ma)
    return set(wa) <= set(wb) if len(wa) <= len(wb) else set(wb) <= set(wa)


def same_product(a, b):
    if not a or not b:
        return False
    da, db = ({w for w in x if w.isdigit()} for x in (a, b))
    sa, sb = ([w for w in x if len(w) >= 4] for x in (a, b))
    wa, wb = ({w for w in x if len(w) < 4 and not w.isdigit()} for x in (a, b))
    if da and db and not da & db:
        return False
    if sa and sb:
        if not (set(sa) <= set(sb) if len(sa) <= len(sb) else set(sb) <= set(sa)):
            return False
    elif not set(a) & set(b):
        return False
    return not (wa and wb and not wa & wb) and bool(wa) == bool(wb) and bool(sa or da)


def folded(rows, same):
    held, out = {}, set()
    for scope, pos, name in sorted(rows):
        p = sorted(parts(name))
        leader = next((q for q, x in held.setdefault(scope, []) if same(x, p)), None)
        if leader is None:
            held[scope].append((pos, p))
        out.add((scope, pos, pos if leader is None else leader))
    return out


@pytest.mark.parametrize("same,columns,keys", [(same_object, objects.same_object, objects.object_keys), (same_product, objects.same_product, objects.product_keys)])
def test_leaders_equal_the_ordered_fold(spark, same, columns, keys):
    rng = random.Random(9)
    words = "alpha bravo canon delta pro max xt t2 t3 64 128 edge the".split()
    rows = [(i % 5, i, " ".join(rng.choices(words, k=rng.randint(0, 4)))) for i in range(300)]
    rows += [(9, 1000 + i, " ".join(["word" + "abcdefghij"[j] for j in range(i % 10 + 1)])) for i in range(40)]
    got = objects.leaders(spark.createDataFrame(rows, "s int, p int, n string").repartition(3), "s", "n", "p", columns, keys)
    assert {tuple(r) for r in got.collect()} == folded(rows, same)


def test_levels(spark):
    chain = [(1, i, i + 1) for i in range(25)] + [(1, 3, 20)]
    circle = [(2, 0, 1), (2, 1, 2), (2, 2, 1), (2, 2, 3), (2, 5, 5), (2, 0, 4), (2, 0, 4)]
    got = {(r.g, r.node): r.level for r in objects.levels(spark.createDataFrame(chain + circle, "g int, a int, b int"), "g", "a", "b").collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == {i: i for i in range(26)}
    assert {k[1]: v for k, v in got.items() if k[0] == 2} == {0: 0, 1: None, 2: None, 3: None, 4: 1, 5: None}
    assert objects.levels(spark.createDataFrame([], "g int, a int, b int"), "g", "a", "b").count() == 0


def fit(text, most):
    if text is None or len(text) <= most:
        return text or ""
    lines = text.split("\n")
    turn = [x.startswith("- Q: ") for x in lines]
    keep = [not t for t in turn]
    for i in reversed(range(len(lines))):
        if turn[i] and sum(len(x) + 1 for x, k in zip(lines, keep) if k) + len(lines[i]) + 1 <= most:
            keep[i] = True
    some = any(k and t for k, t in zip(keep, turn))
    out = [x for x, k in zip(lines, keep) if k and (some or x != context.HEADER)]
    for _ in range(len(out)):
        over = len("\n".join(out)) - most
        at = max(range(len(out)), key=lambda i: len(out[i]))
        cut = max(40, len(out[at]) - over - 1)
        if over <= 0 or cut >= len(out[at]):
            break
        out[at] = out[at][:cut].rstrip(" ") + "…"
    return "\n".join(out)[:most]


def test_fit_context(spark):
    rng = random.Random(2)
    texts = [None, "", "short"]
    for _ in range(80):
        lines = ["Topic: " + "t" * rng.randint(0, 80), context.HEADER] + [f"- Q: {'é ' * rng.randint(1, 40)}{i}" for i in range(rng.randint(0, 8))] + ["Latest card: " + "word " * rng.randint(0, 60)]
        texts.append("\n".join(lines[rng.randint(0, 2) :]))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for most in (60, 150, 300):
        got = {r.i: r.f for r in df.select("i", context.fit_context(F.col("t"), most).alias("f")).collect()}
        assert got == {i: fit(t, most) for i, t in enumerate(texts)} and max(map(len, got.values())) <= most


def test_fitted_threads(spark):
    assert all(len(r.fitted) <= 500 and r.fitted for r in plans.fitted_context(spark, SF).collect())


def test_packed_searches(spark):
    given = {r.search: r.asDict(recursive=True) for r in plans.searches(spark, SF).collect()}
    got = plans.packed_searches(spark, SF).collect()
    shapes = set()
    for r in got:
        g = given[r.search]
        cut = lambda s, n: None if s is None else s[:n]
        bare = lambda x: {k: bare(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [bare(v) for v in x] if isinstance(x, list) else x

        def hit(h, snippet, content, cut=cut):
            out = {"title": cut(h["title"], 180), "url": cut(h["url"], 500), "snippet": cut(h["snippet"], snippet), "domain": cut(h["domain"], 120), "engines": h["engines"][:4], "date": cut(h["date"], 40)}
            return out | ({"content": cut(h["content"], 400)} if content else {})

        images = [{"url": cut(i["url"], 500), "thumb": cut(i["thumb"], 500), "title": cut(i["title"], 120), "source": cut(i["source"], 120), "license": i["license"], "credit": i["credit"]} for i in g["images"][:4]]
        k = g["knowledge"]
        known = {} if k is None else {"knowledge": {"title": cut(k["title"], 180), "extract": cut(k["extract"], 400), "url": cut(k["url"], 500), "description": k["description"]}}
        talk = [{"title": cut(t["title"], 160), "url": t["url"]} for t in g["talk"][:3]]
        head = {"query": g["query"], "freshness": g["freshness"]}
        options = [
            head | {"results": [hit(h, 320, True) for h in g["hits"][:8]], "images": images} | known | {"discussions": talk, "engines": g["engines"]},
            head | {"results": [hit(h, 320, False) for h in g["hits"][:8]], "images": images[:1]} | known | {"discussions": [], "engines": g["engines"]},
            head | {"results": [hit(h, 80, False) for h in g["hits"][:4]], "images": [], "discussions": [], "engines": g["engines"]},
            head | {"results": [], "images": [], "discussions": [], "engines": g["engines"]},
        ]
        sizes = [len(json.dumps(bare(o), ensure_ascii=False, separators=(",", ":")).encode()) for o in options]
        level = next(i for i, n in enumerate(sizes) if n <= r.most)
        shapes.add(level)
        assert json.loads(r.payload) == bare(options[level]) and len(r.payload.encode()) <= r.most and r.n_results == len(options[level]["results"])
    assert len(shapes) >= 3


PASSES = [("clock", spans.CLOCK), ("money", spans.MONEY), ("rate", spans.RATE), ("lead", spans.LEAD), ("unit", spans.UNIT)]
UNIT_OF = {n: u for u, ns in spans.SAME_UNIT.items() for n in ns.split()} | {"years old": "years"}


def unit_of(word):
    return UNIT_OF.get(word.lower(), word.lower())


def pretty(word):
    if word.lower() in spans.KEPT_SMALL:
        return word.lower()
    return word if len(word) <= 4 and word == word.upper() and re.search("[A-Z]", word) else word[:1].upper() + word[1:].lower()


def plain_figures(text):
    held = []
    for name, pattern in PASSES:
        new = [m for m in re.finditer(pattern, text) if not any(m.start() < e and m.end() > s for s, e, *_ in held)]
        held += [(m.start(), m.end(), name, m) for m in new]
    out = []
    for start, _, name, m in sorted(held, key=lambda h: h[0]):
        words = re.findall("[A-Za-z][A-Za-z%]*", text[max(0, start - 48) : start])[::-1][:4]
        near = next((w for w in words if w.lower() not in spans.LABEL_STOP and re.fullmatch(f"(?i)(?:{spans.LABELS}|weighs?|weighing)", w)), None)
        near = near and ("Weight" if re.fullmatch("(?i)weigh(?:s|ing)?", near) else pretty(near))
        num = lambda s: float(s.replace(",", ""))
        clock, rate = None, name == "rate"
        if name == "clock":
            h, mi, s, u = m.groups()
            unit = unit_of(u) if u else "time"
            clock = f"{h}:{mi}" + (f":{s}" if s else "")
            row = (pretty(unit) if u else "Time", unit, int(h) * 3600.0 + int(mi) * 60 + int(s or 0))
        elif name == "money":
            row = (near or "Dollars", m[0][0], num(m[1]) * spans.SCALES.get((m[2] or "").lower(), 1))
        elif rate:
            row = ((m[1] or m[4]).upper(), (m[1] or m[4]).upper(), num(m[2] or m[3]))
        elif name == "lead":
            row = (pretty(unit_of(m[1])), unit_of(m[1]), num(m[2]))
        else:
            row = (near or pretty(unit_of(m[3])), unit_of(m[3]), num(m[1]) * spans.SCALES.get((m[2] or "").lower(), 1))
        if not any(abs(k[3] - row[2]) <= 0.001 and (k[4] is None) == (clock is None) and k[2] == row[1] for k in out):
            out.append((start, *row, clock, rate))
    return out


FIGURES = [
    "He had 27.5 PPG and points: 30 in 12:30 minutes; $1,200 and $3.5 million.", "weighs 80 kg, weighing 80 lbs, 5 percent, 5%", "rent of $900 and utilities $45.50, the rent $900", "1:02:03 or 10:15",
    "games 7 games", "", None, "FG% 45.2 and 45.2 FG%", "2 million people, 3 years old, 4 GB", "¥500 £20k €1bn", "no figures", "points 10 percent", "over 1,234,567 users",
]


def test_figures_by_priority(spark):
    df = spark.createDataFrame(list(enumerate(FIGURES)), "i int, t string")
    got = {r.i: [tuple(f) for f in r.f or []] for r in df.select("i", spans.figures(F.col("t")).alias("f")).collect()}
    for i, t in enumerate(FIGURES):
        assert got[i] == plain_figures(t or ""), t
    texts = {r.doc_id: r.text for r in plans.figure_texts(spark, SF).collect()}
    rows = {}
    for r in plans.priority_figures(spark, SF).collect():
        rows.setdefault(r.doc_id, []).append((r.start, r.label, r.unit, r.amount, r.clock, r.rate))
    assert {k: sorted(v) for k, v in rows.items()} == {k: sorted((*f[:3], round(f[3], 4), *f[4:]) for f in plain_figures(t)) for k, t in texts.items()}


def test_money_clauses(spark):
    cases = {
        "The standard fee is $42. Expedited service costs $20 more; late fee: $5": [("$42", "The standard fee is $42"), ("$20", "Expedited service costs $20 more"), ("$5", "late fee: $5")],
        "In the U.S. it is $1,300.50 a year | $7": [("$1,300.50", "In the U.S. it is $1,300.50 a year"), ("$7", "$7")],
        "first $5, second $6": [("$5", "first $5, second"), ("$6", "$6")],
        "5% tax on $10": [("$10", "$10")],
        "nothing": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: [(c.figure, c.line) for c in r.c] for r in df.select("t", spans.money_clauses(F.col("t")).alias("c")).collect()}
    assert got == cases


def test_lead_figures(spark):
    rows = [
        (1, "What is the passport book fee?", "Expedited fee is $60. The passport book fee is $130. The passport card fee is $30", ["passport", "book", "fee"]),
        (2, "What is the fee?", "nothing of it $5", ["fee"]), (3, "What is the fee?", "optional fee is $5; fee is $9 and more", ["fee"]), (4, "x", "no money", ["x"]),
    ]
    df = spark.createDataFrame(rows, "k int, q string, t string, w array<string>")
    got = {r.k: (r.figure, r.value, r.score) for r in spans.lead_figures(df, "k", "q", "t", "w").collect()}
    assert got == {1: ("$130", 130.0, 16)}
    assert {r.figure for r in plans.lead_figures(spark, SF).collect()} <= {f"${n}" for n in range(20, 29)} and plans.lead_figures(spark, SF).count() > 50


def test_leaders_broadcast_nothing(spark):
    """Both sides of its joins grow with the names, so none goes through the driver."""
    rows = spark.createDataFrame([(i // 5, i, f"red bolt T{i % 3}") for i in range(20)], "s int, p int, n string")
    for got in (objects.leaders(rows, "s", "n", "p"), objects.leaders(rows, "s", "n", "p", objects.same_product, objects.product_keys)):
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == 20
