"""Nested cards against plain recursion: what is dropped, what stays, and the shape that is built again."""

import json
import random
import re

from fathomlake.operators import bodies, nodes
from fathomlake.plans import bodies as plans

SF = "/root/testdata/sf0.001"
FIELD = {**bodies.OWN_TEXT}


def rebuild(nodes_, judge, slot=None):
    """Plain recursion: judge(kind, label, text, slot) gives the new text or None."""
    out = []
    for i, n in enumerate(nodes_):
        here = i if slot is None else slot
        kind, n = n["type"], dict(n)
        if isinstance(n.get(FIELD.get(kind, "")), str):
            text = judge(kind, n.get("label"), n[FIELD[kind]], here)
            if text:
                n[FIELD[kind]] = text
            elif kind == "hero":
                del n["caption"]
            else:
                continue
        if kind in bodies.ITEM_TEXT:
            field, kept = bodies.ITEM_TEXT[kind], []
            for item in n["items"]:
                item = dict(item)
                text = judge(kind, item.get("label"), item[field], here) if field in item else ""
                if text:
                    kept.append({**item, field: text})
                elif kind == "steps":
                    item.pop(field, None)
                    kept.append(item)
            if not kept:
                continue
            n["items"] = kept
        if "children" in n:
            held = rebuild(n["children"], judge, here)
            if n["children"] and not held:
                continue
            n["children"] = held
        if "tabs" in n:
            n["tabs"] = [{**t, "children": rebuild(t["children"], judge, here)} for t in n["tabs"]]
            n["tabs"] = [t for t in n["tabs"] if t["children"]]
            if not n["tabs"]:
                continue
        out.append(n)
    return out


def squash(s):
    return " ".join(re.sub(r"(\d{1,3})\.\s+(?=\d{1,3}\b)", r"\1.", s).split())


def polish(card):
    seen = set()

    def fresh(parts):
        kept = []
        for p in parts:
            key = re.sub(" +", " ", re.sub("[^a-z0-9 ]+", " ", re.sub(r"\[\d+\]", "", p.lower()))).strip()[:80]
            if len(key) < 12 or key not in seen:
                kept.append(p)
            if len(key) >= 12:
                seen.add(key)
        return " ".join(kept)

    def judge(kind, label, text, slot):
        if kind in ("list", "quote"):
            return fresh([text])
        if kind not in ("text", "callout", "hero", "accordion"):
            return text
        cap = {"callout": 280, "hero": 160}.get(kind, 600)
        parts, used, kept = re.split(r"(?<=[.!?])\s+", squash(text)), -1, []
        for i, p in enumerate(parts):
            used += len(p) + 1
            if i and used > cap:
                break
            kept.append(p)
        return fresh(kept)

    return rebuild(card, judge)


def once(card, run=8):
    seen = set()

    def judge(kind, label, text, slot):
        if kind not in ("text", "callout", "quote", "draft", "heading", "hero"):
            return text
        kept, dropped = [], False
        for p in re.split(r"(?<=[.!?])\s+", text):
            w = [x for x in re.split(r"\s+", re.sub(r"[^a-z0-9\s]", " ", re.sub(r"\[[0-9]+\]", " ", p.lower()))) if len(x) > 2]
            runs = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
            if runs & seen:
                dropped = True
            else:
                kept.append(p)
                seen.update(runs)
        return " ".join(" ".join(kept).split()) if dropped else text

    return rebuild(card, judge)


def facts_once(card):
    keys, longs, pending = set(), set(), []
    state = {"slot": None}

    def settle(slot):
        if state["slot"] != slot:
            for k, l in pending:
                keys.update(k)
                longs.update(l)
            pending.clear()
            state["slot"] = slot

    def judge(kind, label, text, slot):
        settle(slot)
        bare = re.sub(r"\[\d+\]", "", text.lower())
        long = re.sub("[^a-z0-9]+", " ", bare).strip()
        long = [long] if len(long) >= 40 else []
        if kind in ("tile", "stat", "keyvalue"):
            said = re.sub("[^a-z0-9.$%€£]+", " ", bare).strip()
            words = [w for w in re.split("[^a-z0-9]+", (label or "").lower()) if len(w) >= 3 and w not in bodies.LABEL_STOP] or [""]
            own = [f"{said}|{w}" for w in words] if len(said) >= 2 else []
            if keys & set(own) or any(x in shown for x in long for shown in longs):
                return None
            pending.append((own, [] if kind == "stat" else long))
        elif kind in ("text", "callout", "quote", "hero"):
            pending.append(([], long))
        return text

    return rebuild(card, judge)


def random_cards(seed, n=200):
    rng = random.Random(seed)
    said = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(rng.randint(1, 14))).capitalize() + rng.choice(".!?") for _ in range(12)]
    text = lambda: " ".join(rng.choices(said, k=rng.randint(1, 5)))

    def node(depth):
        kind = rng.choice(["text", "callout", "quote", "heading", "hero", "list", "accordion", "steps", "keyvalue", "tile", "stat", "divider"] + ["section", "tabs", "stack"] * (depth < 4))
        if kind in ("section", "stack"):
            return {"type": kind, "title": "t", "children": [node(depth + 1) for _ in range(rng.randint(1, 3))]}
        if kind == "tabs":
            return {"type": kind, "tabs": [{"label": "l", "children": [node(depth + 1)]} for _ in range(rng.randint(1, 3))]}
        if kind in bodies.ITEM_TEXT:
            return {"type": kind, "items": [{"title": "t", "label": rng.choice(("Price", "Cost of it", "")), bodies.ITEM_TEXT[kind]: rng.choice((text(), "$9", "12%"))} for _ in range(rng.randint(1, 4))]}
        if kind == "hero":
            return {"type": kind, "value": "1", "caption": text()}
        return {"type": kind} if kind == "divider" else {"type": kind, "label": rng.choice(("Price", "Total cost")), FIELD[kind]: rng.choice((text(), "$9", "$10"))}

    return [(i, json.dumps([node(0) for _ in range(rng.randint(1, 5))])) for i in range(n)]


def check(spark, operator, plain):
    cards = random_cards(3) + [(900, None), (901, "no json"), (902, "[]"), (903, '{"type":"text","text":"One node only."}')]
    got = {r.k: r.body for r in operator(spark.createDataFrame(cards, "k int, body string").repartition(3), "k", "body").collect()}
    assert len(got) == len(cards) and got[900] is None and got[901] == "no json" and got[902] == "[]"
    changed = 0
    for k, body in cards:
        if k < 900:
            assert json.loads(got[k]) == plain(json.loads(body)), body
            changed += json.loads(got[k]) != json.loads(body)
    assert changed > 5


def test_polished(spark):
    check(spark, bodies.polished, polish)


def test_said_once(spark):
    check(spark, bodies.said_once, once)


def test_facts_once(spark):
    check(spark, bodies.without_repeated_facts, facts_once)


def test_queries_equal_plain_recursion(spark):
    given = {r.conv_id: json.loads(r.body) for r in plans.cards_of_threads(spark, SF).collect()}
    for run, plain in ((plans.card_polished, polish), (plans.card_said_once, once), (plans.card_facts_once, facts_once)):
        got = {r.conv_id: json.loads(r.body) for r in run(spark, SF).collect()}
        assert got == {k: plain(v) for k, v in given.items()} and got != given


def test_cut_decimals(spark):
    long = "The measured share of all of it has by now come to be about"
    cases = {
        f"{long} 4": f"{long} 4.5%", f"{long} 4.": f"{long} 4.5%", f'He said: "{long} 7.': f'He said: "{long} 7.25"', f"“{long} 7”": f"“{long} 7.25”",
        f"{long} 9": f"{long} 9", f"{long} 3": f"{long} 3", "Short 4": "Short 4", f"{long}, see page 4": f"{long}, see page 4", f"{long} 4.5 and not 4": f"{long} 4.5 and not 4",
    }
    hints = [{"type": "tile", "label": "x", "value": v} for v in ("4.5%", "7.25 m", "3.1", "3.2")]
    cards = [(i, json.dumps([{"type": "section", "children": [{"type": "text", "text": t}]}, *hints])) for i, t in enumerate(cases)]
    got = bodies.with_cut_decimals(spark.createDataFrame(cards, "k int, body string"), "k", "body").collect()
    assert {r.k: json.loads(r.body)[0]["children"][0]["text"] for r in got} == dict(enumerate(cases.values()))
    thread = {r.conv_id: r.body for r in plans.card_decimals(spark, SF).collect()}
    assert any(re.search(r"come to \d+\.\d%", b) for b in thread.values())


def test_sanitized(spark):
    deep = {"type": "text", "text": "deep"}
    for _ in range(5):
        deep = {"type": "stack", "children": [deep], "direction": "up", "gap": "sm"}
    cases = [
        ([deep], [deep_of(5)], {}),
        ([{"type": "stack", "children": [deep]}], [], {"nodes too deep": 1, "incomplete node": 6}),
        ([{"type": "text", "text": "**Bold** x\n"}, {"type": "what"}, 5, None, {"type": ["text"]}], [{"type": "text", "text": "Bold x"}], {"unknown type": 4}),
        ([{"type": "list", "items": ["a", {"text": "b", "source": "3", "imageRef": 99, "icon": "A-b!"}, {"meta": "x"}], "style": "check"}], [{"type": "list", "style": "check", "items": [{"text": "a"}, {"text": "b", "icon": "a-b", "source": 3}]}], {"incomplete item": 1}),
        ([{"type": "badges", "items": list("abcdefghijklmno")}], [{"type": "badges", "items": list("abcdefghijkl")}], {"items over the limit": 3}),
        ([{"type": "chart", "data": [{"label": "a", "value": "1.5"}, {"label": "b", "value": 2}]}, {"type": "chart", "data": [{"label": "a", "value": 1}]}], [{"type": "chart", "kind": "bar", "data": [{"label": "a", "value": 1.5}, {"label": "b", "value": 2}]}], {"incomplete node": 1}),
        ([{"type": "progress", "label": "p", "value": 140}, {"type": "rating", "value": 3}, {"type": "grid", "cols": 9, "children": [{"type": "divider"}]}], [{"type": "progress", "label": "p", "value": 100}, {"type": "rating", "value": 3, "max": 5}, {"type": "grid", "cols": 2, "children": [{"type": "divider"}]}], {}),
        ([{"type": "table", "columns": ["a", 1], "rows": [["x", None, "y"], []]}, {"type": "image"}, {"type": "gallery", "refs": [1, 50]}], [{"type": "table", "columns": ["a", "1"], "rows": [["x", "y"]]}, {"type": "gallery", "refs": [1]}], {"incomplete node": 1}),
        ([{"type": "tile", "label": "l", "value": "x" * 36 + " 12.75 m"}], [{"type": "tile", "label": "l", "value": "x" * 36 + " 12.75"}], {}),
    ]
    cards = [(i, json.dumps(c[0])) for i, c in enumerate(cases)] + [(98, None), (99, "{")]
    got = {r.k: r for r in nodes.sanitized(spark.createDataFrame(cards, "k int, body string"), "k", "body").collect()}
    for i, (_, want, dropped) in enumerate(cases):
        assert json.loads(got[i].body) == want and got[i].dropped == dropped, (i, got[i])
    assert got[98].body == got[99].body == "[]"


def deep_of(n):
    return {"type": "stack", "children": [deep_of(n - 1)], "gap": "sm"} if n else {"type": "text", "text": "deep"}


def test_sanitized_threads_lose_unknown_nodes_only(spark):
    given = {r.conv_id: json.loads(r.body) for r in plans.cards_of_threads(spark, SF).collect()}
    for r in plans.card_sanitized(spark, SF).collect():
        assert "widget" not in r.body and len(json.loads(r.body)) == sum(n["type"] != "widget" for n in given[r.conv_id][:12])


def test_cards_are_parsed_in_slices_of_bounded_size(monkeypatch):
    """A batch is cut at PART_BYTES of bodies, a larger card goes alone, and no row is lost."""
    import pyarrow as pa

    monkeypatch.setattr(bodies, "PART_BYTES", 10)
    said = ["a" * 4, "b" * 6, None, "c" * 30, "d", "", "e" * 10]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(said))]), pa.array(said)], names=["card", "body"])
    parts = [p.column(1).to_pylist() for p in bodies._parts(batch)]
    assert parts == [["a" * 4, "b" * 6, None], ["c" * 30], ["d", ""], ["e" * 10]] and list(bodies._parts(batch.slice(0, 0)))[0].num_rows == 0
