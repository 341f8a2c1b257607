"""Repairs against an enumeration of all edits, long conversations against short ones, damage and counts against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from fathomlake.llm import conversation_repair as cr

LEGAL = re.compile(r"(s?(ua)+)?")
KIND = "conv_id long, turn long, role string, text string, audit int, fate string"


def enumerated(kinds):
    """The best (cost, audit) over every choice of edits with up to two inserts in every gap."""
    gaps = [""] + ["u", "a", "ua", "au"]
    best = None
    choices = []
    for initial, fault in kinds:
        more = 5 if fault == "truncated" else 0
        row = [("D", "", 2)]
        if fault not in ("blank", "duplicate"):
            row += [("K", initial, more), ("R", "u", 1 + more), ("R", "a", 1 + more)]
        choices.append(row)
    for edits in itertools.product(*choices):
        for ins in itertools.product(gaps, repeat=len(kinds) + 1):
            roles = "".join(i + e[1] for i, e in zip(ins, edits)) + ins[-1]
            if LEGAL.fullmatch(roles):
                audit = "".join("I" * len(i) + e[0] for i, e in zip(ins, edits)) + "I" * len(ins[-1])
                found = (sum(e[2] for e in edits) + 5 * sum(map(len, ins)), audit)
                best = min(best, found) if best else found
    return best


def test_shortest_path_equals_enumeration():
    kinds = list(itertools.product("sua ", ("", "truncated", "blank")))
    rng = random.Random(3)
    cases = [()] + [(k,) for k in kinds] + [tuple(rng.choices(kinds, k=n)) for n in (2, 2, 2, 3, 3, 3, 3) for _ in range(6)]
    for case in cases:
        assert cr.ended(cr.paths(0, list(case))) == enumerated(case), case


def test_blocks_combine_to_the_same_path():
    rng = random.Random(4)
    for _ in range(200):
        kinds = [(rng.choice("sua "), rng.choice(("", "", "truncated", "duplicate"))) for _ in range(rng.randint(0, 12))]
        cut = rng.randint(0, len(kinds))
        joined = {}
        for at, (cost, label) in cr.paths(0, kinds[:cut]).items():
            for to, (price, more) in cr.paths(at, kinds[cut:]).items():
                joined[to] = min(joined.get(to, (1 << 60, "")), (cost + price, label + more))
        assert joined == cr.paths(0, kinds)


def plain(rows):
    """{conv_id: result} of (conv_id, turn, role, text) by plain Python, with the repair from the rows' shortest path."""
    groups = {}
    for conv, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        held = groups.setdefault(conv, [])
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        held += [(turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    out = {}
    for conv, held in groups.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        kinds, seen = [], set()
        for _, role, text in held:
            fault = cr.fault_of(text, (role, text) in seen)
            seen.add((role, text))
            kinds.append((role[:1] or " ", fault))
        cost, audit = cr.ended(cr.paths(0, kinds))
        lines, at, roles = [], 0, ""
        for edit in audit:
            wanted = "user" if roles[-1:] in ("", "s", "a") else "assistant"
            role, text = ("", "") if edit == "I" else held[at][1:]
            at += edit != "I"
            if edit != "D":
                lines.append((role if edit == "K" else wanted) + ":" + text)
                roles += lines[-1][0]
        assert LEGAL.fullmatch(roles) and at == len(held)
        turns = {t for t, *_ in held if t is not None}
        pairs = [a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:])]
        faults = [f for _, f in kinds]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def rows_of(seed, n=600):
    rng = random.Random(seed)
    texts = ["Hi.", "Hi", "", " \n", "\x1c", "What?", "Fine!", "é.", None, "a. b", "x" * 3000 + "."]
    rows = []
    for _ in range(n):
        conv = rng.choice([None, 1, 1, 1, 1, 2, 3, 4, *range(10, 60)])
        rows.append((conv, rng.choice([None, *range(-3, 12), 10**12]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(texts)))
    rows += [(0, 0, "user", "Dropped.")] if zlib.crc32(b"0:0") % 20 == 0 else []
    rows += [(next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0), 0, "user", "Dropped.")]
    return rows + rows[:25]


def results(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_rows_equal_plain_python_and_sql(spark):
    rows = rows_of(1)
    want = plain(rows)
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], KIND).repartition(5)
    assert (got := results(cr.repair(df))) == want
    assert got[rows[-26][0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    duck = duckdb.connect()
    duck.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert {r[0]: r[1:] for r in duck.execute(cr.oracle_sql()).fetchall()} == want


@pytest.mark.parametrize("limits", [{"long_rows": 0, "block_rows": 1}, {"long_rows": 5, "block_rows": 3}, {"long_bytes": 100, "block_rows": 7}])
def test_long_conversations_equal_short_ones(spark, limits):
    rows = rows_of(2)
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], KIND).repartition(5)
    assert results(cr.repair(df, **limits)) == plain(rows)


def test_one_hot_conversation(spark):
    rows = [(5, i // 2, ("user", "assistant", "system")[i % 3], f"Text {i % 40}{'.' if i % 4 else ''}") for i in range(6000)]
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], KIND).repartition(4)
    assert results(cr.repair(df)) == plain(rows)


def test_empty_table(spark):
    df = cr.repair(spark.createDataFrame([], KIND))
    assert df.count() == 0 and df.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
