"""Structure repair of conversations by composing weighted finite-state machines.

The rows of a conversation, after damage, are a linear input acceptor. An edit transducer maps each row: Keep, Rerole to
user or assistant, Delete; and it may Insert an empty turn anywhere. An acceptor of roles admits a system turn at most,
then pairs of user and assistant. The three are composed lazily: a state is (row, state of the roles), and arcs are made
when a path first meets that kind of row in that state. The repair is the shortest path over weights (cost, string of
the edits' initials), in the order of rows, which is topological: inserts come before the row that follows them, so
every step ends in the one edit of its row.

Weights are compared as pairs, strings as ASCII. Paths over the same rows end in a row's edit and have the same number
of these, so none is a proper prefix of another, and the smaller one stays smaller whatever follows: steps and whole
blocks of rows can be combined in any grouping. Conversations up to a bound are folded in one go. Longer ones are cut
into blocks: each gives its best weights from every state to every state, blocks are combined in order, and the texts
are hashed in a stream, so no task holds a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Conversations of more rows or bytes than these are cut into blocks of at most BLOCK_ROWS rows and BLOCK_CHARS characters.
LONG_ROWS, LONG_BYTES = 2_000, 4_000_000
BLOCK_ROWS, BLOCK_CHARS = 256, 1_000_000
#: The ids of long conversations are broadcast up to this number, and joined by a shuffle beyond.
BROADCAST_IDS = 100_000

#: The acceptor of role initials: (s?(ua)+)?
ROLES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = frozenset({0, 3})
NAMES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

Weight = tuple[int, str]
_BLANK = re.compile(r"[^\x20\x09-\x0D]")
_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_FIELDS = [f.split()[0] for f in RESULT.split(", ")]


def edits(initial: str, fault: str) -> Iterator[tuple[str, str, int]]:
    """Arcs of the edit transducer for one row: (initial of the edit, role initial that it gives or '', cost)."""
    yield "D", "", DELETE
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        yield "K", initial, KEEP + more
        for role in NAMES:
            yield "R", role, REROLE + more


@lru_cache(None)
def inserted(state: int) -> dict[int, Weight]:
    """Best weights from a state to any other by inserts alone; none is worth a second visit to a state."""
    best: dict[int, Weight] = {state: (0, "")}
    for _ in ROLES:
        for at, (cost, label) in list(best.items()):
            for role in NAMES:
                if (to := ROLES[at].get(role)) is not None:
                    best[to] = min(best.get(to, (1 << 60, "")), (cost + INSERT, label + "I"))
    return best


@lru_cache(None)
def step(state: int, initial: str, fault: str) -> dict[int, Weight]:
    """Best weights from a state through one row: inserts before it, then its edit. Composed when first asked for."""
    best: dict[int, Weight] = {}
    for at, (cost, label) in inserted(state).items():
        for edit, role, price in edits(initial, fault):
            to = at if edit == "D" else ROLES[at].get(role)
            if to is not None and (to not in best or (cost + price, label + edit) < best[to]):
                best[to] = (cost + price, label + edit)
    return best


def paths(start: int, kinds: list[tuple[str, str]]) -> dict[int, Weight]:
    """Best weights from a state to every state through rows given by (role initial, fault)."""
    best: dict[int, Weight] = {start: (0, "")}
    for kind in kinds:
        after: dict[int, Weight] = {}
        for at, (cost, label) in best.items():
            for to, (price, more) in step(at, *kind).items():
                found = (cost + price, label + more)
                if to not in after or found < after[to]:
                    after[to] = found
        best = after
    return best


def ended(best: dict[int, Weight]) -> Weight:
    """The best of the weights once inserts have led each to a final state."""
    return min((cost + price, label + more) for at, (cost, label) in best.items() for to, (price, more) in inserted(at).items() if to in FINAL)


def fault_of(text: str, repeated: bool) -> str:
    """A row's first fault."""
    if not _BLANK.search(text):
        return "blank"
    if repeated:
        return "duplicate"
    return "" if text.rstrip(_WHITE)[-1] in ".!?" else "truncated"


def initial_of(role: str) -> str:
    """The role's first character; an empty role has none that a state admits, so it can't be kept."""
    return role[:1] or " "


class Writer:
    """Applies an audit to rows in order and hashes what comes out."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.any = audit, 0, 0, False
        self.hash = hashlib.sha256()

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True
        self.state = ROLES[self.state][initial_of(role)]

    def next_role(self) -> str:
        """The role that an insert or a new role gives: the only one of user and assistant that the state admits."""
        return next(NAMES[r] for r in NAMES if r in ROLES[self.state])

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.line(self.next_role(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.line(role if edit == "K" else self.next_role(), text)

    def digest(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


class Summary:
    """Counts over rows in order, which can be joined to those of the rows that follow."""

    def __init__(self) -> None:
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.turns = 0, 0
        self.first = self.last = ""
        self.low = self.high = None

    def row(self, turn: int | None, initial: str, fault: str) -> None:
        if fault:
            self.faults[fault] += 1
        self._follow(initial, turn, turn, int(turn is not None), initial)

    def _follow(self, first: str, low: int | None, high: int | None, turns: int, last: str) -> None:
        self.illegal += bool(self.last) and self.last + first not in ("su", "ua", "au")
        self.first, self.last = self.first or first, last
        if low is not None:
            self.turns += turns - (low == self.high)
            self.low, self.high = low if self.low is None else self.low, high

    def follow(self, block: dict[str, Any]) -> None:
        for k in self.faults:
            self.faults[k] += block[k]
        self.illegal += block["illegal"]
        self._follow(block["first"], block["low"], block["high"], block["turns"], block["last"])

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def parts(self) -> dict[str, Any]:
        return self.faults | {"illegal": self.illegal, "turns": self.turns, "first": self.first, "last": self.last, "low": self.low, "high": self.high}


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, sha, gone) after damage; a dropped row stays as one that is gone, so that its conversation is known.

    A null is one space wherever it is read as text; a null turn sorts first.
    """
    fate = F.pmod(F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate").isin(0, 1), "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") == 0).alias("gone"), copies)
    return out.select("conv_id", "turn", "role", "text", F.sha2("text", 256).alias("sha"), "gone")


def _folded(rows: DataFrame, kind: str) -> DataFrame:
    """Results of conversations that fit one task each: all rows of a conversation meet, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = None
        held: list[tuple[int | None, str, str]] = []
        started = False

        def result() -> list:
            seen: set[tuple[str, str]] = set()
            counts, kinds = Summary(), []
            for turn, role, text in held:
                fault = fault_of(text, (role, text) in seen)
                seen.add((role, text))
                counts.row(turn, initial_of(role), fault)
                kinds.append((initial_of(role), fault))
            cost, audit = ended(paths(0, kinds))
            writer = Writer(audit)
            for _, role, text in held:
                writer.row(role, text)
            return [now, counts.gaps(), *counts.faults.values(), counts.illegal, cost, audit, writer.digest()]

        out: list[list] = []
        for batch in batches:
            for conv, turn, role, text, gone in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if started and conv != now:
                    out.append(result())
                    held = []
                now, started = conv, True
                if not gone:
                    held.append((turn, role, text))
            yield _table(out)
            out = []
        if started:
            yield _table([result()])

    sorted_rows = rows.repartition("conv_id").sortWithinPartitions(*_order())
    return sorted_rows.select(F.col("conv_id").cast("string"), "turn", "role", "text", "gone").mapInArrow(run, f"conv_id string, {RESULT}").withColumn("conv_id", F.col("conv_id").cast(kind))


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("sha").asc()]


def _table(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["conv_id", *_FIELDS])


_BEST = pa.list_(pa.struct([("start", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("label", pa.string())]))
_BLOCK = pa.schema(
    [("conv_id", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("sha", pa.string()), ("block", pa.int64())]
    + [(k, pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal", "turns")]
    + [("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("best", _BEST)]
    + [("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
)
_BLOCK_KIND = (
    "conv_id string, turn long, role string, sha string, block long, blank long, duplicate long, truncated long, illegal long, turns long, first string,"
    " last string, low long, high long, best array<struct<start:int,to:int,cost:long,label:string>>, roles array<string>, texts array<string>"
)


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of the rows of long conversations, which are sorted over all partitions, each with its weights and texts.

    A row is a duplicate if it is not the first of its conversation, role and text; rows that are alike in all that
    orders them lie next to each other in one partition, where the second and later ones are seen.
    """
    keys = [F.col(c).alias(f"first_{c}") for c in ("conv_id", "role", "sha")]
    first = rows.groupBy(*keys).agg(F.min(F.struct("turn")).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("first_conv_id")) & (F.col("role") == F.col("first_role")) & (F.col("sha") == F.col("first_sha"))
    marked = rows.join(first, same).select("conv_id", "turn", "role", "sha", "text", (F.struct("turn") != F.col("first")).alias("again"))
    ordered = marked.repartitionByRange(*_order()).sortWithinPartitions(*_order())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, number, before = 0, 0, None

        def block() -> pa.RecordBatch:
            counts, kinds = Summary(), []
            for _, turn, role, _, text, repeated in held:
                kinds.append((initial_of(role), fault_of(text, repeated)))
                counts.row(turn, *kinds[-1])
            best = [{"start": s, "to": t, "cost": c, "label": w} for s in ROLES for t, (c, w) in paths(s, kinds).items()]
            head = {"conv_id": held[0][0], "turn": held[0][1], "role": held[0][2], "sha": held[0][3], "block": number}
            row = head | counts.parts() | {"best": best, "roles": [r[2] for r in held], "texts": [r[4] for r in held]}
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        for batch in batches:
            for conv, turn, role, sha, text, repeated in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if held and (conv != held[0][0] or len(held) >= block_rows or size > BLOCK_CHARS):
                    yield block()
                    held, size, number = [], 0, number + 1
                key = (conv, turn, role, sha)
                held.append((*key, text, repeated or key == before))
                size, before = size + len(text), key
        if held:
            yield block()

    return ordered.withColumn("conv_id", F.col("conv_id").cast("string")).mapInArrow(run, _BLOCK_KIND)


def _block_order() -> list[Column]:
    return [*_order(), F.col("block").asc_nulls_first()]


def _joined(blocks: DataFrame) -> DataFrame:
    """Counts, cost and audit of long conversations from their blocks in order; a task holds the best way to each state.

    The ways to different states differ, and none is a prefix of another, so their rank and the label that a block adds
    are enough to compare them; labels are kept as links to what came before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = None
        started = False
        counts = Summary()
        best: dict[int, tuple[int, int, Any]] = {}

        def result() -> list:
            def string(way: Any) -> str:
                parts = []
                while way:
                    way, part = way
                    parts.append(part)
                return "".join(reversed(parts))

            cost, audit = ended({at: (c, string(way)) for at, (c, _, way) in best.items()})
            return [now, counts.gaps(), *counts.faults.values(), counts.illegal, cost, audit, ""]

        out: list[list] = []
        for batch in batches:
            for row in batch.to_pylist():
                if not started or row["conv_id"] != now:
                    if started:
                        out.append(result())
                    now, started, counts, best = row["conv_id"], True, Summary(), {0: (0, 0, None)}
                counts.follow(row)
                after: dict[int, tuple] = {}
                for x in row["best"]:
                    if x["start"] in best:
                        cost, rank, way = best[x["start"]]
                        found = (cost + x["cost"], rank, x["label"], way)
                        if x["to"] not in after or found[:3] < after[x["to"]][:3]:
                            after[x["to"]] = found
                ranks = {at: i for i, at in enumerate(sorted(after, key=lambda at: after[at][1:3]))}
                best = {at: (cost, ranks[at], (way, label)) for at, (cost, _, label, way) in after.items()}
            yield _table(out)
            out = []
        if started:
            yield _table([result()])

    return blocks.drop("roles", "texts").repartition("conv_id").sortWithinPartitions(*_block_order()).mapInArrow(run, f"conv_id string, {RESULT}")


def _hashed(blocks: DataFrame, results: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of long conversations: each one's audit and then its blocks stream through a task, a block at a time.

    SHA-256 is defined from the first byte to the last, so a conversation's texts can't be hashed apart.
    """
    nothing = F.lit(None).cast("array<string>")
    heads = results.select("conv_id", F.lit(0).alias("kind"), "audit", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("sha", "string"), ("block", "long"))], nothing.alias("roles"), nothing.alias("texts"))
    rest = blocks.select("conv_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), "turn", "role", "sha", "block", "roles", "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, now = None, None
        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                conv, audit, roles, texts = (batch.column(k)[i].as_py() for k in range(4))
                if audit is not None:
                    if writer:
                        done.append((now, writer.digest()))
                    now, writer = conv, Writer(audit)
                else:
                    for role, text in zip(roles, texts):
                        writer.row(role, text)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], names=["conv_id", "repaired_sha256"])
        if writer:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([writer.digest()], pa.string())], names=["conv_id", "repaired_sha256"])

    order = [F.col("conv_id").asc_nulls_first(), "kind", *_block_order()[1:]]
    return heads.union(rest).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "audit", "roles", "texts").mapInArrow(run, "conv_id string, repaired_sha256 string")


def _long(rows: DataFrame, kind: str, block_rows: int) -> DataFrame:
    blocks = saved(_blocks(rows, block_rows), "conversation-blocks")
    results = saved(_joined(blocks), "conversation-audits")
    hashes = _hashed(blocks, results).withColumnRenamed("conv_id", "hashed_id")
    out = results.drop("repaired_sha256").join(hashes, F.col("conv_id").eqNullSafe(F.col("hashed_id"))).drop("hashed_id")
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))


def repair(conversations: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each conv_id of conversations (conv_id, turn, role, text; more columns are left out): counts of faults, cost and edits of the repair, hash of the repaired rows.

    A null conv_id is a conversation like others. Rows of the same turn are ordered by role and by SHA-256 of their
    text; rows alike in all of these are duplicates. A conversation without rows after damage has zeros, an empty audit
    and the hash of the empty string; an empty table gives no rows. Only a role with one of the initials s, u and a can
    be kept; an empty role has none.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = damaged(conversations)
    size = F.sum(F.octet_length("text") + F.octet_length("role"))
    long = saved(rows.groupBy(F.col("conv_id").alias("long_id")).agg(F.sum((~F.col("gone")).cast("long")).alias("n"), size.alias("bytes")).where((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select("long_id"), "long-conversations")
    many = long.count()
    if not many:
        return _folded(rows, kind)
    ids = F.broadcast(long) if many <= BROADCAST_IDS else long
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    apart = _long(rows.join(ids, same, "left_semi").where(~F.col("gone")).drop("gone"), kind, block_rows)
    return _folded(rows.join(ids, same, "left_anti"), kind).unionByName(apart)


def _plus(w: str, cost: int | str, label: str) -> str:
    return f"CASE WHEN {w} IS NOT NULL THEN {{'c': {w}.c + {cost}, 's': {w}.s || '{label}'}} END"


def _table_of_crc() -> str:
    """The 256 remainders of CRC-32 by its rule, as a SQL list."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0xEDB88320 * (n & 1)
        out.append(n)
    return "[" + ", ".join(f"{n}::BIGINT" for n in out) + "]"


def oracle_sql() -> str:
    """DuckDB SQL: the same edits as a recursion over each conversation's rows, with one weight for each state of the roles."""
    cut = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    free = "fault NOT IN ('blank', 'duplicate')"
    to_user = [_plus(f"i{q}", f"1 + {cut}", "R") for q in (0, 1, 3)]
    keep_user = [_plus(f"i{q}", cut, "K") for q in (0, 1, 3)]
    return rf"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s
  FROM conversations
), fated AS (
  SELECT b.*, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i::INT, 1))::BIGINT)),
    lambda a, x: xor(a >> 8, t.crc[1 + (xor(a, x) & 255)]))) % 20 AS fate
  FROM base b, (SELECT {_table_of_crc()} AS crc) t
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN fate = 0 THEN 0 WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
  FROM fated
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS k FROM damaged
), judged AS (
  SELECT *, substr(role, 1, 1) AS i,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) || substr(role, 1, 1) AS pair
  FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n
  FROM judged GROUP BY conv_id
), ways AS (
  SELECT conv_id, n, 0::BIGINT AS k, {{'c': 0::BIGINT, 's': ''}} AS w0, NULL::STRUCT(c BIGINT, s VARCHAR) AS w1, NULL::STRUCT(c BIGINT, s VARCHAR) AS w2,
    NULL::STRUCT(c BIGINT, s VARCHAR) AS w3
  FROM counted
  UNION ALL
  SELECT conv_id, n, k, {_plus("i0", 2, "D")},
    least({_plus("i1", 2, "D")}, CASE WHEN {free} AND i = 's' THEN {_plus("i0", cut, "K")} END),
    least({_plus("i2", 2, "D")}, CASE WHEN {free} AND i = 'u' THEN least({", ".join(keep_user)}) END, CASE WHEN {free} THEN least({", ".join(to_user)}) END),
    least({_plus("i3", 2, "D")}, CASE WHEN {free} AND i = 'a' THEN {_plus("i2", cut, "K")} END, CASE WHEN {free} THEN {_plus("i2", f"1 + {cut}", "R")} END)
  FROM (
    SELECT w.conv_id, w.n, j.k, j.i, j.fault, w0 AS i0, w1 AS i1, least(w2, {_plus("w0", 5, "I")}, {_plus("w1", 5, "I")}, {_plus("w3", 5, "I")}) AS i2,
      least(w3, {_plus("w2", 5, "I")}, {_plus("w0", 10, "II")}, {_plus("w1", 10, "II")}) AS i3
    FROM ways w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.k = w.k + 1
  )
), best AS (
  SELECT conv_id, least(w0, w3, {_plus("w2", 5, "I")}, {_plus("w1", 10, "II")}) AS w FROM ways WHERE k = n
), letters AS (
  SELECT conv_id, w.s AS audit, unnest(range(1, length(w.s) + 1)) AS p FROM best
), placed_letters AS (
  SELECT conv_id, p, substr(audit, p::INT, 1) AS letter, length(replace(substr(audit, 1, p::INT), 'I', '')) AS k, length(replace(substr(audit, 1, p::INT), 'D', '')) AS e FROM letters
), lines AS (
  SELECT l.*, j.role, j.text, j.i,
    max(CASE WHEN l.e = 1 AND l.letter = 'K' AND j.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS system
  FROM placed_letters l LEFT JOIN judged j ON l.letter <> 'I' AND j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.k = l.k
), written AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role || ':' || text
      ELSE CASE WHEN (e + system) % 2 = 1 THEN 'user:' ELSE 'assistant:' END || CASE WHEN letter = 'R' THEN text ELSE '' END END, chr(10) ORDER BY p) AS body
  FROM lines WHERE letter <> 'D' GROUP BY conv_id
)
SELECT a.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
  coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(b.w.c, 0)::BIGINT AS cost, coalesce(b.w.s, '') AS audit,
  sha256(coalesce(w.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM a.conv_id
"""
