"""Document fingerprints by randomised edit embedding: shared random walks map edit distance to Hamming distance.

Embedding. A walk reads a text from its start; at step j it writes down the character class it stands on and moves on
by a bit that depends only on j and that class, the same bits for all texts. Two texts that differ by few edits walk
apart at an edit and soon meet again, so the strings that they write differ in few places.

Sampling. A text of n characters writes 2 n steps. A fingerprint holds SLOTS of them, 4 bits each: slot k takes the
step below 2 n that has the least random rank in an order of its own, so texts of about the same length sample mostly
the same steps. The likeness of two fingerprints is the share of slots that agree, an estimate of 1 minus the Hamming
distance of the embeddings (unrelated texts agree by chance in about a tenth).

Search. near_copies() cuts fingerprints into blocks of slots and these into groups; documents that agree in several blocks
of a group are candidates and are verified on all slots. There are so few groups that near copies, which differ in few
slots, agree in as many blocks of one of them: no link is missed. The blocks of a key are as many as its number of keys
allows, so that unrelated documents seldom meet; keys are taken in several passes, and the disk that one needs is free
again for the next. Equal fingerprints are one class; only classes meet.

Neighbours. edited() needs each document's follower by doc_id: documents are dealt to buckets by quantiles of doc_id
and sorted there, and the first document of each bucket is also sent to the bucket before it. One shuffle of the texts,
compressed, each bucket to a partition of its own; a task sees its rows one at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freed, saved, texts
from .components import components

SLOTS = 256
CLASSES = 256
PAD = CLASSES - 1
PERIOD = 8192
SEED = 20240229
#: Steps that are walked before their samples are read out, and characters walked at once.
STEPS = 128
BLOCK = 12_000_000
BUCKET_ROWS, MAX_BUCKETS = 4_000, 40_000
#: Least likeness of near copies, and the blocks that a fingerprint is cut into, more where a lower likeness needs them.
LEAST, BANDS = 0.8, 80
#: The most keys of a fingerprint, and those of one pass.
KEYS, PASS_KEYS = 300, 80
#: Up to so many classes of several documents (some 160 bytes each) are broadcast to the rows; beyond, they are joined by shuffle.
BROADCAST_CLASSES = 200_000


def random_words(n: int, seed: int) -> np.ndarray:
    """n 64-bit words by the splitmix64 rule."""
    z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def walk_bits() -> np.ndarray:
    """Whether a walk moves on, by step (modulo PERIOD) and class; it stays where a text has ended."""
    bits = (random_words(PERIOD * CLASSES, SEED) >> np.uint64(63)).astype(np.uint8).reshape(PERIOD, CLASSES)
    bits[:, PAD] = 0
    return bits


def record_steps() -> list[np.ndarray]:
    """Of each slot: the steps that have a lower rank than all before them. The last below 2 n is the step sampled.

    The gaps between records of independent uniform ranks are geometric with the lowest rank so far, and the next
    record is uniform below it; they are drawn so, up to 2 ** 40 steps.
    """
    u = iter((random_words(SLOTS * 256, SEED + 1) >> np.uint64(11)).astype(np.float64) / 2.0**53)
    found = []
    for _ in range(SLOTS):
        at, low, steps = 0, next(u), [0]
        while at < 1 << 40 and len(steps) < 100:
            at += 1 + int(math.log(1 - next(u)) / math.log1p(-max(low, 1e-13)))
            low *= next(u)
            steps.append(at)
        found.append(np.array(steps, np.int64))
    return found


_tables: dict[str, object] = {}


def tables() -> tuple[np.ndarray, list[np.ndarray]]:
    if not _tables:
        _tables["bits"], _tables["records"] = walk_bits(), record_steps()
    return _tables["bits"], _tables["records"]


def char_classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return ((codes * np.uint32(0x9E3779B1)) >> np.uint32(16)).__mod__(np.uint32(PAD)).astype(np.uint8)


def fingerprints(strings: list[str]) -> list[str]:
    """A hexadecimal digit for each slot. All walks of the list go a step at a time, the longest texts first."""
    bits, records = tables()
    order = sorted(range(len(strings)), key=lambda i: -len(strings[i]))
    n = np.array([len(strings[i]) for i in order], np.int64)
    buffer = np.full(int(n.sum()) + len(n), PAD, np.uint8)
    begins = np.concatenate([[0], np.cumsum(n + 1)[:-1]]) if len(n) else n
    for i, a, size in zip(order, begins, n):
        buffer[a : a + size] = char_classes(strings[i])
    digits = np.full((len(n), SLOTS), PAD, np.uint8)
    filled = int((n > 0).sum())
    sampled = np.stack([r[np.searchsorted(r, 2 * n[:filled]) - 1] for r in records], axis=1)
    block = (sampled // STEPS).ravel()
    by_block = np.argsort(block, kind="stable")
    block = block[by_block]
    at = begins.copy()
    seen = np.empty((STEPS, len(n)), np.uint8)
    flat = digits.reshape(-1)
    for k in range(-(-2 * int(n[0]) // STEPS) if filled else 0):
        active = int(np.searchsorted(-2 * n, -k * STEPS))  # texts that still have steps to write
        here = at[:active]
        for t in range(STEPS):
            classes = seen[t, :active]
            buffer.take(here, out=classes, mode="clip")
            here += bits[(k * STEPS + t) % PERIOD].take(classes)
        a, b = np.searchsorted(block, (k, k + 1))
        if a < b:
            events = by_block[a:b]
            walker = events // SLOTS
            flat[events] = seen[sampled.reshape(-1)[events] - k * STEPS, walker]
    shown = np.frombuffer(b"0123456789abcdef", np.uint8)[digits & 15]
    out = [""] * len(strings)
    for row, i in enumerate(order):
        out[i] = shown[row].tobytes().decode()
    return out


def likeness(a: str, b: str) -> float:
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    return float((x == y).mean())


def edited_text(text: str, following: str) -> str:
    """The last floor(n / 4) characters replaced by the first as many, or all, of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _bucketed(docs: DataFrame) -> DataFrame:
    """(bucket, last, doc_id, tie, packed) sorted within partitions; `last` marks the copy of the next bucket's first document."""
    spark = docs.sparkSession
    named = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    count = named.count()
    n = max(1, min(MAX_BUCKETS, count // BUCKET_ROWS))
    shares = [i / n for i in range(1, n)]
    bounds = named.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), F.lit(min(max(10_000, 20 * n), 200_000))).alias("b")).first()["b"] if shares and count else []
    cuts = np.unique(np.array(bounds or [], np.int64))

    @F.pandas_udf(T.IntegerType())
    def bucket(doc_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, doc_id.to_numpy(np.int64), "right").astype(np.int32))

    firsts = sorted((r["bucket"], r["first"]) for r in named.groupBy(bucket("doc_id").alias("bucket")).agg(F.min("doc_id").alias("first")).collect())  # MAX_BUCKETS rows at most
    follow = [(b, firsts[(i + 1) % len(firsts)][1]) for i, (b, _) in enumerate(firsts)]
    heads = F.broadcast(spark.createDataFrame(follow, "bucket int, doc_id long"))
    lasts = named.join(heads, "doc_id").select("bucket", F.lit(True).alias("last"), "doc_id", F.xxhash64("text").alias("tie"), "text")
    each = named.select(F.lit(-1).alias("bucket"), F.lit(False).alias("last"), "doc_id", F.xxhash64("text").alias("tie"), "text")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            own = np.searchsorted(cuts, batch["doc_id"].to_numpy(np.int64), "right").astype(np.int32)
            batch["bucket"] = np.where(batch["last"], batch["bucket"], own)
            batch["packed"] = [compress(t.encode()) for t in batch["text"]]
            yield batch.drop(columns="text")

    both = each.unionByName(lasts).mapInPandas(pack, "bucket int, last boolean, doc_id long, tie long, packed binary")
    return both.repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("bucket", "last", "doc_id", "tie", "packed")


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The next row is the next by doc_id, then by a hash of the text (repeated rows follow each other), and after the last
    the first; a single document follows itself. A row without doc_id has no next one: nothing replaces its last quarter, and its
    near_next is 0. Null texts are empty; empty texts have a fingerprint of their own, and equal texts equal ones.
    """
    kind = docs.schema["doc_id"].dataType
    columns = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]

    def described(rows: list[tuple], following: list[str | None]) -> pd.DataFrame:
        changed = [edited_text(t, f or "") for (_, t), f in zip(rows, following)]
        prints = fingerprints([t for _, t in rows] + [f for f in following[-1:] if f is not None] + changed)
        own, after, other = prints[: len(rows)], prints[1 : len(rows) + 1], prints[len(prints) - len(rows) :]
        out = []
        for (doc_id, t), f, c, p, q, e in zip(rows, following, changed, own, after, other):
            out.append((doc_id, len(t), hashlib.sha256(c.encode()).hexdigest(), p, e, likeness(p, e), likeness(p, q) if f is not None else 0.0))
        return pd.DataFrame(out, columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        size, where = 0, None
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for b, last, doc_id, packed in zip(batch["bucket"], batch["last"], batch["doc_id"], batch["packed"]):
                text = unpack(packed).decode()
                if b == where and last:  # ties of the next bucket's first id sort behind its first text
                    if rows:
                        yield described(rows, [t for _, t in rows[1:]] + [text])
                    rows, size = [], 0
                    continue
                where = b
                if size > BLOCK and rows:
                    yield described(rows, [t for _, t in rows[1:]] + [text])
                    rows, size = [], 0
                rows.append((doc_id, text))
                size += len(text)

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in zip(batch["doc_id"], batch["text"]):
                yield described([row], [None])

    placed = _bucketed(docs).mapInPandas(run, f"doc_id long, {columns}") if not docs.isEmpty() else docs.select(F.col("doc_id").cast("long"), *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in columns.split(", "))).limit(0)
    rest = texts(docs).where("doc_id IS NULL").select(F.lit(None).cast("string").alias("doc_id"), "text").mapInPandas(alone, f"doc_id string, {columns}")
    return placed.withColumn("doc_id", F.col("doc_id").cast(kind)).unionByName(rest.withColumn("doc_id", F.col("doc_id").cast(kind)))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fingerprint": fingerprints(batch["text"].tolist())})

    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id IS NOT NULL")
    return rows.mapInPandas(run, "doc_id long, fingerprint string")


#: Hexadecimal digits that a long holds; a fingerprint is this many longs.
DIGITS = 16
LONGS = SLOTS // DIGITS


def as_longs(hexadecimal: Column) -> list[Column]:
    """A fingerprint's digits as longs f0, f1, ..., DIGITS to each."""
    return [F.conv(F.substring(hexadecimal, 1 + i * DIGITS, DIGITS), 16, -10).cast("long").alias(f"f{i}") for i in range(LONGS)]


def likeness_of(a: str, b: str) -> Column:
    """The share of slots in which the longs of rows aliased a and b agree: a digit differs where any of its four bits does."""

    def differing(i: int) -> Column:
        x = F.col(f"{a}.f{i}").bitwiseXOR(F.col(f"{b}.f{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    return F.lit(1.0) - reduce(lambda x, y: x + y, map(differing, range(LONGS))) / F.lit(SLOTS)


#: A band in which more pairs than this would meet in the second round is split.
SPLIT_PAIRS = 10_000
#: About the most keys that a row of a split band gets, and the largest share of a band's rows that may agree in a slot that tells them apart.
SPLIT_KEYS, SPLIT_SHARE = 160, 0.5


def differing(least: float) -> int:
    """The most slots in which fingerprints of a likeness of `least` differ."""
    return int((1 - least) * SLOTS + 1e-9)


def block_sets(blocks: int, differ: int, together: int = 2) -> list[tuple[int, ...]]:
    """Sets of `together` blocks of which any two fingerprints that differ in at most `differ` blocks agree in one.

    At least blocks - differ agree; in groups so few that they can't have less than `together` of these each, one has as many.
    """
    groups = (blocks - differ - 1) // (together - 1)
    return [s for k in range(groups) for s in combinations(range(k, blocks, groups), together)]


def widest_sets(blocks: int, differ: int) -> list[tuple[int, ...]]:
    """block_sets() of as many blocks together as give at most KEYS sets; of two where no number does."""

    def number(together: int) -> int:
        groups = (blocks - differ - 1) // (together - 1)
        return sum(math.comb(len(range(k, blocks, groups)), together) for k in range(groups)) if groups else KEYS + 1

    together = 2
    while number(together + 1) <= KEYS:
        together += 1
    return block_sets(blocks, differ, together)


def split_slots(slots: list[int], telling: int, rows: int, differ: int) -> list[list[int]]:
    """Lists of slots of which fingerprints that differ in at most `differ` slots agree in one; `slots`, the most telling ones first.

    Some four slots for each thousandfold of rows, so that unrelated rows meet a constant number of times: as many
    groups of single slots as can't all differ where these are wide enough, else pairs of blocks.
    """
    used = slots[: max(telling, 2 * (differ + 1))]
    width, single = max(2, math.ceil(math.log(max(rows, 2)) / math.log(6.0))), differ + 1
    if len(used) < differ + 2 or len(used) // single >= width:
        return [used[i::single] for i in range(min(single, len(used)))]
    blocks = min(len(used), max(differ + 2, 2 * len(used) // width))
    while blocks < len(used) and len(block_sets(blocks, differ)) > SPLIT_KEYS:
        blocks += 1
    return [used[i::blocks] + used[j::blocks] for i, j in block_sets(blocks, differ)]


def digits() -> Column:
    """The slots of a row's longs f0, f1, ... as an array."""
    longs = F.array(*(F.col(f"f{i}") for i in range(LONGS)))
    return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: F.call_function("shiftrightunsigned", F.get(longs, F.floor(s / DIGITS).cast("int")), (F.lit(60) - F.lit(4) * (s % DIGITS)).cast("int")).bitwiseAND(F.lit(15)).cast("int"))


def split_bands(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """`rows` (key, id, f0, f1, ...) of bands with many documents, under `split` keys instead; any that are linked share one.

    What a band's documents have in common beyond the band, such as a common head, tells none apart. So keys are read
    from the slots in which no digit is that of most rows, as split_slots() deals them.
    """
    at = rows.select("key", F.posexplode(digits()).alias("slot", "digit")).groupBy("key", "slot", "digit").count()
    slots = at.groupBy("key", "slot").agg((F.max("count") / F.sum("count")).alias("share"), F.sum("count").alias("m"))
    ordered = slots.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("share", "slot"))).alias("slots"), F.count_if(F.col("share") <= SPLIT_SHARE).alias("telling"), F.max("m").alias("m"))

    @F.udf("array<array<int>>")
    def dealt(slots: list[int], telling: int, m: int) -> list[list[int]]:
        return split_slots(slots, telling, m, differing(least))

    lists = ordered.select("key", dealt(F.transform("slots", lambda x: x["slot"]), "telling", "m").alias("lists_"))
    own = lambda l, i: F.xxhash64("key", i, F.transform(l, lambda s: F.get("digits_", s)))  # noqa: E731, E741
    keyed = rows.join(lists, "key").withColumn("digits_", digits())
    return keyed.withColumn("split", F.explode(F.transform("lists_", own))).drop("lists_", "digits_")


def band_keys(classes: DataFrame, blocks: int, sets: list[tuple[int, ...]], first: int) -> DataFrame:
    """(id, key) of each row of `classes` (id, print) for each set of blocks: random words of the digits in its blocks, combined; `first` numbers the first set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = random_words(SLOTS * 16, SEED + 2).reshape(SLOTS, 16)
        salts = random_words(first + len(sets), SEED + 3)[first:]
        begins = [i * SLOTS // blocks for i in range(blocks)]
        for batch in batches:
            if batch.num_rows:
                read = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint8).reshape(-1, SLOTS // 2)
                digit = np.stack([read >> 4, read & 15], axis=2).reshape(-1, SLOTS)
                block = np.bitwise_xor.reduceat(words[np.arange(SLOTS), digit], begins, axis=1).T.copy()
                keys = np.stack([reduce(np.bitwise_xor, (block[i] for i in s), salt) for s, salt in zip(sets, salts)], axis=1)
                ids = np.repeat(batch.column("id").to_numpy(), len(sets))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.reshape(-1).view(np.int64))], names=["id", "key"])

    return classes.select("id", "print").mapInArrow(run, "id long, key long")


def with_prints(rows: DataFrame, told: DataFrame) -> DataFrame:
    """`rows` (id, component, key, main) with the longs of `told` (id, f0, f1, ...): a document joins once, with all of its keys, which are KEYS at most."""
    gathered = rows.groupBy("id", "component").agg(F.collect_list(F.struct("key", "main")).alias("keys_"))
    return gathered.join(told, "id").select("id", "component", *(f"f{i}" for i in range(LONGS)), F.inline("keys_"))


def classed(prints: DataFrame, least: float, bands: int, split_pairs: int = SPLIT_PAIRS) -> DataFrame:
    """(print, component_id) of those distinct fingerprints of `prints` (doc_id, print) that several documents have or that are linked.

    A band is what has a set of blocks in common. Each class is compared with the smallest id of each of its bands;
    then, under each band, those of different components are compared with one another, in bands with many of them under
    keys that split these. Pairs are verified on all slots before they leave the join, so that only links do, however many
    documents a band has.
    """
    classes = saved(prints.groupBy("print").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "fingerprint-classes")
    differ = differing(least)
    blocks = min(SLOTS, max(bands, differ + 12))
    sets = widest_sets(blocks, differ)
    told = classes.select("id", *as_longs(F.hex("print")))
    near = likeness_of("a", "b") >= least
    passes = []
    for at in range(0, len(sets), PASS_KEYS):
        freed(prints.sparkSession)
        dealt = band_keys(classes, blocks, sets[at : at + PASS_KEYS], at).repartition("key")
        shared = dealt.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub < top").drop("top")
        own = saved(dealt.join(shared, "key"), "bands")
        met_hub = own.where("id > hub").select("hub", "id").distinct().alias("m")  # prints are joined to pairs, not to rows of bands, which are more
        met_hub = met_hub.join(told.alias("a"), F.col("a.id") == F.col("m.hub")).join(told.alias("b"), F.col("b.id") == F.col("m.id"))
        passes.append((own, saved(met_hub.where(near).select("m.hub", "m.id"), "met-hubs")))
    rows, found = (reduce(DataFrame.union, tables) for tables in zip(*passes))
    found = found.distinct()
    # A document's first hub stands for it: its other hubs are linked with that one, which is the same component in fewer edges.
    first = F.min("hub").over(Window.partitionBy("id"))
    links = found.select(first.alias("a"), F.when(F.col("hub") == first, F.col("id")).otherwise(F.col("hub")).alias("b")).distinct()
    links = saved(links, "links")
    # A band's hub has been compared with each of its rows, so only the others are left to meet.
    placed = rows.where("id > hub").drop("hub").join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = placed.groupBy("key", "component").count()
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("n")).where("n > 1").drop("n")
    mixed = saved(with_prints(placed.join(main, "key"), told), "mixed-bands")
    load = mixed.groupBy("key").agg(F.count("*").alias("m"), F.count_if(F.col("component") != F.col("main")).alias("apart_"))
    hot = saved(load.where(F.col("m") * F.col("apart_") > split_pairs).select("key"), "hot-bands")
    apart = (F.col("a.component") != F.col("b.component")) & ((F.col("b.component") == F.col("b.main")) | (F.col("a.id") < F.col("b.id")))

    def met(rows: DataFrame, by: str) -> DataFrame:
        a, b = rows.where("component <> main").alias("a"), rows.alias("b")
        return a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & apart & near).select(F.col("a.id").alias("a"), F.col("b.component").alias("with"), F.col("b.id").alias("b"))

    found = met(mixed.join(hot, "key", "left_anti"), "key")
    if not hot.isEmpty():
        found = found.unionByName(met(saved(split_bands(mixed.join(hot, "key", "left_semi"), least), "split-bands"), "split"))
    # One link of a document with each component is enough: what is in it hangs together already.
    more = found.groupBy("a", "with").agg(F.min("b").alias("b")).select("a", "b")
    groups = components(links.union(more)).withColumnRenamed("component", "component_id")
    of = classes.join(groups, "id", "left").select("print", "n", F.coalesce("component_id", "id").alias("component_id"), F.col("component_id").isNotNull().alias("linked"))
    return of.where("n > 1 OR linked").select("print", "component_id")


def _with_components(rows: DataFrame, least: float, bands: int) -> DataFrame:
    """`rows` (doc_id, fingerprint, ...; saved) with component_id; that of a row without doc_id is null."""
    rows = rows.withColumn("print", F.unhex("fingerprint"))
    groups = saved(classed(rows.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "print"), least, bands), "fingerprint-groups")
    if groups.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES:
        groups = F.broadcast(groups)
    own = F.coalesce("component_id", F.col("doc_id").cast("long"))
    return rows.join(groups, "print", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), own)).drop("print")


def near_copies(docs: DataFrame, least: float = LEAST, bands: int = BANDS) -> DataFrame:
    """doc_id, component_id: documents joined by chains of likeness of at least `least`.

    Rows without doc_id can't be named and are left out.
    """
    return _with_components(saved(fingerprinted(docs), "fingerprints"), least, bands).select("doc_id", "component_id")


def edited_and_grouped(docs: DataFrame, least: float = LEAST, bands: int = BANDS) -> DataFrame:
    """The columns of edited() and component_id: the smallest doc_id that chains of near copies lead to."""
    return _with_components(saved(edited(docs), "edited"), least, bands)
