"""Near-duplicate groups by an exact Jaccard join on word n-gram sets.

1. Order. n-grams are ordered rare-first: by the number of documents that have one, counted over all documents in a
   table of 2 ** SLOT_BITS counters that n-grams share by hash, then by hash. Any fixed order gives the same links;
   this one keeps what many documents share out of the prefixes. Each task fills a table of its own and tables are
   summed, so the counts don't depend on how documents are dealt to tasks, and their size is fixed.
2. Classes. Documents with the same set are one class, represented by its smallest doc_id.
3. Prefixes. Two sets with similarity t share an n-gram among the first n - ceil(t n) + 1 of each. Postings (n-gram,
   class, position) are counted by n-gram; those that only one class has are dropped.
4. Candidates pass, before they leave the join, the length filter and two filters that take the n-gram for the first
   that both sets have, which for one n-gram of each pair it is: the positional filter (only what stands from there on
   can be shared) and the suffix filter (of the members behind the n-gram the parities of how many fall in each of
   BUCKETS buckets are known; these differ in no more buckets than the suffixes differ in members, and all members
   before the n-gram differ).
5. Two rounds keep groups of near copies from becoming all pairs. First each class meets, under each of its prefix
   n-grams, only the class with the smallest id there. Links found so far give components. Then only classes of
   different components meet: under each n-gram and length class (sets that link are of the same or of neighbouring
   ones), those outside its most frequent component meet the others. Pairs tried in the first round are not tried
   again. What the second round leaves out joins classes that are in one component already, so components are exact.
6. Each distinct pair is verified once: by parities of the whole sets, of four buckets a member, then on the sets
   themselves, which only pairs that are nearly certain get as far as.

near_duplicates() needs no link inside a component but those that hold it together. links() gives all links between
classes, each verified once; their number grows with the square of a group of near copies, and so does its work.

A document without words is linked with nothing. A row without doc_id can't be named: it keeps its n_shingles, is
linked with nothing, and its component_id is null. Rows with the same doc_id are one document; if their texts differ,
it has the links of each of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, saved, texts
from .components import components
from .shingles import sets_of

#: The broadcast order is this many counters of 4 bytes: 8 MB, whatever the input.
SLOT_BITS = 21
#: Counters are summed over tasks in blocks of this many; so many tasks at most sum them.
SLOT_BLOCK, SUMMING_TASKS = 1 << 14, 64
#: Members of sets that a task counts at once.
COUNT_BLOCK = 250_000
#: Up to so many ids of documents to verify (8 bytes each) are broadcast; beyond, their texts are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Of the parities of suffixes (4 longs a posting), and the least of those of whole sets.
BUCKETS = 256


def _ids(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("string"))


def slots(members: np.ndarray, bits: int) -> np.ndarray:
    return (members >> np.uint64(64 - bits)).astype(np.int64)


def document_counts(docs: DataFrame, k: int, bits: int = SLOT_BITS) -> np.ndarray:
    """Of each counter: how many documents have one of its n-grams, each n-gram of a document counted."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        counts = np.zeros(1 << bits, np.int64)
        waiting, size = [np.zeros(0, np.uint64)], 0
        for batch in batches:
            for _, s in sets_of(batch, k):
                waiting.append(s)
                size += len(s)
                if size >= COUNT_BLOCK:
                    counts += np.bincount(slots(np.concatenate(waiting), bits), minlength=1 << bits)
                    waiting, size = [np.zeros(0, np.uint64)], 0
        counts += np.bincount(slots(np.concatenate(waiting), bits), minlength=1 << bits)
        compress = zstandard.ZstdCompressor(level=1).compress
        blocks = [(i // SLOT_BLOCK, compress(own.tobytes())) for i in range(0, len(counts), SLOT_BLOCK) if (own := counts[i : i + SLOT_BLOCK]).any()]
        yield pd.DataFrame(blocks, columns=["block", "counts"])

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for block, data in zip(batch["block"], batch["counts"]):
                own = np.frombuffer(unpack(data), np.int64)
                sums[block] = sums[block] + own if block in sums else own
        yield pd.DataFrame([(b, c.tobytes()) for b, c in sums.items()], columns=["block", "counts"])

    parts = _ids(docs).mapInPandas(count, "block int, counts binary")
    blocks = -(-(1 << bits) // SLOT_BLOCK)
    summed = parts.repartition(min(blocks, SUMMING_TASKS), "block").mapInPandas(total, "block int, counts binary")
    counts = np.zeros(1 << bits, np.int64)
    for r in summed.collect():  # 2 ** bits counters
        own = np.frombuffer(r["counts"], np.int64)
        counts[r["block"] * SLOT_BLOCK :][: len(own)] = own
    return np.minimum(counts, (1 << 32) - 1).astype(np.uint32)


def rare_first(members: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Members of a set, the rare first: by their counters, then by hash."""
    return members[np.lexsort((members, counts[slots(members, len(counts).bit_length() - 1)]))]


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def parities(members: np.ndarray, buckets: int) -> np.ndarray:
    """For each bucket, a bit: whether an odd number of the members fall there. Buckets are a power of two."""
    at = ((members >> np.uint64(20)) & np.uint64(buckets - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=buckets) & 1).astype(np.uint8), bitorder="little")


def fine_buckets(n: int) -> int:
    return max(BUCKETS, 1 << (4 * n - 1).bit_length())


def differing(a: bytes, b: bytes) -> int:
    """In how many buckets two parities differ; the one of more buckets is folded to the other's, which keeps them parities."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def described(docs: DataFrame, k: int, percent: int, counts: np.ndarray) -> DataFrame:
    """doc_id (string), n, cls (digest of the set), fine and parity (parities of the set), prefix (rare first)."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    names = ["doc_id", "n", "cls", "fine", "parity", "prefix"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for batch in batches:
            rows = []
            for doc_id, s in sets_of(batch, k):
                n = len(s)
                prefix = rare_first(s, shared.value)[: prefix_size(n, percent)] if n else s
                rows.append((doc_id, n, blake2b(s.tobytes(), digest_size=16).digest(), parities(s, fine_buckets(n)).tobytes(), parities(s, BUCKETS).tobytes(), prefix.view(np.int64)))
                if len(rows) == 300:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return _ids(docs).mapInPandas(run, "doc_id string, n long, cls binary, fine binary, parity binary, prefix array<long>")


def with_suffixes(postings: DataFrame, own: DataFrame) -> DataFrame:
    """postings (id, pos, h, hub) with n and the parities s0 to s3 of the members behind each position.

    Where two rows of `own` have an id in common, each takes the postings that are its own.
    """
    words = BUCKETS // 64
    e = lambda name: F.transform("e", lambda x: x[name]).alias(name)
    lists = postings.groupBy("id").agg(F.collect_list(F.struct("pos", "h", "hub")).alias("e")).select("id", e("pos"), e("h"), e("hub"))
    names = ["id", "n", "pos", "h", "hub", *(f"s{i}" for i in range(words))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                at = ((r.prefix.view(np.uint64) >> np.uint64(20)) & np.uint64(BUCKETS - 1)).astype(np.int64)
                before = np.zeros((len(at), words), np.uint64)
                before[np.arange(len(at)), at >> 6] = np.uint64(1) << (at & 63).astype(np.uint64)
                before = np.bitwise_xor.accumulate(before, axis=0)
                pos = r.pos[r.pos < len(at)]
                mine = r.prefix[pos] == r.h[r.pos < len(at)]
                pos, hub = pos[mine], r.hub[r.pos < len(at)][mine]
                behind = np.frombuffer(r.parity, np.uint64) ^ before[pos]
                rows.append(np.column_stack([np.full((len(pos), 2), (r.id, r.n)), pos, r.prefix[pos], hub, behind.view(np.int64)]))
                if len(rows) == 500:
                    yield pd.DataFrame(np.concatenate(rows), columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(np.concatenate(rows), columns=names)

    return own.join(lists, "id").mapInPandas(run, ", ".join(f"{c} long" for c in names))


def may_link(percent: int) -> Column:
    """The length, positional and suffix filters between postings a and b of one n-gram, as if it were their first in common."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    length = 100 * F.least(a("n"), b("n")) >= percent * F.greatest(a("n"), b("n"))
    most = F.least(a("n") - a("pos"), b("n") - b("pos"))
    positional = (100 + percent) * most >= percent * (a("n") + b("n"))
    behind = reduce(lambda x, y: x + y, (F.bit_count(a(f"s{i}").bitwiseXOR(b(f"s{i}"))) for i in range(BUCKETS // 64)))
    return length & positional & ((100 + percent) * (behind + a("pos") + b("pos")) <= (100 - percent) * (a("n") + b("n")))


def length_class(n: Column, percent: int) -> Column:
    """Sets whose sizes pass the length filter are of the same class or of neighbouring ones."""
    return F.floor(F.log(n) / (1.001 * max(math.log(100 / percent), 1e-6)))


def _of(pairs: DataFrame) -> DataFrame:
    """The distinct ids in pairs (a, b), broadcast if there are few."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    return F.broadcast(ids) if pairs.limit(BROADCAST_IDS).count() < BROADCAST_IDS else ids  # at most twice as many ids


def verified(pairs: DataFrame, known: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the saved, distinct pairs (a, b) of representatives whose whole sets are similar enough."""
    fine = known.select("id", "n", "fine").join(_of(pairs), "id", "left_semi")
    sides = pairs.join(fine.toDF("a", "n_a", "fine_a"), "a").join(fine.toDF("b", "n_b", "fine_b"), "b")

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            differ = np.array([differing(x, y) for x, y in zip(batch["fine_a"], batch["fine_b"])], np.int64)
            keep = (100 + percent) * differ <= (100 - percent) * (batch["n_a"] + batch["n_b"]).to_numpy()
            yield batch.loc[keep, ["a", "b"]]

    pairs = saved(sides.mapInPandas(close, "a long, b long").distinct(), "close-pairs")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 100):
                rows = [(doc_id, s.view(np.int64)) for doc_id, s in sets_of(batch.iloc[i : i + 100], k)]
                yield pd.DataFrame(rows, columns=["id", "members"])

    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(_of(pairs), "id", "left_semi")
    whole = own.select(F.col("id").cast("string").alias("doc_id"), "text").mapInPandas(sets, "id string, members array<long>")
    whole = saved(whole.select(F.col("id").cast("long").alias("id"), "members"), "sets")
    both = pairs.join(whole.toDF("a", "of_a"), "a").join(whole.toDF("b", "of_b"), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    both = both.select("a", "b", (F.size("of_a") + F.size("of_b")).alias("sizes"), shared.alias("shared"))
    return saved(both.where(100 * F.col("shared") >= percent * (F.col("sizes") - F.col("shared"))).select("a", "b").distinct(), "links")


def prepared(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Saved tables: what is known of each row, the classes (cls, rep), and the postings that several classes share."""
    known = saved(described(docs, k, percent, document_counts(docs, k)).withColumn("id", F.col("doc_id").cast("long")), "described")
    usable = known.where(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = saved(usable.groupBy("cls").agg(F.min("id").alias("rep")), "classes")
    own = saved(usable.join(classes.withColumn("id", F.col("rep")), ["cls", "id"]).select("id", "n", "parity", "prefix"), "representatives")
    postings = own.select("id", F.posexplode("prefix").alias("pos", "h"))
    common = postings.groupBy("h").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("h", "hub")
    return known, classes, saved(with_suffixes(postings.join(common, "h"), own), "postings")


def _within_lengths(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows under their own length class and the two beside it, and under their own only: joined, each pair meets once."""
    own = length_class(F.col("n"), percent)
    return rows.withColumn("size", F.explode(F.array(own - 1, own, own + 1))), rows.withColumn("size", own)


def _pairs(a: DataFrame, b: DataFrame, on: list[str], also: Column, percent: int) -> DataFrame:
    same = reduce(lambda x, y: x & y, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in on))
    found = a.alias("a").join(b.alias("b"), same & also & may_link(percent))
    return found.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def links(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """All links (a, b), a < b, between representatives of different sets, and the members (doc_id, rep) of each class.

    Each pair that shares a prefix n-gram and passes the filters is verified once. Documents of one class are linked
    with one another too; they aren't expanded into pairs.
    """
    kind = docs.schema["doc_id"].dataType
    known, classes, postings = prepared(docs, k, percent)
    around, own = _within_lengths(postings, percent)
    pairs = saved(_pairs(around, own, ["h", "size"], F.col("a.id") < F.col("b.id"), percent), "pairs")
    members = known.where("id IS NOT NULL AND n > 0").join(classes, "cls").select(F.col("doc_id").cast(kind).alias("doc_id"), "rep")
    return verified(pairs, known, docs, k, percent), members


def with_link_counts(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_links for every distinct doc_id with words: the documents that it is linked with, exact copies included.

    Of a doc_id that stands in several rows, each text counts as a document.
    """
    found, members = links(docs, k, percent)
    sizes = saved(members.groupBy("rep").count(), "class-sizes")
    beside = found.select("a", "b").union(found.select("b", "a")).join(sizes.select(F.col("rep").alias("b"), "count"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("count").alias("others"))
    of_class = sizes.join(beside, "rep", "left").select("rep", (F.col("count") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return members.join(of_class, "rep").groupBy("doc_id").agg(F.sum("n_links").alias("n_links"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: groups by Jaccard similarity of at least percent / 100."""
    kind = docs.schema["doc_id"].dataType
    known, classes, postings = prepared(docs, k, percent)
    hubs, rest = postings.where("id = hub"), postings.where("id > hub")
    tried = saved(_pairs(hubs, rest, ["h"], F.lit(True), percent), "pairs")
    found = verified(tried, known, docs, k, percent)
    groups = components(found)

    placed = postings.drop("hub").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = placed.groupBy("h", "component").count()
    main = sizes.groupBy("h").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("n_components")).where("n_components > 1").drop("n_components")
    mixed = saved(placed.join(main, "h"), "placed")
    outside, every = _within_lengths(mixed.where("component <> main"), percent)[0], _within_lengths(mixed, percent)[1]
    apart = (F.col("a.component") != F.col("b.component")) & ((F.col("b.component") == F.col("b.main")) | (F.col("a.id") < F.col("b.id")))
    second = saved(_pairs(outside, every, ["h", "size"], apart, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
    groups = components(verified(second, known, docs, k, percent).union(found))

    of_class = classes.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("cls", F.coalesce("component", "rep").alias("component"))
    out = known.select("doc_id", "id", "n", "cls").join(of_class, "cls", "left")
    alone = F.col("id").isNull() | (F.col("n") == 0)
    return out.select(F.col("doc_id").cast(kind), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each group: the one with the smallest doc_id. Rows without doc_id, and without words, stay.

    Rows that repeat the kept doc_id are one document and the first by text stays, a null text last; of rows that are
    equal in all but other columns, any.
    """
    kept = near_duplicates(docs, k, percent).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    named = named.groupBy("doc_id").agg(F.min_by(row, F.struct(F.col("text").isNull(), "text")).alias("row")).select("row.*")
    return named.unionByName(docs.where(F.col("doc_id").isNull()))


def oracle_sql(k: int, percent: int) -> str:
    """The same rows in DuckDB: all pairs that share a shingle, and what links reach."""
    shingle = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k} + 2), lambda i: {shingle}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= {percent} * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, e.b FROM reach JOIN both_ways e ON reach.b = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id)"""
