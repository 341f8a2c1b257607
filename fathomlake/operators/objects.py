"""Names of one object under many spellings: leader clustering in order, by an equality that isn't transitive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomlake.operators.entities import settled

# Words that are no part of a name, words that lead a command or a question.
NAME_STOP = ("the", "and", "with", "for", "vs", "versus", "from")
LEAD = "please|add|include|also|plus|instead|show|tell|compare|explain"
FILLER = "the|a|an|this|that|to"
QUESTION = "what|whats|how|why|when|where|who|which|add|include|also|plus|instead|show|tell|does|do|did|can|could|should|would|please"


def clean_name(name: Column) -> Column:
    """A name without a command before it and a question after it; the whole if less than two characters would be left."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(name, r"[?]+", ""), r"\s+", " "))
    led = F.regexp_replace(flat, rf"(?i)^(?:(?:{LEAD})\b[^A-Za-z'\s]*\s+(?:(?:{FILLER})\b[^A-Za-z'\s]*\s+)*)+(?=\S)", "")
    led = F.regexp_replace(led, rf"(?i)^(?:(?:{FILLER})\b[^A-Za-z'\s]*\s+)+(?=\S)", "")
    cut = F.trim(F.regexp_replace(led, rf"(?i)(?<=\S)\s[^A-Za-z'\s]*(?:{QUESTION})[^A-Za-z'\s]*(?:\s[\s\S]*)?$", ""))
    return F.when(F.length(cut) >= 2, cut).otherwise(F.trim(F.regexp_replace(name, r"[?]+", "")))


def name_parts(name: Column) -> Column:
    """Words of two and more letters and digits, without stop words."""
    return F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: (F.length(w) >= 2) & ~w.isin(*NAME_STOP))


def marks(parts: Column) -> Column:
    return F.filter(parts, lambda w: w.rlike(r"\d"))


def long_words(parts: Column) -> Column:
    return F.filter(parts, lambda w: ~w.rlike(r"\d") & (F.length(w) >= 4))


def _within(shorter: Column, longer: Column) -> Column:
    return F.size(F.array_except(shorter, longer)) == 0


def same_object(a: Column, b: Column) -> Column:
    """Whether two arrays of name parts are one object: a number in common if either has one, and the words of the one with fewer all among the other's."""
    ma, mb, wa, wb = marks(a), marks(b), long_words(a), long_words(b)
    some = (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(ma) > 0) == (F.size(mb) > 0)) & ((F.size(ma) == 0) | F.arrays_overlap(ma, mb))
    words = F.when((F.size(wa) == 0) | (F.size(wb) == 0), F.size(ma) > 0).when(F.size(wa) <= F.size(wb), _within(wa, wb)).otherwise(_within(wb, wa))
    return F.coalesce(some & words, F.lit(False))


def same_product(a: Column, b: Column) -> Column:
    """Whether two arrays of name parts are one product and not a sibling model: numbers agree where both have some, short words too, and only where both have them."""
    digits = lambda p: F.filter(p, lambda w: w.rlike(r"^\d+$"))
    strong = lambda p: F.filter(p, lambda w: F.length(w) >= 4)
    weak = lambda p: F.filter(p, lambda w: (F.length(w) < 4) & ~w.rlike(r"^\d+$"))
    da, db, sa, sb, wa, wb = digits(a), digits(b), strong(a), strong(b), weak(a), weak(b)
    some = (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(da) == 0) | (F.size(db) == 0) | F.arrays_overlap(da, db))
    by_words = F.when(F.size(sa) <= F.size(sb), _within(sa, sb)).otherwise(_within(sb, sa))
    words = F.when((F.size(sa) > 0) & (F.size(sb) > 0), by_words).otherwise(F.arrays_overlap(a, b))
    short = ((F.size(wa) == 0) | (F.size(wb) == 0) | F.arrays_overlap(wa, wb)) & ((F.size(wa) > 0) == (F.size(wb) > 0))
    return F.coalesce(some & words & short & ((F.size(sa) > 0) | (F.size(da) > 0)), F.lit(False))


def object_keys(parts: Column) -> tuple[Column, Column, Column]:
    """(parts that ask each, parts of which the rarest asks, parts that are asked for) for same_object."""
    numbered = F.size(marks(parts)) > 0
    none = F.array().cast("array<string>")
    return marks(parts), F.when(numbered, none).otherwise(long_words(parts)), F.when(numbered, marks(parts)).otherwise(long_words(parts))


def product_keys(parts: Column) -> tuple[Column, Column, Column]:
    """As object_keys, for same_product: without a word of four characters a name may equal any that has a part of it."""
    strong = F.filter(parts, lambda w: F.length(w) >= 4)
    return F.when(F.size(strong) == 0, parts).otherwise(F.array().cast("array<string>")), strong, parts


def leaders(
    names: DataFrame, scope: str, name: str, position: str, same: Callable[[Column, Column], Column] = same_object, keys: Callable[[Column], tuple[Column, Column, Column]] = object_keys
) -> DataFrame:
    """(scope, position, leader): every name joins the first leader of its scope, in order, that is the same; a name without one leads.

    Names with equal parts, if they equal themselves, stand for each other: the first of them leads or joins for all. Candidates meet on the parts
    that `keys` gives: numbers, or the rarest word of the shorter name, never all pairs of a scope. What leads is settled
    in rounds, for all scopes at once: a name leads once all earlier names that it equals are known to follow, and
    follows once one of them leads; so a round settles at least the first open name of each scope, and mostly nearly all.
    Both sides of each join grow with the rows, so none is broadcast.
    """
    rows = names.select(scope, position, F.array_sort(name_parts(clean_name(F.col(name)))).alias("parts_"))
    rows = rows.withColumn("alone_", F.when(~same(F.col("parts_"), F.col("parts_")), F.col(position)))
    kinds = settled(rows.groupBy(scope, "parts_", "alone_").agg(F.min(position).alias("p_")))
    every, one, asked = map(F.array_distinct, keys(F.col("parts_")))
    posted = kinds.select(scope, F.col("p_").alias("q_"), F.explode(asked).alias("token_"))
    counts = posted.groupBy(scope, "token_").agg(F.count("*").alias("n_"))
    rarest = kinds.select(scope, "p_", F.explode(one).alias("token_")).join(counts.hint("merge"), [scope, "token_"]).groupBy(scope, "p_").agg(F.min(F.struct("n_", "token_"))["token_"].alias("token_"))
    asking = kinds.select(scope, "p_", F.explode(every).alias("token_")).unionByName(rarest)
    met = asking.hint("merge").join(posted, [scope, "token_"]).where("p_ <> q_").select(scope, F.least("p_", "q_").alias("a_"), F.greatest("p_", "q_").alias("b_"))
    pairs = met.distinct()
    a = kinds.select(scope, F.col("p_").alias("a_"), F.col("parts_").alias("pa_"))
    b = kinds.select(scope, F.col("p_").alias("b_"), F.col("parts_").alias("pb_"))
    edges = settled(pairs.hint("merge").join(a, [scope, "a_"]).join(b.hint("merge"), [scope, "b_"]).where(same(F.col("pa_"), F.col("pb_"))).select(scope, "a_", "b_"))
    state = settled(kinds.select(scope, "p_", F.lit(None).cast("boolean").alias("leads_")))
    while not state.where("leads_ IS NULL").isEmpty():
        earlier = edges.hint("merge").join(state.select(scope, F.col("p_").alias("a_"), "leads_"), [scope, "a_"]).groupBy(scope, F.col("b_").alias("p_"))
        seen = earlier.agg(F.bool_or(F.coalesce("leads_", F.lit(False))).alias("some_leads_"), F.bool_or(F.col("leads_").isNull()).alias("some_open_"))
        now = F.when(F.col("leads_").isNotNull(), F.col("leads_")).when(F.col("some_leads_"), False).when(~F.coalesce("some_open_", F.lit(False)), True)
        before, state = state, settled(state.hint("merge").join(seen, [scope, "p_"], "left").select(scope, "p_", now.alias("leads_")))
        before.unpersist()
    first = edges.hint("merge").join(state.where("leads_").select(scope, F.col("p_").alias("a_")), [scope, "a_"]).groupBy(scope, F.col("b_").alias("p_")).agg(F.min("a_").alias("leader_"))
    led = state.hint("merge").join(first, [scope, "p_"], "left").select(scope, "p_", F.when(F.col("leads_"), F.col("p_")).otherwise(F.col("leader_")).alias("leader"))
    own = rows.alias("r").join(kinds.alias("k").hint("merge"), (F.col(f"r.{scope}") == F.col(f"k.{scope}")) & (F.col("r.parts_") == F.col("k.parts_")) & F.col("r.alone_").eqNullSafe(F.col("k.alone_")))
    return own.select(f"r.{scope}", f"r.{position}", "k.p_").join(led.hint("merge"), [scope, "p_"]).select(scope, position, "leader")


def thread_objects(facts: DataFrame, scope: str, name: str, fact: str, position: str, most: int = 8) -> DataFrame:
    """(scope, object, name, facts): objects of a thread in the order in which they come, with their first distinct facts, at most `most`.

    An object is named by its leader; one without facts takes no part in the result, but its number.
    """
    led = facts.hint("merge").join(leaders(facts, scope, name, position), [scope, position])
    said = led.withColumn("fact_", F.trim(F.regexp_replace(F.coalesce(fact, F.lit("")), r"\s+", " ")))
    named = led.where(F.col(position) == F.col("leader")).select(scope, "leader", clean_name(F.col(name)).alias("name"))
    numbered = named.withColumn("object", F.rank().over(Window.partitionBy(scope).orderBy("leader")))
    once = said.where("fact_ <> ''").groupBy(scope, "leader", "fact_").agg(F.min(position).alias("at_"))
    listed = once.groupBy(scope, "leader").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at_", "fact_"))), lambda x: x["fact_"]), 1, most).alias("facts"))
    return numbered.hint("merge").join(listed, [scope, "leader"]).select(scope, F.concat(F.lit("o"), F.col("object").cast("string")).alias("object"), "name", "facts")


def levels(edges: DataFrame, graph: str, a: str, b: str) -> DataFrame:
    """(graph, node, level) of edges a -> b: the length of the longest path that ends in a node; null on a cycle and behind one.

    Repeated edges count once, an edge to itself is a cycle. Each round takes away the nodes that nothing open leads to,
    of all graphs at once, and leaves graphs out that have none; there are as many rounds as the longest path has nodes,
    and a round is over nodes and edges that are still open.
    """
    own = settled(edges.select(graph, F.col(a).alias("a_"), F.col(b).alias("b_")).distinct())
    ends = own.select(graph, F.col("a_").alias("node"), F.lit(0).alias("n_")).union(own.select(graph, F.col("b_"), F.lit(1)))
    state = settled(ends.groupBy(graph, "node").agg(F.sum("n_").alias("in_")))
    nodes, placed, at = state.select(graph, "node"), None, 0
    while True:
        free = state.where("in_ = 0").select(graph, "node")
        if free.isEmpty():
            return nodes.withColumn("level", F.lit(None).cast("int")) if placed is None else nodes.join(placed, [graph, "node"], "left")
        now = free.withColumn("level", F.lit(at))
        placed = now if placed is None else placed.union(now)
        going = free.select(graph).distinct()
        used = own.join(free.withColumnRenamed("node", "a_"), [graph, "a_"])
        gone = used.groupBy(graph, F.col("b_").alias("node")).agg(F.count("*").alias("gone_"))
        left = state.where("in_ > 0").join(going, graph, "left_semi").join(gone, [graph, "node"], "left")
        state = settled(left.select(graph, "node", (F.col("in_") - F.coalesce("gone_", F.lit(0))).alias("in_")))
        at += 1
