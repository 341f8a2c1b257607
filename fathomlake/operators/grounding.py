"""Claims against evidence: which stated numbers and quotations the sources have, and which source to cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomlake.functions.text import let
from fathomlake.operators.entities import spread


def unsupported(claims: DataFrame, evidence: DataFrame, scope: str, token: str) -> DataFrame:
    """Claim tokens that no evidence of the same scope has."""
    return claims.join(evidence.select(scope, token).distinct(), [scope, token], "left_anti")


def support(claims: DataFrame, evidence: DataFrame, scope: str, claim: str, token: str) -> DataFrame:
    """Per claim: its distinct tokens, those that evidence has, and whether all are backed."""
    have = evidence.select(scope, token).distinct().withColumn("has_", F.lit(1))
    rows = claims.select(scope, claim, token).distinct().join(have, [scope, token], "left")
    return rows.groupBy(scope, claim).agg(F.count("*").alias("n_tokens"), F.count("has_").alias("n_backed"), F.bool_and(F.col("has_").isNotNull()).alias("backed"))


def sum_backed(totals: DataFrame, parts: DataFrame, scope: str, total: str, part: str, tolerance: float) -> DataFrame:
    """Per scope whether the stated total is, within a tolerance, the sum of the parts that evidence states."""
    sums = parts.groupBy(scope).agg(F.sum(part).alias("sum_"))
    return totals.join(sums, scope, "left").withColumn("backed", F.coalesce(F.abs(F.col(total) - F.col("sum_")) <= tolerance, F.lit(False))).drop("sum_")


def best_citation(claims: DataFrame, evidence: DataFrame, scope: str, claim: str, source: str, token: str, preferred: str) -> DataFrame:
    """Per claim the source of its scope with the most of its tokens: the preferred one on ties, else the lowest number."""
    asked = claims.select(scope, claim, token, preferred).distinct()
    if asked.limit(BROADCAST_CLAIMS + 1).count() <= BROADCAST_CLAIMS:
        asked = F.broadcast(asked)
    shared = spread(evidence.select(scope, source, token), scope, source).distinct().join(asked, [scope, token])
    counts = shared.groupBy(scope, claim, preferred, source).agg(F.count("*").alias("n_shared"))
    order = F.struct((-F.col("n_shared")).alias("n"), F.when(F.col(source) == F.col(preferred), 0).otherwise(1).alias("other"), F.col(source).alias("source"))
    best = counts.groupBy(scope, claim).agg(F.min(order).alias("b_"))
    return best.select(scope, claim, F.col("b_.source").alias(source), (-F.col("b_.n")).alias("n_shared"))


#: Up to so many tokens of claims are broadcast to the evidence; beyond, they meet by shuffle.
BROADCAST_CLAIMS = 500_000
#: Up to so many runs of quotations are broadcast to the texts; beyond, runs are joined by shuffle.
BROADCAST_RUNS = 500_000


def verbatim(quotes: DataFrame, texts: DataFrame, quote_id: str, quote: str, text_id: str, text: str, k: int = 5) -> DataFrame:
    """(quote, text) pairs where the text states the quotation word for word; a quotation without words is in none.

    Candidates share the quotation's rarest run of k words, or of all its words if it has fewer, so only those are
    compared. Texts' runs are met with the quotations' before anything is counted or shuffled, where these are few.
    """
    words = lambda c: F.filter(F.split(F.lower(c), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    run = lambda w, n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    runs = lambda w, n: F.when(F.size(w) >= n, run(w, n)).otherwise(F.array().cast("array<string>"))
    padded = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    q = quotes.select(quote_id, words(F.col(quote)).alias("w_")).where(F.size("w_") > 0)
    in_quotes = q.select(quote_id, F.explode(F.array_distinct(runs(F.col("w_"), F.least(F.size("w_"), F.lit(k))))).alias("run_"))
    lengths = sorted(r[0] for r in q.select(F.least(F.size("w_"), F.lit(k))).distinct().collect())  # k numbers at most
    if not lengths:
        return quotes.select(quote_id).crossJoin(texts.select(text_id).limit(0)).limit(0)
    wanted = in_quotes.select("run_").distinct()
    if in_quotes.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS:
        wanted = F.broadcast(wanted)
    t = texts.select(text_id, words(F.col(text)).alias("w_"))
    every = F.array_distinct(F.concat(*(runs(F.col("w_"), F.lit(n)) for n in lengths)))
    seen = t.select(text_id, F.explode(every).alias("run_")).join(wanted, "run_", "left_semi")
    counts = in_quotes.join(seen.groupBy("run_").agg(F.count("*").alias("n_")), "run_")
    rarest = counts.groupBy(quote_id).agg(F.min(F.struct("n_", "run_")).alias("m_")).select(quote_id, F.col("m_.run_").alias("run_"))
    pairs = rarest.join(seen, "run_").select(quote_id, text_id).distinct()
    full = pairs.join(q.select(quote_id, padded(F.col("w_")).alias("q_")), quote_id).join(t.select(text_id, padded(F.col("w_")).alias("t_")), text_id)
    return full.where(F.contains("t_", F.col("q_"))).select(quote_id, text_id)


def one_value_or_none(facts: DataFrame, subject: str, value: str) -> DataFrame:
    """A subject's value where all its sources agree on one; null where they differ."""
    return facts.groupBy(subject).agg(F.count_distinct(value).alias("n_values"), F.when(F.count_distinct(value) == 1, F.min(value)).alias(value))


def mode(facts: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group; the shorter one on ties, then the first by name."""
    counts = facts.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), F.length(value), value)
    return counts.withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")


SCALES = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mn": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9, "t": 1e12, "tn": 1e12, "trillion": 1e12}
#: Counts up to this may stand without a source; whole numbers below the second are never taken for derived ones.
FREE_NUMBER, LEAST_DERIVED = 2, 100


def with_roundings(evidence: DataFrame, scope: str, token: str) -> DataFrame:
    """(scope, value): numbers that evidence states, and what they are rounded to: to fewer decimals, and whole from 1,000 up."""
    value = F.col(token).try_cast("double")
    places = F.length(F.regexp_extract(token, "\\.(\\d+)$", 1))
    rounded = lambda p: F.when(p < places, F.round(value, p))
    whole = F.when((places > 0) & (F.abs(value) >= 1000), F.round(value, 0))
    values = F.array_compact(F.array(value, whole, *(rounded(F.lit(p)) for p in range(1, 7))))
    return evidence.select(scope, F.explode(F.array_distinct(values)).alias("value")).distinct()


def derived(value: Column, places: Column, backed: Column) -> Column:
    """Whether a number is, to its own last digit, a ratio, sum, difference, product or share of two backed ones, or one with a rate of the other added."""
    slack = F.lit(0.5) * F.pow(F.lit(10.0), -places) + 1e-9
    near = lambda x: F.abs(x - value) <= slack
    forms = lambda a, b: near(a / b) | near(a * (1 + b / 100)) | near(a * b / 100) | near(a + b) | near(a - b) | near(a * b)
    return F.exists(backed, lambda a: F.exists(backed, lambda b: (a != b) & forms(a, b)))


def ground_lines(lines: DataFrame, evidence: DataFrame, scope: str, line: str, text: str, token: str) -> DataFrame:
    """Per line: its number tokens, those that evidence of its scope backs (as stated, rounded, or scaled), and those derived from two backed ones of the line; backed if none is left over.

    Small counts and citation numbers need no source; a small whole number counts as derived only before "times".
    """
    bare = F.regexp_replace(F.col(text), "\\[\\d+\\]", " ")
    tokens = F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit("(\\d[\\d,]*(?:\\.\\d+)?)"), 1), lambda n: F.regexp_replace(F.replace(n, F.lit(","), F.lit("")), "\\.0+$", "")))
    factor = F.create_map(*(F.lit(x) for k, v in SCALES.items() for x in (k, v)))
    rows = lines.select(scope, line, F.col(text).alias("text_"), F.explode(tokens).alias("token_"))
    scaled = F.concat(F.lit("(?i)(?<![\\d.])"), F.replace("token_", F.lit("."), F.lit("\\.")), F.lit("(?:\\.0+)?\\s*(k|thousand|mn?|million|bn?|billion|tn?|trillion)\\b"))
    mark = F.lower(F.get(F.regexp_extract_all(F.replace("text_", F.lit(","), F.lit("")), scaled, F.lit(1)), F.lit(0)))
    rows = rows.withColumn("value_", F.col("token_").cast("double")).withColumn("scaled_", F.round(F.col("value_") * F.try_element_at(factor, mark), 0))
    known = with_roundings(evidence, scope, token).withColumn("known_", F.lit(True))
    rows = rows.join(known.withColumnRenamed("value", "value_"), [scope, "value_"], "left")
    rows = rows.join(known.select(scope, F.col("value").alias("scaled_"), F.col("known_").alias("known_scaled_")), [scope, "scaled_"], "left")
    stated = F.col("known_").isNotNull() | F.col("known_scaled_").isNotNull()
    grouped = rows.groupBy(scope, line).agg(F.first("text_").alias("text_"), F.collect_list(F.struct("token_", "value_", stated.alias("stated"))).alias("t_"))
    own = F.array_distinct(F.transform(F.filter("t_", lambda t: t["stated"] & (t["value_"] > 0)), lambda t: t["value_"]))
    flat = F.replace("text_", F.lit(","), F.lit(""))
    ratio = lambda t: F.regexp_like(flat, F.concat(F.lit("(?i)(?<![\\d.])"), F.replace(t["token_"], F.lit("."), F.lit("\\.")), F.lit("\\s*(?:times|x|×)")))
    places = lambda t: F.length(F.regexp_extract(t["token_"], "\\.(\\d+)$", 1))
    may = lambda t: (places(t) > 0) | (t["value_"] >= LEAST_DERIVED) | ratio(t)
    left = F.filter("t_", lambda t: ~t["stated"] & (t["value_"] > FREE_NUMBER))
    worked_out = let(own, lambda own: F.filter(left, lambda t: may(t) & derived(t["value_"], places(t), own)))
    counts = let(F.size(worked_out), lambda n: F.struct(n.alias("n_derived"), (F.size(left) == n).alias("backed")))
    out = grouped.select(scope, line, F.size("t_").alias("n_tokens"), F.size(F.filter("t_", lambda t: t["stated"])).alias("n_stated"), F.inline(F.array(counts)))
    plain = lines.select(scope, line).join(out, [scope, line], "left")
    return plain.select(scope, line, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tokens", "n_stated", "n_derived")), F.coalesce("backed", F.lit(True)).alias("backed"))
