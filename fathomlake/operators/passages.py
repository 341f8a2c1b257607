"""Sentences and lines of pages as rows, scored against what is asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROMANCE = ("que", "los", "las", "del", "para", "por", "con", "una", "les", "des", "est", "dans", "pour", "avec", "sur")
ENGLISH = ("the", "and", "of", "to", "in", "that", "is", "for", "with", "was")


def sentence_array(text: Column) -> Column:
    """Collapsed sentences, cut behind . ! or ? and a space."""
    flat = F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f\\u000b]+", " "))
    return F.filter(F.split(F.regexp_replace(flat, "([.!?]) +", "$1\n"), "\n"), lambda s: s != "")


def candidates(pages: DataFrame, page: str, text: str, shortest: int = 35, longest: int = 260, most: int = 40) -> DataFrame:
    """(page, pos, sentence): a page's sentences of usable length, the first of those that begin with the same 60 characters, at most `most`."""
    rows = pages.select(page, F.posexplode(sentence_array(F.col(text))).alias("pos", "sentence")).where(F.length("sentence").between(shortest, longest))
    key = F.lower(F.substring("sentence", 1, 60))
    first = rows.groupBy(page, key.alias("key_")).agg(F.min("pos").alias("pos"), F.min_by("sentence", "pos").alias("sentence")).drop("key_")
    w = Window.partitionBy(page).orderBy("pos")
    return first.withColumn("nth_", F.row_number().over(w)).where(F.col("nth_") <= most).drop("nth_")


# Words that are no question words, and what marks a figure and a rule's edge.
ASK_STOP = (
    "what when where which who whom whose why how does do did is are was were the and for with from that this these those into about your you should could would will can much many more most than then them they their there here have has had been "
    "being some any each also just only over under after before between its"
).split()
FIGURE = r"(?i)(?:[$€£¥]\s?\d|\d\s?(?:%|°|percent\b|degrees?\b|minutes?\b|hours?\b|days?\b|years?\b|mg\b|g\b|kg\b|lbs?\b|miles?\b|km\b|feet\b|ft\b)|\btwo-thirds\b|\b\d+/\d+\b)"
RULE_EDGE = (
    r"(?i)\b(?:except|exception|unless|however|only if|cap(?:ped|s)?|limit(?:s|ed)?|maximum|minimum|at least|no more than|fee|fees|cost|costs|eligib\w*|requir\w*|must|veto|override|safe|internal temperature|deadline)\b"
)


def question_stems(question: Column) -> Column:
    """Distinct words of a question of three letters or more, without endings, cut to six letters."""
    words = F.array_distinct(F.filter(F.split(F.lower(question), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*ASK_STOP)))
    stems = F.transform(words, lambda w: F.substring(F.regexp_replace(w, "(ing|ed|es|s)$", ""), 1, 6))
    return F.filter(stems, lambda w: F.length(w) >= 3)


def line_score(line: Column, stems: Column) -> Column:
    """Stems that stand in a line, and of a line with any of them 1.5 more for a figure and 1 for a rule's edge; else 0."""
    low = F.lower(line)
    hits = F.size(F.filter(stems, lambda s: F.contains(low, s)))
    more = F.when(line.rlike(FIGURE), 1.5).otherwise(0.0) + F.when(line.rlike(RULE_EDGE), 1.0).otherwise(0.0)
    return F.when(hits == 0, F.lit(0.0)).otherwise(hits + more)


def key_lines(lines: DataFrame, query: str, page: str, pos: str, line: str, asked: str, per_page: int = 2, most: int = 5) -> DataFrame:
    """Per query the best-scoring lines, at most `per_page` of a page, of equal beginnings (80 characters) the best one."""
    scored = lines.withColumn("score", line_score(F.col(line), F.col(asked))).where("score > 0")
    order = [F.desc("score"), page, pos]
    first = scored.withColumn("same_", F.row_number().over(Window.partitionBy(query, F.lower(F.substring(line, 1, 80))).orderBy(*order))).where("same_ = 1")
    capped = first.withColumn("on_page_", F.row_number().over(Window.partitionBy(query, page).orderBy(*order))).where(F.col("on_page_") <= per_page)
    return capped.withColumn("nth", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("nth") <= most).drop("same_", "on_page_")


def with_neighbours(sentences: DataFrame, page: str, pos: str, sentence: str, score: str, budget: int) -> DataFrame:
    """Sentences that score, with those beside them, the best first, as long as a page's characters stay within a budget."""
    w = Window.partitionBy(page).orderBy(pos)
    best = F.greatest(F.col(score), *(F.coalesce(f(score).over(w), F.lit(0.0)) - 0.5 for f in (F.lag, F.lead)))
    ranked = sentences.withColumn("best_", best).where("best_ > 0")
    order = Window.partitionBy(page).orderBy(F.desc("best_"), pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("used_", F.sum(F.length(sentence) + 1).over(order)).where(F.col("used_") <= budget).drop("best_", "used_")


def language_flags(text: Column) -> tuple[Column, Column]:
    """The share of CJK letters among letters, and whether Romance stop words are at least four and more than English ones."""
    letters = F.regexp_count(text, F.lit("\\p{L}"))
    cjk = F.regexp_count(text, F.lit("[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}]"))
    words = F.split(F.lower(text), "[^\\p{L}]+")
    n = lambda known: F.size(F.filter(words, lambda w: w.isin(*known)))
    return F.when(letters > 0, cjk / letters).otherwise(0.0), (n(ROMANCE) >= 4) & (n(ROMANCE) > n(ENGLISH))


def cited(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n): the citation numbers [n] of a text."""
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit("\\[(\\d{1,4})\\]"), 1))
    return texts.select(key, F.explode(F.transform(numbers, lambda n: n.cast("int"))).alias("n"))
