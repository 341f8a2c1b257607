"""What of a card its sources don't state: months, and the sentence of a source that answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomlake.functions.asks import says, tokens
from fathomlake.functions.months import month_bits, without_unsourced_months
from fathomlake.functions.text import let, sentences

# Words that don't tell a sentence, wordings of reported speech and of questions for a number.
QUOTE_STOP = (
    "what when where which does did how many much that this with from have been were will your about into over under than then them they their there these those would could should just like also only most "
    "some such very more less best need want make give tell show find help using used according quote quotes quoting exact line lines page pages says said report study paper article sentence words wording "
    "document guideline notice official"
).split()
ATTRIBUTION = r"(?i)^\s*(?:according to|per|as (?:stated|noted|outlined|set out) (?:in|by)|based on|under)\b[^,]{3,120},\s*"
COUNTING = r"\b(?:how many|how much|count|number|figure|total)\b"


def with_sourced_months(slots: DataFrame, sources: DataFrame, card: str, slot: str, text: str, cites: str, source: str, said: str, asked: Column, today: Column) -> DataFrame:
    """Slots whose text keeps only the months that its cited sources, the question or today's date state; all of a card's sources where it cites none of them.

    A source's months are worked out once and travel as twelve bits; cites that name no source don't count.
    """
    stated = sources.select(card, F.col(source).alias("cite_"), month_bits(F.col(said)).alias("bits_"))
    cited = slots.select(card, slot, F.explode(F.array_distinct(cites)).alias("cite_")).join(stated, [card, "cite_"]).groupBy(card, slot).agg(F.bit_or("bits_").alias("own_"))
    every = stated.groupBy(card).agg(F.bit_or("bits_").alias("every_"))
    rows = slots.join(cited, [card, slot], "left").join(every, card, "left")
    known = F.coalesce("own_", "every_", F.lit(0)).bitwiseOR(month_bits(asked)).bitwiseOR(F.call_function("shiftleft", F.lit(1), F.month(today) - 1))
    return rows.withColumn("known_", known).withColumn(text, without_unsourced_months(F.col(text), F.col("known_"))).select(*slots.columns)


def quotable(sentence: Column) -> Column:
    """Whether a text reads as a sentence: six words, no letter before a digit, fewer than five numbers, twenty characters."""
    words = F.size(F.filter(F.split(sentence, "\\s+"), lambda x: x != ""))
    return (F.length(sentence) >= 20) & ~sentence.rlike("[A-Za-z][0-9]") & (words >= 6) & (F.regexp_count(sentence, F.lit("[0-9]+(?:\\.[0-9]+)?")) < 5)


def answering_sentences(questions: DataFrame, pages: DataFrame, q_id: str, question: str, scope: str, page: str, text: str) -> DataFrame:
    """(q_id, page, sentence, score): of each page of a question's scope the sentence with most of the question's words; the first of equals.

    A number counts one where the question asks for one, and what reports somebody else's words three less. Two words
    have to be met, or the only one. Pages without such a sentence are left out.
    """
    asked = questions.select(q_id, scope, tokens(F.col(question), 4, QUOTE_STOP).alias("words_"), says(F.col(question), COUNTING).alias("counts_")).where(F.size("words_") > 0)
    lines = F.flatten(F.transform(F.split(text, "\\n+"), sentences))
    said = pages.select(scope, page, F.posexplode(lines).alias("at_", "sentence")).where(quotable(F.col("sentence")))
    own = F.lower(F.regexp_replace("sentence", ATTRIBUTION, ""))
    hits = let(own, lambda low: F.size(F.filter("words_", lambda w: F.contains(low, w))))
    met = asked.join(said, scope).withColumn("hits_", hits).where(F.col("hits_") >= F.least(F.size("words_"), F.lit(2)))
    score = F.col("hits_") + F.when(F.col("counts_") & F.col("sentence").rlike("[0-9]"), 1).otherwise(0) - F.when(F.col("sentence").rlike(ATTRIBUTION), 3).otherwise(0)
    best = met.withColumn("score", score).groupBy(q_id, page).agg(F.max_by(F.struct("sentence", "score"), F.struct("score", (-F.col("at_")).alias("at"))).alias("best_"))
    return best.select(q_id, page, "best_.*")
