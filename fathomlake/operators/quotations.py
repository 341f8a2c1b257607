"""Reworded quotations: the sentence that has nearly all of a quotation's words, and quotations made whole."""

from __future__ import annotations

from pyspark.ml.feature import NGram
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many words of quotations are broadcast to the sentences; beyond, they meet by shuffle.
BROADCAST_WORDS = 300_000
#: A quotation in straight or curly marks, of 12 to 400 characters.
QUOTED = '"[^"]{12,400}"|“[^”]{12,400}”'


def quote_words(text: Column) -> Column:
    """Words of three and more letters, digits, signs of percent and money, in order and with repeats."""
    flat = F.translate(F.lower(text), "‘’", "''")
    return F.filter(F.split(flat, r"\.?[^\p{L}\p{N}%$'.]+|\.$"), lambda w: F.length(w) > 2)  # without one stop at a word's end


def source_sentences(text: Column) -> Column:
    """Collapsed sentences, cut after end marks and at line ends."""
    marked = F.regexp_replace(F.regexp_replace(text, r"([.!?])[ \t\n\r\f\u000b]+", "$1\u0001"), r"\n+", "\u0001")
    return F.transform(F.split(F.regexp_replace(marked, "[ \\t\\n\\r\\f\\u000b]+", " "), "\u0001"), lambda s: F.trim(s))


def nearest_sentences(quotes: DataFrame, texts: DataFrame, quote_id: str, quote: str, text_id: str, text: str, percent: int = 85, least: int = 6) -> DataFrame:
    """(quote, text, pos, sentence, share): per quotation the sentence with most of its words, at least `percent` of them; the first by text and place on ties.

    Words count as often as the quotation has them. A quotation of fewer than `least` words has none; a sentence may be
    1.6 times as long and 20 characters more, and 400 at most. Of n words at most n - ceil(n * percent / 100) can be
    missing, so one of that many and one more, the rarest ones, is in the sentence: only sentences with such a word leave
    their task, and each is compared once with a quotation. Repeated quotations are asked once.
    """
    length = F.length(quote)
    asked = quotes.select(quote_id, quote).where(F.col(quote).isNotNull())
    kinds = asked.select(quote).distinct().select(F.col(quote).alias("quote_"), length.alias("length_"), quote_words(F.col(quote)).alias("want_")).where(F.size("want_") >= least)
    sentences = texts.select(text_id, F.posexplode(source_sentences(F.col(text))).alias("pos", "sentence")).where(F.length("sentence") <= 400)
    have = F.array_distinct(quote_words(F.col("sentence")))  # not a column of its own before it is exploded: Spark would work it out again to filter by it
    wanted = kinds.select(F.explode(F.array_distinct("want_")).alias("word_")).distinct()
    small = wanted.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    hint = F.broadcast if small else (lambda df: df)
    counts = texts.select(F.explode(F.array_distinct(quote_words(F.col(text)))).alias("word_"))  # texts with a word; which words are rarest decides speed only
    counts = counts.join(hint(wanted), "word_", "left_semi").groupBy("word_").agg(F.count("*").alias("n_"))
    ordered = kinds.select("quote_", "length_", "want_", F.posexplode("want_").alias("i_", "word_")).join(hint(counts) if small else counts, "word_", "left")
    w = Window.partitionBy("quote_").orderBy(F.coalesce("n_", F.lit(0)), "word_", "i_")
    size = F.size("want_")
    missing = size - F.ceil(size * percent / 100)
    prefix = ordered.withColumn("k_", F.row_number().over(w)).where((F.col("k_") <= missing + 1) & F.col("n_").isNotNull())
    prefix = prefix.groupBy("word_").agg(F.collect_set(F.struct("quote_", "length_", "want_")).alias("quotes_")) if small else prefix.select("word_", F.array(F.struct("quote_", "length_", "want_")).alias("quotes_")).distinct()
    hits = sentences.select(text_id, "pos", "sentence", F.explode(have).alias("word_")).join(hint(prefix), "word_")
    pairs = hits.select(text_id, "pos", "sentence", have.alias("have_"), F.explode("quotes_").alias("q_")).select(text_id, "pos", "sentence", "have_", "q_.*")
    found = F.size(F.filter("want_", lambda x: F.array_contains("have_", x)))
    near = pairs.where(F.length("sentence") <= F.col("length_") * 1.6 + 20).withColumn("found_", found).where(F.col("found_") * 100 >= F.size("want_") * percent)
    best = near.groupBy("quote_").agg(F.min(F.struct((-F.col("found_")).alias("f"), text_id, "pos", "sentence", F.size("want_").alias("n"))).alias("b_"))
    out = asked.join(best.withColumnRenamed("quote_", quote), quote)
    return out.select(quote_id, f"b_.{text_id}", "b_.pos", "b_.sentence", F.round(-F.col("b_.f") / F.col("b_.n"), 6).alias("share"))


def whole_sentences(quotes: DataFrame, texts: DataFrame, quote_id: str, quote: str, text_id: str, text: str, k: int = 4) -> DataFrame:
    """(quote, sentence): the first sentence, by text and place, that has a quotation of k and more words in a row."""
    words = lambda c: F.filter(F.split(F.lower(F.translate(c, "‘’", "''")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    q = quotes.select(F.col(quote).alias("quote_")).distinct().withColumn("w_", words(F.col("quote_"))).where(F.size("w_") >= k)
    q = q.select("quote_", padded(F.col("w_")).alias("padded_"), F.array_join(F.slice("w_", 1, k), " ").alias("run_"))
    small = q.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    s = texts.select(text_id, F.posexplode(source_sentences(F.col(text))).alias("pos", "sentence"))
    s = NGram(n=k, inputCol="w_", outputCol="runs_").transform(s.withColumn("w_", words(F.col("sentence"))))
    s = s.select(text_id, "pos", "sentence", F.explode(F.array_distinct("runs_")).alias("run_"))
    found = s.join(F.broadcast(q) if small else q, "run_").where(F.contains(padded(words(F.col("sentence"))), F.col("padded_")))
    best = found.groupBy("quote_").agg(F.min(F.struct(text_id, "pos", "sentence")).alias("b_"))
    return quotes.select(quote_id, F.col(quote).alias("quote_")).join(best, "quote_").select(quote_id, "b_.sentence")


def whole_quotes(answers: DataFrame, sources: DataFrame, answer_id: str, answer: str, source_id: str, text: str) -> DataFrame:
    """(answer, text): quotations of the answers made the sources' own sentences.

    One that a source has becomes the source's whole sentence where that is longer; one that is nearly a sentence of a
    source becomes that sentence; of others, six and more words lose their marks. One with an ellipsis stays.
    """
    spans = answers.select(answer_id, F.posexplode(F.regexp_extract_all(F.col(answer), F.lit(QUOTED), F.lit(0))).alias("i_", "marked_"))
    spans = spans.withColumn("span_", F.trim(F.substring("marked_", 2, 1000).substr(F.lit(1), F.length("marked_") - 2))).withColumn("id_", F.struct(answer_id, "i_"))
    open_ = spans.where(~F.col("span_").rlike(r"\.\.\.|…"))
    whole = whole_sentences(open_, sources, "id_", "span_", source_id, text).withColumnRenamed("sentence", "whole_")
    near = nearest_sentences(open_, sources, "id_", "span_", source_id, text).select("id_", F.col("sentence").alias("near_"))
    first, last = F.substring("marked_", 1, 1), F.col("marked_").substr(F.length("marked_"), F.lit(1))
    longer = (F.length("whole_") > F.length("span_")) & (F.length("whole_") <= 400)
    new = F.when(F.col("span_").rlike(r"\.\.\.|…"), F.col("marked_")).when(longer, F.concat(first, "whole_", last)).when(F.col("whole_").isNotNull(), F.col("marked_"))
    new = new.when(F.col("near_").isNotNull(), F.concat(first, "near_", last)).when(F.size(F.split("span_", r"\s+")) >= 6, F.col("span_")).otherwise(F.col("marked_"))
    decided = spans.join(whole, "id_", "left").join(near, "id_", "left").select(answer_id, "i_", new.alias("new_"))
    gathered = decided.groupBy(answer_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("i_", "new_"))), lambda x: x["new_"]).alias("new_"))
    parts = F.split(F.col(answer), QUOTED)
    text_ = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get("new_", i), F.lit("")))), "")
    return answers.join(gathered, answer_id, "left").select(answer_id, text_.alias("text"))
