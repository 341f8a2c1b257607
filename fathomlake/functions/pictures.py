"""Whether a picture is of one named item, as columns over its title, its alternative text and its URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .asks import says, words_of
from .reading import file_words
from .text import let

# Words that name no item, words of a kind of item, wordings of a comparison.
STOP = "the and for with photo image picture of in a an on at to".split()
GENERIC = "ereader reader phone phones smartphone smartphones earbuds earbud headphones headphone laptop laptops tablet tablets review reviews".split()
COMPOSITE = r"\b(?:vs|versus|compare|compared|comparison|comparisons|collage|lineup|line up|roundup)\b|\bside by side\b|\bhead to head\b|\bface off\b"
SHORT_VERSUS = r"\bv\.s\b\.?"


def keywords(item: Column) -> Column:
    return F.filter(F.split(F.lower(item), "[^a-z0-9]+"), lambda x: (F.length(x) > 1) & ~x.isin(*STOP))


def match_share(item: Column, title: Column) -> Column:
    """The share of an item's words that a title has; 1 for an item without words."""
    low = F.lower(title)
    return let(keywords(item), lambda words: F.when(F.size(words) == 0, 1.0).otherwise(F.size(F.filter(words, lambda x: F.contains(low, x))) / F.size(words)))


def name_words(item: Column) -> Column:
    """The words of an item's name: capitalised ones and those with digits, in lower case."""
    bare = F.transform(words_of(item), lambda x: F.regexp_replace(x, "[^\\p{L}\\p{N}]", ""))
    return F.transform(F.filter(bare, lambda x: (x != "") & ~F.lower(x).isin(*STOP) & x.rlike("^\\p{Lu}|[0-9]")), F.lower)


def _has(text: Column, word: Column) -> Column:
    """Whether a text in lower case has a word; one of three letters or fewer has to stand alone."""
    alone = F.contains(F.concat(F.lit(" "), F.regexp_replace(text, "[^a-z0-9]", " "), F.lit(" ")), F.concat(F.lit(" "), word, F.lit(" ")))
    return F.when(F.length(word) <= 3, alone).otherwise(F.contains(text, word))


def matches(item: Column, title: Column) -> Column:
    """Whether a title names an item: every word of its name, hyphens in models aside, or most of its words where it has no name."""
    joined = lambda low: F.regexp_replace(low, "([a-z0-9])[-‐‑]+(?=[a-z0-9])", "$1")
    named = lambda low, plain: F.forall(name_words(item), lambda w: _has(low, w) | _has(plain, w))
    least = F.when(F.size(keywords(item)) <= 2, 1.0).otherwise(0.6)
    by_name = let(F.lower(title), lambda low: let(joined(low), lambda plain: named(low, plain)))
    return F.when(F.size(name_words(item)) > 0, by_name).otherwise(match_share(item, title) >= least)


def is_composite(*texts: Column) -> Column:
    """Whether any of the texts, file words among them, is of a comparison or a collage."""
    marked = lambda x: says(x, SHORT_VERSUS) | says(F.regexp_replace(x, "[-_.]+", " "), COMPOSITE)
    return F.exists(F.transform(F.array(*texts), lambda x: F.coalesce(x, F.lit(""))), marked)


def names_sibling(item: Column, text: Column, siblings: Column) -> Column:
    """Whether a text names one of the other items; one that is the same item said otherwise doesn't count."""
    return F.exists(siblings, lambda s: (F.trim(s) != "") & ~matches(s, item) & ~matches(item, s) & matches(s, text))


def fits(item: Column, title: Column, alt: Column, url: Column, siblings: Column) -> Column:
    """Whether a picture is of an item and of no sibling; where the title names both, the file name decides."""
    title, file = F.coalesce(title, F.lit("")), file_words(F.coalesce(url, F.lit("")))
    plain = F.array_join(F.filter(words_of(item), lambda w: ~F.lower(F.regexp_replace(w, "[^\\p{L}\\p{N}]", "")).isin(*GENERIC)), " ")
    mixed = is_composite(title, alt, file) | names_sibling(item, title, siblings)
    alone = matches(plain, file) & ~is_composite(file) & ~names_sibling(item, file, siblings)
    return F.coalesce(matches(item, title) & (~mixed | alone), F.lit(False))


def further_words(item: Column, title: Column) -> Column:
    """How many words of a title an item doesn't have."""
    every = F.filter(F.split(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+"), lambda x: F.length(x) > 1)
    return F.size(F.filter(every, lambda x: ~F.array_contains(keywords(item), x)))
