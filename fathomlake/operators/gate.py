"""The relevance gate: what a question is about as weighted terms, and which of its rows have enough of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomlake.functions.asks import cashtags, model_conflict, variant_conflict
from fathomlake.functions.hosts import blocked
from fathomlake.functions.people import has_full_name
from fathomlake.functions.reading import years_of
from fathomlake.functions.text import let

from .filters import year_conflict

# Question and task words, three-letter words that name nothing, and the thresholds.
TASK = (
    "a an the of in on at to for from by with and or but if as is are was were be am do does did can could should would will have has had it its this that my your our me you i we they them "
    "who what when where why how which about into over than then not no so just very now vs versus per much find give show list tell quote "
    "please recommend summarize summarise fact check fact-check official source primary real original current exact need using use make get look looking says said "
    "page pages changed since version supported author authors publication year years paper papers book books review reviews best good buy cost price prices "
    "compare introduced venue also too really let lets up id ids"
).split()
FILLER = "new top all any out off way see put set say try own via etc yet ago one two got far big lot few day non".split()
TOKEN = "([A-Za-z0-9]+(?:['’.-][A-Za-z0-9]+)*)"
MAIN, FLOOR = 0.3, 0.2
#: A question that is a person's name, with or without the words that ask who that is.
PERSON = r"^(?:(?i:who(?:'s| is| was))\s+)?(\p{Lu}[\p{L}.'-]+(?: \p{Lu}[\p{L}.'-]*){1,3})\??$"


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def is_task(word: Column) -> Column:
    parts = F.filter(F.split(F.lower(word), "[^a-z0-9]+"), lambda p: p != "")
    return F.lower(word).isin(*TASK) | plain(word).isin(*TASK) | ((F.size(parts) > 1) & F.forall(parts, lambda p: p.isin(*TASK)))


def is_capital(word: Column) -> Column:
    """A name or an acronym by its spelling."""
    return (F.length(word) >= 2) & ~is_task(word) & (word.rlike("^[A-Z]") | (word.rlike("[a-z]") & word.rlike("[A-Z]")))


def terms_of(question: Column) -> Column:
    """array<struct<token, weight, run>>: names of several words weigh 3 and share a run, tickers 3, single names and numbers 2, other words 1; each token once."""
    return let(F.regexp_extract_all(question, F.lit(TOKEN), 1), lambda words: let(cashtags(question), lambda tickers: _terms(question, words, tickers)))


def _terms(question: Column, words: Column, tickers: Column) -> Column:
    is_name = lambda w: (is_capital(w) | F.array_contains(tickers, F.lower(w))) & (plain(w) != "")
    number = lambda t: t.rlike("^(?:19|20)\\d{2}$|^\\d+ \\d+$|^\\d{2,}$")
    usual = lambda t: (F.length(t) >= 4) | ((F.length(t) == 3) & t.rlike("[a-z]") & ~t.isin(*FILLER))
    from_years = F.transform(years_of(question), lambda y: F.struct(y.cast("string").alias("token"), F.lit(2).alias("weight"), F.lit(None).cast("int").alias("run")))

    def every(names: Column) -> Column:
        at = lambda i: F.coalesce(F.when(i >= 0, F.get(names, i)), F.lit(False))
        # Names in a row have as many other words before them.
        run = lambda i: F.size(F.filter(F.slice(names, F.lit(1), i), lambda n: ~n))

        def entry(w: Column, i: Column) -> Column:
            token = plain(w)
            several = at(i) & (at(i - 1) | at(i + 1))
            weight = F.when(several, 3).when(F.array_contains(tickers, token), 3).when(at(i), 2).when(number(token), 2).when(usual(token), 1).otherwise(0)
            return F.struct(token.alias("token"), F.when(token.isin(*TASK), 0).otherwise(weight).alias("weight"), F.when(several, run(i)).alias("run"))

        return F.filter(F.concat(F.transform(words, entry), from_years), lambda t: (t["weight"] > 0) & (t["token"] != ""))

    def once(ts: Column) -> Column:
        """The heaviest term of each token, the first on ties."""
        best = lambda t: F.array_max(F.transform(F.filter(ts, lambda o: o["token"] == t["token"]), lambda o: o["weight"]))
        first = lambda t, i: F.exists(F.slice(ts, F.lit(1), i), lambda o: (o["token"] == t["token"]) & (o["weight"] == t["weight"]))
        return F.filter(ts, lambda t, i: (t["weight"] == best(t)) & ~first(t, i))

    return let(F.coalesce(F.transform(words, lambda w: F.coalesce(is_name(w), F.lit(False))), F.array().cast("array<boolean>")), lambda names: let(every(names), once))


def forms(word: Column) -> Column:
    """A word and what it is without light endings, so that printing meets print and printers."""

    def without(end: str, least: int, cut: int) -> Column:
        bare = F.substring(word, F.lit(1), F.length(word) - cut)
        doubled = bare.rlike("([b-df-hj-np-tv-z])\\1$") & ~bare.rlike("(ll|ss|ff|zz)$")
        both = F.when(doubled, F.array(bare, F.substring(bare, F.lit(1), F.length(bare) - 1))).otherwise(F.array(bare))
        return F.when((F.length(word) >= least) & word.endswith(end), both).otherwise(F.array().cast("array<string>"))

    plural = F.when((F.length(word) >= 5) & word.endswith("s") & ~word.endswith("ss"), F.array(F.substring(word, F.lit(1), F.length(word) - 1))).otherwise(F.array().cast("array<string>"))
    ies = F.when((F.length(word) >= 5) & word.endswith("ies"), F.array(F.concat(F.substring(word, F.lit(1), F.length(word) - 3), F.lit("y")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(word), without("ers", 7, 3), without("ing", 7, 3), without("ed", 6, 2), ies, plural)


def _bound(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with columns that are worked out once: the step is not merged into those that use them."""
    held = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return rows.select("*", held.alias("bound_")).select(*rows.columns, "bound_.*")


def judged(rows: DataFrame, question: str, title: str, snippet: str, url: str) -> DataFrame:
    """Adds score (share of the terms' weight that a row has), hits, hard (another year, model or variant than asked) and passes."""
    text = F.concat_ws(" ", F.col(title), F.coalesce(F.col(snippet), F.lit("")))
    hay = F.filter(F.split(F.concat_ws(" ", plain(F.col(title)), plain(F.coalesce(F.col(snippet), F.lit(""))), plain(F.col(url))), " "), lambda w: w != "")
    names = rows.columns
    with_forms = F.transform(terms_of(F.col(question)), lambda t: F.struct(t["token"].alias("token"), t["weight"].alias("weight"), t["run"].alias("run"), forms(t["token"]).alias("forms")))
    rows = _bound(rows, terms_=with_forms, words_=hay)
    follows = F.zip_with(F.slice("words_", F.lit(1), F.greatest(F.size("words_") - 1, F.lit(0))), F.slice("words_", F.lit(2), F.greatest(F.size("words_") - 1, F.lit(0))), lambda a, b: F.when((F.length(a) >= 2) & (F.length(b) >= 3), F.concat(a, b)))
    rows = _bound(rows, forms_=F.array_distinct(F.flatten(F.transform("words_", forms))), joined_=F.array_distinct(F.array_compact(follows)))
    has = lambda t: F.arrays_overlap(t["forms"], F.col("forms_")) | ((F.length(t["token"]) >= 5) & F.array_contains("joined_", t["token"]))
    runs = F.array_distinct(F.array_compact(F.transform("terms_", lambda t: t["run"])))
    rows = _bound(rows, found_=F.filter("terms_", has), runs_=runs)
    weight = lambda c: F.aggregate(c, F.lit(0), lambda s, t: s + t["weight"])
    count = lambda c, r: F.size(F.filter(c, lambda t: t["run"] == r))
    full = F.exists("runs_", lambda r: count(F.col("found_"), r) == count(F.col("terms_"), r))
    touched = F.exists("found_", lambda t: t["run"].isNotNull() & (F.length(t["token"]) >= 4))
    single = (F.size("runs_") == 0) & F.exists("found_", lambda t: (t["weight"] == 2) & ~t["token"].rlike("^[0-9 ]+$"))
    enough = (F.size("terms_") < 3) | (F.size("found_") >= 2)
    score = F.when(F.size("terms_") > 0, weight(F.col("found_")) / weight(F.col("terms_"))).otherwise(1.0)
    other_model = model_conflict(F.col(question), text) | variant_conflict(F.col(question), text)
    rows = _bound(rows, full_=full, touched_=touched, single_=single, enough_=enough, score=score, hits=F.size("found_"), years_=years_of(F.col(question)), other_=F.when(F.col(question).rlike("[0-9]"), other_model).otherwise(False))
    other_year = F.when(F.size("years_") > 0, year_conflict(F.col("years_"), years_of(text)) & ~(F.col("full_") & ~year_conflict(F.col("years_"), years_of(F.col(title)))))
    rows = _bound(rows, hard=F.coalesce(other_year, F.lit(False)) | F.col("other_"))
    passes = ~F.col("hard") & (F.col("full_") | F.col("touched_") | (F.col("single_") & F.col("enough_")) | (F.col("score") >= MAIN))
    return rows.select(*names, "score", "hits", "hard", "enough_", passes.alias("passes"))


def gate_judged(rows: DataFrame, query: str, filler: Column, enough: Column) -> DataFrame:
    """Of judged rows those that stay: with any that pass, hard ones go, and soft misses where they are fewer than half of the rows that aren't filler; else those with a score of FLOOR and terms enough."""
    w = Window.partitionBy(query)
    soft = ~F.col("passes") & ~F.col("hard")
    rows = rows.withColumns({"passing_": F.count_if(F.col("passes")).over(w), "soft_": F.count_if(soft & ~filler).over(w), "all_": F.count_if(~filler).over(w)})
    with_some = ~F.col("hard") & (F.col("passes") | ~(2 * F.col("soft_") < F.col("all_")))
    without = ~F.col("hard") & (F.col("score") >= FLOOR) & enough
    return rows.where(F.when(F.col("passing_") > 0, with_some).otherwise(without)).drop("passing_", "soft_", "all_")


def gated(rows: DataFrame, query: str, question: str, title: str, snippet: str, url: str, engines: str) -> DataFrame:
    """The rows of each question that the gate keeps; blocked pages never stay. `engines` is an array: rows of the encyclopedia alone never outvote others."""
    clean = of_person(rows.where(~blocked(F.col(url))), query, question, title, snippet)
    filler = (F.size(engines) > 0) & F.forall(engines, lambda e: e == "wikipedia")
    return gate_judged(judged(clean, question, title, snippet, url), query, filler, F.col("enough_")).drop("enough_")


def of_person(rows: DataFrame, query: str, question: str, title: str, snippet: str) -> DataFrame:
    """Of a question that is a person's name only the rows that have the full name, not as part of a longer one; all rows where none has it."""
    name = F.regexp_extract(question, PERSON, 1)
    named = F.when(name == "", False).otherwise(has_full_name(name, F.col(title)) | has_full_name(name, F.col(snippet)))
    out = _bound(rows, asks_=name != "", named_=named)
    some = F.max("named_").over(Window.partitionBy(query))
    return out.withColumn("some_", some).where(~F.col("asks_") | F.col("named_") | ~F.col("some_")).drop("asks_", "named_", "some_")
