"""Questions of several steps: a small grammar gives a plan of sub-questions, facts are read from evidence, and joins bind them, one a step.

A plan is a column of the question; facts are rows read from sentences of the evidence (dates, years, lengths, scores of
seasons, centuries) without regard to any question; an answer is a join of a plan with the facts of its scope. Where a
fact is missing or only binds a part of the question, the next search is given instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomlake.functions.reading import century_of
from fathomlake.functions.text import let
from fathomlake.operators.entities import settled
from fathomlake.operators.spans import spans

# Forms of questions, verbs with their past and nearby forms, dates, lengths, seasons, centuries.
AGE = r"(?i)^how old was (.+?) when (.+?)\??$"
OFFSET = r"(?i)^what (.+?) opened exactly (\d+) years after (.+?)\??$"
BORN_IN = r"(?i)\bthe year (.+?) was born\b"
IF_ON = r"(?i)\bif (.+?) (?:took place|were held|was held|happened|ran) on (.+?)(?:,| how many)"
WHAT_YEAR = r"(?i)^what year did (.+?)\??$"
TENURE = r"(?i)^how long has (.+?) been (?:the |a |an )?(.+?)\??$"
SCORE = r"(?i)\b(?:tomatometer|rotten tomatoes|metacritic)\b"
NEWEST = r"(?i)\b(?:most recent|latest|current|this season)\b"
CENTURY = r"(?i)\bcentury\b"
NAME_ASKED = r"(?i)\b(?:name|named|called|chosen|coined)\b"
OPENING_PLACE = r"\b[iI]n ([A-Z][^?]+?) opened exactly"
SEASON_OF = r"(?i)\bseason of\s+(.+?)(?:\s+on\s+|\?|$)"
VERBS = {
    "sold": (r"(?i)\bsell\b", r"(?i)\b(?:sell|sold|sale|selling)\b"),
    "founded": (r"(?i)\b(?:found|founded)\b", r"(?i)\b(?:found|founded|founding)\b"),
    "opened": (r"(?i)\bopen(?:ed)?\b", r"(?i)\b(?:open|opened|opening)\b"),
    "died": (r"(?i)\b(?:die|died)\b", r"(?i)\b(?:die|died|death)\b"),
    "won": (r"(?i)\b(?:win|won)\b", r"(?i)\b(?:win|won|winning)\b"),
    "left": (r"(?i)\b(?:leave|left)\b", r"(?i)\b(?:leave|left)\b"),
    "married": (r"(?i)\b(?:marry|married)\b", r"(?i)\b(?:marry|married|marriage|wedding)\b"),
    "published": (r"(?i)\b(?:publish|published)\b", r"(?i)\b(?:publish|published)\b"),
    "released": (r"(?i)\b(?:release|released)\b", r"(?i)\b(?:release|released)\b"),
    "born": (r"(?i)\bborn\b", r"(?i)\bborn\b"),
}
MONTHS = "january february march april may june july august september october november december".split()
SHORT_MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12}
_MONTH = "|".join([*MONTHS, *SHORT_MONTHS])
FULL_DATE = rf"(?i)\b(?:({_MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+((?:1[6-9]|20)\d{{2}})|(\d{{1,2}})(?:st|nd|rd|th)?\s+({_MONTH})\.?\s+((?:1[6-9]|20)\d{{2}}))\b"
YEAR = r"\b(1[6-9]\d{2}|20\d{2})\b"
LENGTH = r"(?i)(\d+(?:\.\d+)?)\s*-?\s*(miles|mile|mi|km|kilometers|kilometres)\b"
SEASON = r"(?i)season\s+(\d+)[^\d%]{0,140}?(\d{1,3})\s*(?:%|percent\b)|(\d{1,3})\s*(?:%|percent\b)[^\d%]{0,140}?season\s+(\d+)"
CENTURY_WORD = r"(?i)\b(\d{1,2}(?:st|nd|rd|th)|sixteenth|seventeenth|eighteenth|nineteenth|twentieth|twenty-first)\s+century\b"
CENTURY_NAMES = {"sixteenth": "16th", "seventeenth": "17th", "eighteenth": "18th", "nineteenth": "19th", "twentieth": "20th", "twenty-first": "21st"}
NAMING = r"(?i)\b(?:chosen|named|called|coined|current name|name was|name dates|known as)\b"
ORIGIN = r"(?i)\b(?:harks? back|dates? back|originat\w*|originally|birthday|tradition)\b"
EVENT_VERB = r"(?i)\b(?:married|marry|wedding|marriage|opened|died|won|born)\b"
SINCE = r"(?i)\b(?:since|became|appointed|named|took over|elected|joined)\b"
STOP = "a an the of in on at to for from with and or when that this was were got did does after before exactly originally current name day year years".split()
NAMES = r"\b[A-Z][\p{L}0-9'’.-]*(?:\s+[A-Z][\p{L}0-9'’.-]*){0,5}"
PERIOD_WORD = r"(?i)^(?:january|february|march|april|may|june|july|august|september|october|november|december|monday|tuesday|wednesday|thursday|friday|saturday|sunday)$"


def cleaned(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[?.]+$", ""), r"\s+", " "))


def key_words(s: Column) -> Column:
    """Words of four and more characters that aren't too common to count."""
    return F.filter(F.split(F.lower(s), "[^a-z0-9]+"), lambda w: (F.length(w) >= 4) & ~F.array_contains(F.array(*map(F.lit, STOP)), w))


def _verb_of(s: Column) -> Column:
    out = F.lit(None).cast("string")
    for past, (ask, _) in reversed(VERBS.items()):
        out = F.when(s.rlike(ask), past).otherwise(out)
    return out


def plan(question: Column) -> Column:
    """(kind, a, b, n): how a question is to be answered; kind is null for one without such a form.

    age: how old a was at b; offset: the a that opened n years after b; born: a is the person whose birth year stands in
    the question; ratio: how often b goes into a; score: the newest season of a; year: a happened, b is its verb;
    century: b says that a name is asked for; tenure: since when a has been b.
    """
    g = lambda p, i: cleaned(F.regexp_extract(question, p, i))
    title = F.when(question.rlike(SEASON_OF), g(SEASON_OF, 1)).otherwise(
        cleaned(F.regexp_replace(question, r"(?i)\b(?:what(?:'s| is)|current|tomatometer|score|most|recent|latest|season|rotten|tomatoes|metacritic)\b", " "))
    )
    none = F.lit(None).cast("string")
    made = lambda kind, a, b, n=F.lit(None): F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), n.cast("int").alias("n"))
    did = F.regexp_extract(question, WHAT_YEAR, 1)
    return (
        F.when(question.rlike(TENURE), made("tenure", g(TENURE, 1), g(TENURE, 2)))
        .when(question.rlike(AGE), made("age", g(AGE, 1), g(AGE, 2)))
        .when(question.rlike(IF_ON), made("ratio", g(IF_ON, 1), g(IF_ON, 2)))
        .when(question.rlike(OFFSET), made("offset", g(OFFSET, 1), g(OFFSET, 3), F.regexp_extract(question, OFFSET, 2)))
        .when(question.rlike(SCORE) & question.rlike(NEWEST), made("score", title, none))
        .when(question.rlike(WHAT_YEAR) & _verb_of(did).isNotNull(), made("year", cleaned(did), _verb_of(did)))
        .when(question.rlike(BORN_IN), made("born", g(BORN_IN, 1), none))
        .when(question.rlike(CENTURY), made("century", none, F.when(question.rlike(NAME_ASKED), "name")))
        .otherwise(made(None, none, none))
    )


def first_searches(question: Column) -> Column:
    """The searches that find the facts a plan needs, to be run beside the question's own."""
    place = F.regexp_extract(question, OPENING_PLACE, 1)

    def of(p: Column) -> Column:
        say = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
        opening = F.when(place != "", say(cleaned(place), " opening date")).otherwise(say("when ", p["b"]))
        return (
            F.when(p["kind"] == "age", F.array(say(p["a"], " date of birth"), say(p["b"], " date")))
            .when(p["kind"] == "offset", F.array(opening))
            .when((p["kind"] == "born"), F.array(say(p["a"], " birth year")))
            .when(p["kind"] == "ratio", F.array(say(p["a"], " distance"), say(p["b"], " length")))
            .when((p["kind"] == "score") & (p["a"] != ""), F.array(say(p["a"], " rotten tomatoes tomatometer")))
            .otherwise(F.array().cast("array<string>"))
        )

    return let(plan(question), of)


def _month_number(word: Column) -> Column:
    names = {m: i + 1 for i, m in enumerate(MONTHS)} | SHORT_MONTHS
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.lower(word))


def _both(text: Column, pattern: str, i: int, j: int) -> Column:
    return F.concat(F.regexp_extract(text, pattern, i), F.regexp_extract(text, pattern, j))


def sentences(evidence: DataFrame, scope: str, source: str, text: str) -> DataFrame:
    """(scope, source, pos, sentence) of the evidence; a decimal point and an initial don't end one."""
    parts = F.split(F.col(text), r"(?<=[.!?;])(?<!\b[A-Z]\.)\s+|\n+")
    return evidence.select(scope, source, F.posexplode(parts).alias("pos", "sentence")).where(F.length("sentence") > 0)


def dates(said: DataFrame) -> DataFrame:
    """Full dates of sentences, one row each: date, its place and how it is written."""
    rows = said.withColumn("hit_", F.explode(spans(F.col("sentence"), FULL_DATE, "")))
    t = F.col("hit_.text")
    date = F.try_make_timestamp(_both(t, FULL_DATE, 3, 6).cast("int"), _month_number(_both(t, FULL_DATE, 1, 5)), _both(t, FULL_DATE, 2, 4).cast("int"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)")).cast("date")
    return rows.select("*", date.alias("date"), F.col("hit_.start").alias("at"), t.alias("raw")).drop("hit_").where("date IS NOT NULL")


def years(said: DataFrame) -> DataFrame:
    rows = said.withColumn("hit_", F.explode(spans(F.col("sentence"), YEAR, "")))
    return rows.select("*", F.col("hit_.text").cast("int").alias("year"), F.col("hit_.start").alias("at")).drop("hit_")


def lengths(said: DataFrame) -> DataFrame:
    """Lengths of sentences in miles, with how many decimals each is written with."""
    rows = said.withColumn("hit_", F.explode(spans(F.col("sentence"), LENGTH, "")))
    t = F.col("hit_.text")
    n, metric = F.regexp_extract(t, LENGTH, 1), F.lower(F.regexp_extract(t, LENGTH, 2)).startswith("k")
    precision = F.length(F.regexp_extract(n, r"\.(\d+)", 1)) + F.when(metric, 0.0).otherwise(0.1)
    return rows.select("*", F.when(metric, n.cast("double") / 1.60934).otherwise(n.cast("double")).alias("miles"), precision.alias("precision"), F.col("hit_.start").alias("at"), t.alias("raw")).drop("hit_")


def _shared(words: str, sentence: str) -> Column:
    return F.size(F.filter(F.array_distinct(words), lambda w: F.contains(F.lower(sentence), w)))


def _first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    return df.withColumn("nth_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth_ = 1").drop("nth_")


_KEYS = ["q_id", "kind"]
_PLACE = ["source", "pos", "at"]


def births(plans: DataFrame, found: DataFrame) -> DataFrame:
    """(q_id, birth, said): the date next to a plan's person, within 80 characters, in a sentence that says born between the two."""
    words = F.filter(F.transform(F.split("a", r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}.]+$", ""))), lambda w: F.length(w) >= 2)
    rows = plans.withColumn("pair_", F.concat_ws(" ", F.get(words, F.lit(0)), F.element_at(words, -1))).join(found, "scope")
    place = F.instr(F.lower("sentence"), F.col("pair_")) - 1
    rows = rows.withColumn("name_at_", place).where("name_at_ >= 0").withColumn("dist_", F.abs(F.col("at") - F.col("name_at_"))).where("dist_ <= 80")
    low, high = F.least("at", "name_at_"), F.greatest(F.col("at") + F.length("raw"), F.col("name_at_") + F.length("pair_"))
    rows = rows.where(F.substr("sentence", low + 1, high - low).rlike(r"(?i)\bborn\b"))
    return _first_by(rows, ["q_id"], "dist_", *_PLACE).select("q_id", F.col("date").alias("birth"), F.col("sentence").alias("said"))


def ages(plans: DataFrame, said: DataFrame) -> DataFrame:
    """How old a person was at an event: from birth and event date, or both possible ages where only the year is stated."""
    asked = plans.where("kind = 'age'").withColumn("words_", key_words(F.col("b")))
    found = dates(said)
    born = asked.join(births(asked, found).withColumnRenamed("said", "birth_said"), "q_id")
    events = born.join(found, "scope").where("date <> birth").withColumn("score_", _shared("words_", "sentence") + F.when(F.col("sentence").rlike(EVENT_VERB), 2).otherwise(0)).where("score_ >= 2")
    event = _first_by(events, ["q_id"], F.desc("score_"), "date", *_PLACE)
    full = event.select(*_KEYS, F.floor(F.months_between("date", "birth") / 12).cast("string").alias("lead"), F.array("birth_said", "sentence").alias("said"))
    full = full.where((F.col("lead").cast("int") >= 0) & (F.col("lead").cast("int") < 120))
    own = F.filter("words_", lambda w: ~w.rlike(EVENT_VERB))
    alone = born.join(event.select("q_id"), "q_id", "left_anti").withColumn("own_", own).where(F.size("own_") > 0).join(years(said), "scope")
    alone = alone.where((F.col("year") > F.year("birth")) & F.col("sentence").rlike(EVENT_VERB)).withColumn("score_", _shared("own_", "sentence")).where(F.col("score_") >= F.least(F.lit(2), F.size("own_")))
    year = _first_by(alone, ["q_id"], F.desc("score_"), *_PLACE).withColumn("n_", F.col("year") - F.year("birth")).where("n_ BETWEEN 1 AND 119")
    return full.unionByName(year.select(*_KEYS, F.concat((F.col("n_") - 1).cast("string"), F.lit(" or "), F.col("n_").cast("string")).alias("lead"), F.array("birth_said", "sentence").alias("said")))


def ratios(plans: DataFrame, said: DataFrame) -> DataFrame:
    """How often one length goes into another: each side's length stands in the sentence with more of its words than of the other's.

    Two writings of one length, within 0.15 miles or 8 %, are one; the more precise is taken.
    """
    asked = plans.where("kind = 'ratio'").withColumns({"event_": key_words(F.col("a")), "place_": key_words(F.col("b")), "tenth_": F.col("question").rlike(r"(?i)\bnearest tenth\b")})
    rows = asked.join(lengths(said), "scope")

    def side(own: str, other: str) -> DataFrame:
        stem = lambda w: F.when(w.endswith("s") & (F.length(w) > 4), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)
        hits = lambda words: F.size(F.filter(F.array_distinct(words), lambda w: F.contains(F.lower("sentence"), stem(w))))
        near = lambda words: F.coalesce(F.array_min(F.transform(F.filter(words, lambda w: F.contains(F.lower("sentence"), stem(w))), lambda w: F.abs(F.col("at") + 1 - F.instr(F.lower("sentence"), stem(w))))), F.lit(1 << 30))
        scored = rows.withColumns({"own_": hits(own), "other_": hits(other), "near_": near(own), "far_": near(other)})
        scored = scored.where("own_ > 0 AND (own_ > other_ OR own_ = other_ AND near_ < far_)")
        w = Window.partitionBy("q_id").orderBy(F.desc("own_"), "near_", *_PLACE)
        twins = scored.withColumn("first_", F.first("miles").over(w)).where(F.abs(F.col("miles") - F.col("first_")) <= F.greatest(F.lit(0.15), F.col("first_") * 0.08))
        return _first_by(twins, ["q_id"], F.desc("precision"), F.desc("own_"), "near_", *_PLACE)

    top = side("event_", "place_").select(*_KEYS, "tenth_", F.col("miles").alias("top_"), F.col("sentence").alias("top_said_"))
    bottom = side("place_", "event_").select("q_id", F.col("miles").alias("bottom_"), F.col("sentence").alias("bottom_said_"))
    both = top.join(bottom, "q_id").where("bottom_ > 0").withColumn("x_", F.col("top_") / F.col("bottom_")).where("x_ > 0 AND x_ <= 1000")
    lead = F.when(F.col("tenth_"), F.format_string("%.1f", F.round("x_", 1))).otherwise(F.round("x_", 0).cast("long").cast("string"))
    return both.select(*_KEYS, lead.alias("lead"), F.array("top_said_", "bottom_said_").alias("said"))


def offsets(plans: DataFrame, said: DataFrame) -> DataFrame:
    """What opened exactly n years after something: the one new name in the sentence of a date n years after another on the same day."""
    found = dates(said)
    asked = plans.where("kind = 'offset'")
    anchors = asked.join(found.select("scope", F.col("date").alias("anchor_"), F.col("sentence").alias("anchor_said_")), "scope")
    later = anchors.join(found, "scope").where((F.year("date") == F.year("anchor_") + F.col("n")) & (F.month("date") == F.month("anchor_")) & (F.dayofmonth("date") == F.dayofmonth("anchor_")))
    names = F.array_distinct(F.regexp_extract_all("sentence", F.lit(NAMES), F.lit(0)))
    lone = lambda x: (F.size(F.split(x, r"\s+")) == 1) & (F.length(x) < 5)
    new = F.filter(names, lambda x: ~F.contains(F.lower("question"), F.lower(x)) & ~F.forall(F.split(x, r"\s+"), lambda w: w.rlike(PERIOD_WORD)) & ~lone(x))
    longest = let(new, lambda ns: F.filter(ns, lambda x: ~F.exists(ns, lambda y: (F.length(y) > F.length(x)) & F.contains(y, x))))
    named = later.withColumn("names_", longest).where(F.size("names_") == 1).withColumn("name_", F.regexp_replace(F.col("names_")[0], r"[.]+$", ""))
    only = named.groupBy(*_KEYS).agg(F.count_distinct("name_").alias("c_"), F.min("name_").alias("lead"), F.min(F.array("anchor_said_", "sentence")).alias("said")).where("c_ = 1")
    return only.select(*_KEYS, "lead", "said")


def seasons(evidence: DataFrame, scope: str, source: str, text: str) -> DataFrame:
    rows = evidence.select(F.col(scope).alias("scope"), F.col(source).alias("source"), F.explode(spans(F.col(text), SEASON, "")).alias("hit_"))
    t = F.col("hit_.text")
    return rows.select("scope", "source", _both(t, SEASON, 1, 4).cast("int").alias("season"), _both(t, SEASON, 2, 3).cast("int").alias("score"), t.alias("sentence")).where("season > 0 AND score <= 100")


def newest_scores(plans: DataFrame, evidence: DataFrame, scope: str, source: str, text: str) -> DataFrame:
    """The score of the newest season that has one."""
    rows = plans.where("kind = 'score'").join(seasons(evidence, scope, source, text), "scope")
    return _first_by(rows, ["q_id"], F.desc("season"), "source", "sentence").select(*_KEYS, F.concat(F.col("score").cast("string"), F.lit("%")).alias("lead"), F.array("sentence").alias("said"))


def _near_verb(verb: Column, slice_: Column) -> Column:
    """The place of a verb's forms in a text, 0 if there is none."""
    out = F.lit(0)
    for past, (_, near) in VERBS.items():
        out = F.when(verb == past, F.regexp_instr(slice_, F.lit(near))).otherwise(out)
    return out


def stated_years(plans: DataFrame, said: DataFrame) -> DataFrame:
    """The year nearest to the asked verb: the verb stands within 90 characters before it or 20 behind."""
    rows = plans.where("kind = 'year'").join(years(said), "scope")
    begin = F.greatest(F.lit(0), F.col("at") - 90)
    rows = rows.withColumn("begin_", begin).withColumn("verb_at_", _near_verb(F.col("b"), F.substr("sentence", F.col("begin_") + 1, F.col("at") + 20 - F.col("begin_")))).where("verb_at_ > 0")
    dist = F.abs(F.col("verb_at_") - 1 - F.least(F.lit(90), F.col("at")))
    return _first_by(rows.withColumn("dist_", dist), ["q_id"], "dist_", *_PLACE).select(*_KEYS, F.col("year").cast("string").alias("lead"), F.array("sentence").alias("said"))


def centuries(plans: DataFrame, said: DataFrame) -> DataFrame:
    """The century of a name: stated in a sentence about naming (rather one that doesn't tell the custom's origin), else of the year next to such words; two centuries give none."""
    asked = plans.where("kind = 'century'")
    word = F.lower(F.regexp_extract("hit_.text", CENTURY_WORD, 1))
    names = F.create_map(*(F.lit(x) for pair in CENTURY_NAMES.items() for x in pair))
    rows = asked.join(said.withColumn("hit_", F.explode(spans(F.col("sentence"), CENTURY_WORD, ""))), "scope")
    rows = rows.withColumn("lead_", F.concat(F.lit("the "), F.coalesce(F.try_element_at(names, word), word), F.lit(" century")))
    naming = rows.where(F.col("b").isNotNull() & F.col("sentence").rlike(NAMING)).withColumn("mixed_", F.col("sentence").rlike(ORIGIN))
    sets = naming.groupBy(*_KEYS, "mixed_").agg(F.count_distinct("lead_").alias("c_"), F.min("lead_").alias("lead"), F.array(F.min("sentence")).alias("said"))
    best = _first_by(sets, ["q_id"], "mixed_").where("c_ = 1")
    several = sets.select("q_id").distinct()
    plain = _first_by(rows.where("b IS NULL"), ["q_id"], "source", "pos", F.col("hit_.start")).select(*_KEYS, F.col("lead_").alias("lead"), F.array("sentence").alias("said"))
    by_year = asked.join(several, "q_id", "left_anti").join(plain.select("q_id"), "q_id", "left_anti").join(years(said), "scope").where(F.col("sentence").rlike(r"(?i)\b(?:named|called|chosen|coined)\b"))
    of_year = _first_by(by_year, ["q_id"], *_PLACE).select(*_KEYS, century_of(F.col("year")).alias("lead"), F.array("sentence").alias("said"))
    return best.select(*_KEYS, "lead", "said").unionByName(plain).unionByName(of_year)


def tenures(plans: DataFrame, said: DataFrame, now: Column) -> DataFrame:
    """Completed years since the date, or the years since the year, at which a sentence with the person and the role has them begin."""
    asked = plans.where("kind = 'tenure'").withColumns({"last_": F.lower(F.element_at(F.split("a", r"\s+"), -1)), "role_": F.lower("b")})
    fits = F.contains(F.lower("sentence"), F.col("last_")) & F.contains(F.lower("sentence"), F.col("role_")) & F.col("sentence").rlike(SINCE)
    full = asked.join(dates(said), "scope").where(fits & (F.col("date") <= now))
    by_date = _first_by(full, ["q_id"], F.desc("date"), *_PLACE).select(*_KEYS, F.floor(F.months_between(now, "date") / 12).cast("string").alias("lead"), F.array("sentence").alias("said"))
    rest = asked.join(by_date.select("q_id"), "q_id", "left_anti").join(years(said), "scope").where(fits & (F.col("year") <= F.year(now)))
    by_year = _first_by(rest, ["q_id"], F.desc("year"), *_PLACE).select(*_KEYS, F.concat(F.lit("about "), (F.year(now) - F.col("year")).cast("string")).alias("lead"), F.array("sentence").alias("said"))
    return by_date.unionByName(by_year)


def planned(questions: DataFrame, q_id: str, question: str, scope: str) -> DataFrame:
    rows = questions.select(F.col(q_id).alias("q_id"), F.col(scope).alias("scope"), F.col(question).alias("question"), F.explode(F.array(plan(F.col(question)))).alias("p_"))
    return settled(rows.select("q_id", "scope", "question", "p_.*").where("kind IS NOT NULL"))


def answers(questions: DataFrame, evidence: DataFrame, q_id: str, question: str, scope: str, source: str, text: str, now: Column) -> DataFrame:
    """(q_id, kind, lead, said): questions of a known form that the evidence of their scope answers, with the sentences that do so."""
    plans = planned(questions, q_id, question, scope)
    said = settled(sentences(evidence, scope, source, text).select(F.col(scope).alias("scope"), F.col(source).alias("source"), "pos", "sentence"))
    parts = [ages(plans, said), ratios(plans, said), offsets(plans, said), newest_scores(plans, evidence, scope, source, text), stated_years(plans, said), centuries(plans, said), tenures(plans, said, now)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("q_id", q_id)


def next_searches(questions: DataFrame, evidence: DataFrame, q_id: str, question: str, scope: str, source: str, text: str) -> DataFrame:
    """(q_id, search): what to look for next, where the evidence binds one step of a question and the next is open.

    born: the question with the year in place of the person's birth; offset: the derived date, once an opening is known
    and as long as no source names that date; year: the event in the past tense, if no year stands next to its verb;
    score: the season after the newest one with a score, or the newest mentioned one if none has.
    """
    plans = planned(questions, q_id, question, scope)
    said = settled(sentences(evidence, scope, source, text).select(F.col(scope).alias("scope"), F.col(source).alias("source"), "pos", "sentence"))
    born = plans.where("kind = 'born'").withColumn("last_", F.element_at(key_words(F.col("a")), -1)).join(years(said), "scope").where(F.col("sentence").rlike(r"(?i)\b(?:born|birth)\b"))
    born = _first_by(born, ["q_id"], F.desc(F.contains(F.lower("sentence"), F.col("last_"))), *_PLACE)
    bound = F.regexp_replace(F.regexp_replace(cleaned(F.col("question")), BORN_IN, F.col("year").cast("string")), r"(?i)^(who|what|when|where)\s+(was|is|were|did)\s+", "")
    of_born = born.where(~F.array_contains(F.regexp_extract_all("question", F.lit(r"(?<![A-Za-z0-9])(\d{4})(?![A-Za-z0-9])"), F.lit(1)), F.col("year").cast("string"))).select("q_id", bound.alias("search"))
    opened = _first_by(plans.where("kind = 'offset'").join(dates(said), "scope").where(F.col("sentence").rlike(r"(?i)\b(?:opened|opening)\b")), ["q_id"], *_PLACE)
    when = F.date_format(F.add_months("date", F.col("n") * 12), "MMMM d, yyyy")
    place = F.regexp_extract("question", OPENING_PLACE, 1)
    derived = opened.select("q_id", "scope", when.alias("when_"), F.concat(F.when(place != "", cleaned(place)).otherwise(F.col("a")), F.lit(" opened "), when).alias("search"))
    known = derived.join(said, "scope").where(F.contains(F.lower("sentence"), F.lower("when_"))).select("q_id").distinct()
    of_offset = derived.join(known, "q_id", "left_anti").select("q_id", "search")
    asked = plans.where("kind = 'year'").join(stated_years(plans, said).select("q_id"), "q_id", "left_anti")
    past = F.col("a")
    for form, (ask, _) in VERBS.items():
        past = F.when(F.col("b") == form, F.regexp_replace("a", ask, form)).otherwise(past)
    of_year = asked.select("q_id", F.concat(cleaned(past), F.lit(" year")).alias("search"))
    scored = seasons(evidence, scope, source, text).groupBy("scope").agg(F.max("season").alias("scored_"))
    named = F.flatten(F.array(F.regexp_extract_all("sentence", F.lit(r"(?i)\bseason\s+(\d+)\b"), F.lit(1)), F.regexp_extract_all("sentence", F.lit(r"(?i)\b(\d+)\s+seasons?\b"), F.lit(1))))
    mentioned = said.withColumn("m_", F.explode(named)).where(F.col("m_").try_cast("int").between(1, 39)).groupBy("scope").agg(F.max(F.col("m_").cast("int")).alias("mentioned_"))
    target = F.when(F.col("scored_").isNotNull(), F.col("scored_") + 1).otherwise(F.col("mentioned_"))
    of_score = plans.where("kind = 'score' AND a <> ''").join(scored, "scope", "left").join(mentioned, "scope", "left").withColumn("t_", target).where("t_ IS NOT NULL")
    of_score = of_score.select("q_id", F.concat("a", F.lit(" season "), F.col("t_").cast("string"), F.lit(" rotten tomatoes")).alias("search"))
    return of_born.unionByName(of_offset).unionByName(of_year).unionByName(of_score).withColumnRenamed("q_id", q_id)
