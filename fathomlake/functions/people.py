"""What a result row says of a person: name, roles, places, organisations and a title's qualifier, as columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomlake.functions.reading import lookup
from fathomlake.functions.text import host_of, let

# Roles, words that mean nothing in a capture, capture patterns.
ROLE_PAIRS = ("software engineer", "software developer", "concert pianist", "general dentist", "prime minister", "chief executive", "medical doctor")
ROLES = tuple(
    (
        "actor actress engineer mayor mayoral dentist pianist president presidential senator doctor physician lawyer attorney professor teacher ceo cto cfo coo"
        " founder author writer singer musician player athlete coach judge officer nurse designer artist director manager analyst scientist researcher developer"
        " executive consultant comedian governor representative secretary chef photographer architect pharmacist therapist surgeon pilot astronaut journalist"
        " reporter editor producer entrepreneur investor banker economist historian activist politician diplomat sheriff clerk violinist guitarist drummer"
        " composer dancer poet novelist scholar restaurateur businessman businesswoman dean principal quarterback pitcher chairman spokesperson librarian pastor"
        " rabbi monk chief king queen prince princess"
    ).split()
)
SAME_ROLE = {"mayoral": "mayor", "presidential": "president"}
SITES = tuple(
    "wikipedia wiktionary wikimedia wikidata wikiquote wikisource imdb linkedin facebook instagram twitter youtube tiktok fandom reddit google amazon spotify gaana zoominfo crunchbase quora pinterest bibliocommons baidu baike".split()
)
JUNK = tuple(
    (
        "it he she they his her its their this that these those there here the a an and or but in on at of for with by from to as also other others more new"
        " first one two all some many january february march april may june july august september october november december jan feb mar apr jun jul aug sep"
        " sept oct nov dec monday tuesday wednesday thursday friday saturday sunday today yesterday page article list see category help edit"
    ).split()
)
GENERIC = tuple("the of and for at in a an inc llc ltd co corp company group official".split())
AFTER_NAME = tuple(
    (
        "is was as the a an of at in on for and or who whose from with to by ceo cto cfo coo vp co-founder founder director mayor dr mr ms mrs jr sr ii iii phd"
        " md esq presidential center centre foundation library institute university college hospital school museum park bridge administration biography official"
        " former family memorial stadium airport boulevard avenue street inc llc ltd corp co ai ml"
    ).split()
)
PHRASE = r"([A-Z][\w&.'-]*(?:\s+[A-Z][\w&.'-]*){0,2})"
SHORT_PHRASE = r"([A-Z][\w&.'-]*(?:\s+[A-Z][\w&.'-]*){0,1})"
AT_ROLE = "CEO|CTO|CFO|COO|founder|co-founder|president|professor|engineer|developer|designer|manager|director|analyst|scientist|star|player|coach|reporter|partner"
BEFORE_ROLE = "engineer|actor|mayor|dentist|pianist|president|reporter|analyst|designer|developer|manager|director|coach|player|star|employee"
ORGANISATIONS = (
    rf"\bworks?\s+(?:at|for)\s+(?:the\s+)?{PHRASE}",
    rf"\b(?:employed by|joined|hired by)\s+(?:the\s+)?{PHRASE}",
    rf"(?i)\b(?:{AT_ROLE})\s+(?:at|of)\s+(?:the\s+)?{PHRASE}",
    rf"\b(?:at|for|from|of)\s+(?:the\s+)?{PHRASE}",
    rf"\b{PHRASE}\s+(?:{BEFORE_ROLE})\b",
)
PLACES = (
    rf"(?i)\bmayor\s+of\s+(?:the\s+)?{PHRASE}",
    rf"(?i)\b(?:based|living|born|raised)\s+in\s+(?:the\s+)?{PHRASE}",
    rf"(?i)\blives?\s+in\s+(?:the\s+)?{PHRASE}",
    rf"(?i)\b(?:dentist|doctor|practice|office|firm|hospital|clinic|school)\s+in\s+(?:the\s+)?{PHRASE}",
    rf"\bin\s+(?:the\s+)?{SHORT_PHRASE}",
)
SENTENCE_END = r"(?<!\b[A-Z])(?<!\b(?i:u\.s|st|jr|sr|dr|mr|mrs|ms|inc|co))[.!?]\s+(?=[A-Z])[\s\S]*$"
YEAR_ONLY = r"(?i)^(?:(?:born|b\.|died|d\.)\s*(?:c\.\s*)?\d{3,4}|\d{3,4}s?)$"
REGNAL = r"^[A-Z][a-z]+\s+(?:I|II|III|IV|V|VI|VII|VIII|IX|X)$"

_ACCENTED = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFKD", chr(c))) > 1]
_PLAIN = [(a, b) for a, b in _ACCENTED if b.isascii() and b.isalpha()]


def folded(text: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.lower(F.translate(text, "".join(a for a, _ in _PLAIN), "".join(b for _, b in _PLAIN)))


def tokens(text: Column) -> Column:
    return F.filter(F.split(folded(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def _words(*values: str) -> Column:
    return F.array(*map(F.lit, values))


def core_words(phrases: Column) -> Column:
    """Distinct words of two letters and more of an array of phrases, without generic ones."""
    words = F.flatten(F.transform(phrases, tokens))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~F.array_contains(_words(*GENERIC), w)))


def clean_capture(raw: Column) -> Column:
    """A captured name of a place or an organisation without what runs on after it; '' where nothing is left of it."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(raw, r"\s+", " "), r"[.,;:!?]+$", ""))
    cut = F.trim(F.regexp_replace(F.regexp_replace(flat, SENTENCE_END, ""), r"""[\s.,;:!?…“”"'’)\]}–—-]+$""", ""))

    def kept(s: Column) -> Column:
        sites = F.arrays_overlap(F.split(F.lower(s), "[^a-z0-9]+"), _words(*SITES))
        return F.when((F.length(s) < 2) | s.rlike(YEAR_ONLY) | s.rlike(REGNAL) | sites | F.array_contains(_words(*JUNK), F.lower(s)), "").otherwise(s)

    return let(cut, kept)


def _distinct_by_case(values: Column) -> Column:
    """The first of the values that differ in case only."""
    return let(values, lambda vs: let(F.transform(vs, lambda v: F.lower(v)), lambda lower: F.filter(vs, lambda v, i: (v != "") & (F.array_position(lower, F.lower(v)) == i + 1))))


def places(title: Column, snippet: Column) -> Column:
    """Places in the order of title and snippet, each pattern's first in each; a capture never spans the two."""
    found = [F.regexp_extract(F.coalesce(s, F.lit("")), p, 1) for s in (title, snippet) for p in PLACES]
    return _distinct_by_case(F.transform(F.array(*found), clean_capture))


def organisations(title: Column, snippet: Column, found_places: Column) -> Column:
    """Organisations, all of each pattern, without those that are places."""
    found = F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(p), F.lit(1)) for s in (title, snippet) for p in ORGANISATIONS)))
    cleaned = F.transform(F.transform(found, lambda v: F.regexp_replace(v, r"(?i)^(?:the|a|an)\s+", "")), clean_capture)
    return _distinct_by_case(let(F.transform(found_places, lambda v: F.lower(v)), lambda known: F.filter(cleaned, lambda v: ~F.array_contains(known, F.lower(v)))))


def qualifier(title: Column) -> Column:
    """What a title has in its first parentheses, in lower case, if that has a letter."""
    inside = F.lower(F.trim(F.regexp_extract(F.coalesce(title, F.lit("")), r"\(\s*([^()]{1,40})\s*\)", 1)))
    return F.when(inside.rlike("[a-z]"), inside)


def roles(text: Column, inside: Column) -> Column:
    """Roles that the text or the title's qualifier names: pairs of words first, then single words, one name each."""

    def named(words: Column) -> Column:
        own = F.concat(words, F.coalesce(tokens(inside), F.array().cast("array<string>")))
        single = F.filter(own, lambda w: F.array_contains(_words(*ROLES), w))
        in_text = lambda flat: F.filter(_words(*ROLE_PAIRS), lambda p: F.contains(flat, F.concat(F.lit(" "), p, F.lit(" "))) | F.contains(F.coalesce(inside, F.lit("")), p))
        pairs = let(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), in_text)
        return F.array_distinct(F.transform(F.concat(pairs, single), lambda w: F.coalesce(lookup(SAME_ROLE, w), w)))

    return let(tokens(text), named)


def has_full_name(name: Column, segment: Column) -> Column:
    """Whether a text has all words of a name of two or more in a row, one initial between first and next allowed, and not as part of a longer name.

    A capitalised word that follows at once is a longer name, unless it is one of a few that follow names, or a short
    label in capitals; so is the first name repeated before it.
    """

    def judged(want: Column, raw: Column, clean: Column) -> Column:
        n = F.size(want)
        at = F.sequence(F.lit(1), F.size(raw))

        def ends(i: Column) -> Column:
            """Where the name that begins at word i ends, or null."""
            plain = F.slice(clean, i, n) == want
            initial = (F.get(clean, i - 1) == F.get(want, F.lit(0))) & (F.length(F.get(clean, i)) == 1) & (F.slice(clean, i + 2, n - 1) == F.slice(want, F.lit(2), n - 1))
            return F.when(plain, i + n - 1).when(initial, i + n)

        def longer(e: Column) -> Column:
            following = F.get(raw, e)
            runs_on = F.get(raw, e - 1).rlike(r"[\p{L}\p{N}]$") & following.rlike(r"^[A-Z][A-Za-z'’-]") & ~following.rlike(r"^[A-Z]{2,5}\b")
            return F.coalesce(runs_on & ~F.array_contains(_words(*AFTER_NAME), F.get(clean, e)), F.lit(False))

        doubled = F.exists(at, lambda i: (F.get(clean, i - 1) == F.get(want, F.lit(0))) & (F.slice(clean, i + 1, n) == want))
        found = F.filter(F.transform(at, ends), lambda e: e.isNotNull())
        return F.when(n >= 2, let(found, lambda f: (F.size(f) > 0) & ~F.exists(f, longer)) & ~doubled).otherwise(False)

    words = F.split(F.trim(F.coalesce(segment, F.lit(""))), r"\s+")
    bare = lambda raw: F.transform(raw, lambda w: F.regexp_replace(folded(w), "[^a-z0-9]+", ""))
    return let(F.filter(tokens(name), lambda w: F.length(w) >= 2), lambda want: let(words, lambda raw: let(bare(raw), lambda clean: judged(want, raw, clean))))


def signals(name: Column, title: Column, snippet: Column, url: Column) -> Column:
    """has_name, roles, orgs, locs, paren and sig (all words that tell one person from the next) of a row."""
    named = has_full_name(name, title) | has_full_name(name, snippet)

    def all_of(inside: Column, found_roles: Column, locs: Column, orgs: Column) -> Column:
        of_roles = F.flatten(F.transform(found_roles, lambda r: F.split(r, " ")))
        of_paren = F.coalesce(F.filter(F.split(inside, "[^a-z]+"), lambda w: F.length(w) >= 2), F.array().cast("array<string>"))
        sig = F.array_distinct(F.concat(of_roles, core_words(orgs), core_words(locs), of_paren))
        return F.struct(named.alias("has_name"), found_roles.alias("roles"), orgs.alias("orgs"), locs.alias("locs"), inside.alias("paren"), sig.alias("sig"), host_of(url).alias("host"))

    def with_places(inside: Column, found_roles: Column, locs: Column) -> Column:
        return let(organisations(title, snippet, locs), lambda orgs: all_of(inside, found_roles, locs, orgs))

    text = F.concat_ws(" ", title, snippet, url)
    return let(qualifier(title), lambda i: let(roles(text, i), lambda r: let(places(title, snippet), lambda p: with_places(i, r, p))))
