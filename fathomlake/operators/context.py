"""Nested rows and contexts within a budget of bytes or characters, by folds over arrays and ordered fallbacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomlake.functions.text import let


PAYLOAD_MAX = 32_000
HEADER = "Earlier turns, oldest first:"


def fit_context(text: Column, most: int) -> Column:
    """A context in at most `most` characters, in its order: earlier turns (lines that begin with `- Q: `) go first, the oldest before the newest.

    All other lines stay; turns come back from the newest on while they fit, and the header goes with the last of them.
    Where the rest is still too long, the longest lines are cut to 40 characters at least, an ellipsis at their end; what
    is too long even then is cut off. A null is empty.
    """
    is_turn = lambda line: line.startswith("- Q: ")

    def kept(lines: Column) -> Column:
        fixed = F.aggregate(lines, F.lit(0), lambda n, x: n + F.when(is_turn(x), 0).otherwise(F.length(x) + 1))
        start = F.struct(fixed.alias("size"), F.array().cast("array<string>").alias("lines"), F.lit(False).alias("turns"))

        def step(s: Column, x: Column) -> Column:
            fits = is_turn(x) & (s["size"] + F.length(x) + 1 <= most)
            stays = ~is_turn(x) | fits
            return F.struct(
                (s["size"] + F.when(fits, F.length(x) + 1).otherwise(0)).alias("size"),
                F.when(stays, F.concat(F.array(x), s["lines"])).otherwise(s["lines"]).alias("lines"),
                (s["turns"] | fits).alias("turns"),
            )

        return let(F.aggregate(F.reverse(lines), start, step), lambda s: F.filter(s["lines"], lambda x: s["turns"] | (x != HEADER)))

    def shortened(lines: Column) -> Column:
        """One line is cut a round, the first of the longest, by as much as is over."""

        def step(s: Column, _: Column) -> Column:
            over = F.aggregate(s, F.lit(-1), lambda n, x: n + F.length(x) + 1) - most
            longest = F.array_max(F.transform(s, lambda x: F.length(x)))
            at = F.array_position(F.transform(s, lambda x: F.length(x)), longest)
            cut = F.greatest(F.lit(40), longest - over - 1)
            shorter = lambda x: F.concat(F.rtrim(F.substr(x, F.lit(1), cut)), F.lit("…"))
            return F.when((over <= 0) | (cut >= longest), s).otherwise(F.transform(s, lambda x, i: F.when(i + 1 == at, shorter(x)).otherwise(x)))

        return F.aggregate(F.sequence(F.lit(1), F.size(lines)), lines, step)

    fitted = let(kept(F.split(text, "\n")), lambda k: F.substring(F.array_join(F.when(F.size(k) > 0, shortened(k)).otherwise(k), "\n"), 1, most))
    return F.when(text.isNull(), "").when(F.length(text) <= most, text).otherwise(fitted)


def _cut(c: Column, most: int) -> Column:
    return F.substring(c, 1, most)


def pack_search(query: Column, freshness: Column, results: Column, images: Column, knowledge: Column, discussions: Column, engines: Column, most: int = PAYLOAD_MAX) -> Column:
    """A search's answer as JSON of at most `most` bytes: the first of four projections that fits.

    The first has eight results with all fields cut, four pictures, three discussions and what is known; the second has
    no page text, one picture and no discussions; the third four results with 80 characters of their snippets; the last
    none. results: title, url, snippet, domain, engines, date, content; images: url, thumb, title, source, license,
    credit; knowledge: title, extract, url, description; discussions: title, url; engines: name, ok, count, ms, error.
    """

    def result(snippet: int, content: bool):
        def of(r: Column) -> Column:
            fields = [_cut(r["title"], 180).alias("title"), _cut(r["url"], 500).alias("url"), _cut(r["snippet"], snippet).alias("snippet"), _cut(r["domain"], 120).alias("domain")]
            fields += [F.slice(r["engines"], 1, 4).alias("engines"), _cut(r["date"], 40).alias("date")]
            return F.struct(*fields, *([_cut(r["content"], 400).alias("content")] if content else []))

        return of

    image = lambda i: F.struct(*(_cut(i[c], n).alias(c) for c, n in (("url", 500), ("thumb", 500), ("title", 120), ("source", 120))), i["license"].alias("license"), _cut(i["credit"], 160).alias("credit"))
    known = F.when(knowledge.isNotNull(), F.struct(*(_cut(knowledge[c], n).alias(c) for c, n in (("title", 180), ("extract", 400), ("url", 500), ("description", 160)))))
    talk = F.transform(F.slice(discussions, 1, 3), lambda x: F.struct(_cut(x["title"], 160).alias("title"), x["url"].alias("url")))
    ran = F.transform(F.slice(engines, 1, 6), lambda e: F.struct(e["name"].alias("name"), e["ok"].alias("ok"), e["count"].alias("count"), e["ms"].alias("ms"), _cut(e["error"], 40).alias("error")))
    shown = F.transform(F.slice(images, 1, 4), image)

    def body(n: int, of, pictures: int, with_known: bool, with_talk: bool) -> Column:
        fields = [_cut(query, 400).alias("query"), freshness.alias("freshness"), F.transform(F.slice(results, 1, n), of).alias("results") if n else F.array().cast("array<string>").alias("results")]
        fields.append((F.slice(shown, 1, pictures) if pictures else F.array().cast("array<string>")).alias("images"))
        fields += [known.alias("knowledge")] if with_known else []
        fields.append((talk if with_talk else F.array().cast("array<string>")).alias("discussions"))
        return F.to_json(F.struct(*fields, ran.alias("engines")))

    shapes = [body(8, result(320, True), 4, True, True), body(8, result(320, False), 1, True, False), body(4, result(80, False), 0, False, False), body(0, None, 0, False, False)]
    fits = lambda c: let(c, lambda v: F.when(F.octet_length(v) <= most, v))
    return F.coalesce(*map(fits, shapes))


def unpacked(payload: Column, schema: str) -> Column:
    """A packed answer by its schema; null where it is no JSON object with a list of results."""
    parsed = F.from_json(payload, schema)
    return F.when(parsed["results"].isNotNull(), parsed)
