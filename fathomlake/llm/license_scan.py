"""Licence notices in documents: Dice coefficient over word bigrams against templates, in column expressions only.

A document's units are its lines, its paragraphs and the whole text. A unit is normalised (A-Z lower-cased, everything
but a-z and 0-9 a space). With sets of a and b word bigrams, c of them in common, the coefficient is 2c / (a + b). It
can reach the threshold t only where a t / (2 - t) <= b <= a (2 - t) / t, so templates are filed under each size of
set that they can match; a unit fetches the candidates of its own size and no others. Templates are a fixed list and
travel as a literal map; nothing is joined or shuffled.

A notice that shares its line with other words is found by windows over the words of the whole text, of as many bigrams
as the template has (fewer at the text's end). Only windows that begin with a bigram of the template are tried: any
other loses nothing by beginning a word later. A window inside a unit that has matched the same licence is that unit's.

Of a template's bigrams, what reaches the threshold has so many that it can't lack all that a few words or bigrams (its
keys) stand in. One regular expression passes over texts without any key, which most are.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD = 0.8

BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"
)
BSD_3 = f"{BSD}. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)

#: Usual wordings of notices and of the grants themselves, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "Licensed under the Simplified BSD License.", f"{BSD}.", f"{BSD}. {AS_IS}"),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        BSD_3,
        f"{BSD_3} {AS_IS}",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "EPL-2.0": (
        "Released under the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        MIT,
        f"{MIT} {MIT_REST}",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}


def template_rows(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> list[tuple[str, list[str]]]:
    """(licence, distinct bigrams, sorted) of each template; one of fewer than two words has none and matches nothing."""
    rows = []
    for licence, wordings in sorted(templates.items()):
        for text in wordings:
            words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
            if len(words) > 1:
                rows.append((licence, sorted({f"{a} {b}" for a, b in zip(words, words[1:])})))
    return rows


def sizes(n: int, threshold: float) -> range:
    """Numbers of bigrams that a unit can have to reach the threshold with a template of n."""
    return range(max(1, math.ceil(n * threshold / (2 - threshold) - 1e-9)), math.floor(n * (2 - threshold) / threshold + 1e-9) + 1)


#: Words that stand in most texts, and are no keys by themselves.
COMMON = frozenset("above after any available before charge code conditions contract copies copy either extent following forms general holder later limited notice persons provided public published released rights software source subject under universal version which without".split())
#: A shorter word is no key by itself: it may be a usual word of another language.
KEY_LETTERS = 5


def least_shared(n: int, threshold: float) -> int:
    """Bigrams that a unit has at least in common with a template of n to reach the threshold."""
    return math.ceil(threshold * (n + sizes(n, threshold)[0]) / 2 - 1e-9)


def keys(bigrams: list[str], threshold: float) -> list[str]:
    """Words and bigrams of which whatever reaches the threshold has one: it can't do without all bigrams they stand in."""
    left, need = set(bigrams), least_shared(len(bigrams), threshold)
    telling = lambda w: len(w) >= KEY_LETTERS and w not in COMMON
    chosen = []
    while len(left) >= need:
        words = {w for b in left for w in b.split() if telling(w)}
        if words:
            chosen.append(min(words, key=lambda w: (-sum(w in b.split() for b in left), w)))
            left = {b for b in left if chosen[-1] not in b.split()}
        else:
            usual = lambda w: len(w) < 2 or w in COMMON or w in ("the", "by", "of", "and", "to", "is")
            chosen.append(min(left, key=lambda b: (sum(map(usual, b.split())), -len(b), b)))
            left.discard(chosen[-1])
    return chosen


def key_pattern(templates: dict[str, tuple[str, ...]], threshold: float) -> str:
    """A regular expression that finds a key of some template between what is no letter or digit."""
    found = sorted({k.replace(" ", "[^a-z0-9]+") for _, b in template_rows(templates) for k in keys(b, threshold)})
    return f"(?i)(?<![a-z0-9])(?:{'|'.join(found)})(?![a-z0-9])"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: what a lambda reads from outside is else computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bigrams_of(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))


def windows(text: Column, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """array<struct<score, licence, unit>>: of each template that some window reaches the threshold with, the best (then first) window."""
    rows = []
    for licence, own in template_rows(templates):
        numbers = {"n": len(own), "least": least_shared(len(own), threshold)}
        rows.append(F.struct(F.lit(licence).alias("licence"), *(F.lit(v).alias(k) for k, v in numbers.items()), F.array(*map(F.lit, own)).alias("bigrams")))
    table = F.array(*rows)

    def best(words: Column, bigrams: Column, t: Column) -> Column:
        hits = F.filter(F.transform(bigrams, lambda b, i: F.struct(i.alias("i"), b.alias("b"))), lambda x: F.array_contains(t["bigrams"], x["b"]))

        def of(hits: Column) -> Column:
            at = lambda k: F.get(hits, k)["i"]
            starts = F.filter(F.sequence(F.lit(0), F.size(hits) - t["least"]), lambda k: at(k + t["least"] - 1) - at(k) < t["n"])

            def scored(k: Column) -> Column:
                window = F.array_distinct(F.slice(bigrams, at(k) + 1, t["n"]))
                return let(window, lambda w: F.struct((F.lit(-2.0) * F.size(F.array_intersect(w, t["bigrams"])) / (F.size(w) + t["n"])).alias("minus"), at(k).alias("start")))

            found = F.array_min(F.transform(starts, scored))
            unit = lambda w: F.array_join(F.slice(words, w["start"] + 1, t["n"] + 1), " ")
            return F.when(F.size(hits) >= t["least"], let(found, lambda w: F.when(w["minus"] <= -threshold, F.struct((-w["minus"]).alias("score"), t["licence"].alias("licence"), unit(w).alias("unit")))))

        return let(hits, of)

    inside = lambda words: let(bigrams_of(words), lambda bigrams: F.filter(F.transform(table, lambda t: best(words, bigrams, t)), lambda w: w.isNotNull()))
    return let(F.split(normalised(text), " "), lambda words: F.when(F.size(words) > 1, inside(words)))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " "))


def notices(text: Column, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """array<struct<score, licence, unit>> of what reaches the threshold; equal units of a text count once."""
    by_size: dict[int, list[Column]] = {}
    for licence, bigrams in template_rows(templates):
        entry = F.struct(F.lit(licence).alias("licence"), F.lit(len(bigrams)).alias("n"), F.array(*map(F.lit, bigrams)).alias("bigrams"))
        for n in sizes(len(bigrams), threshold):
            by_size.setdefault(n, []).append(entry)
    index = F.create_map(*[x for n, rows in sorted(by_size.items()) for x in (F.lit(n), F.array(*rows))])
    raw = F.concat(F.split(text, "\n"), F.filter(F.split(text, "\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("\n"))), F.array(text))
    units = F.filter(F.array_distinct(F.transform(raw, normalised)), lambda u: F.contains(u, F.lit(" ")))

    def scored(unit: Column) -> Column:
        dice = lambda own, t: F.lit(2.0) * F.size(F.array_intersect(own, t["bigrams"])) / (F.size(own) + t["n"])
        rows = lambda own: F.transform(F.try_element_at(index, F.size(own)), lambda t: F.struct(dice(own, t).alias("score"), t["licence"].alias("licence"), unit.alias("unit")))
        return F.filter(let(F.array_distinct(bigrams_of(F.split(unit, " "))), rows), lambda r: r["score"] >= threshold)

    return F.flatten(F.filter(F.transform(units, scored), lambda rows: rows.isNotNull()))


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """For every row: doc_id, licences (distinct, sorted, comma-joined), n_notices, best_licence, best_score.

    n_notices counts distinct units that reach the threshold with some template, and distinct windows, the best of each
    template, that stand in none of those and in no longer window. The best has the highest score, the
    first licence by name among equals. Null and empty texts, and texts without a notice: '', 0, null, null.
    """
    text = F.when(F.col("text").rlike(key_pattern(templates, threshold)), F.col("text"))
    none = F.array().cast("array<struct<score:double,licence:string,unit:string>>")
    found = docs.select("doc_id", *(F.when(text.isNotNull(), f(text, templates, threshold)).otherwise(none).alias(name) for name, f in (("units", notices), ("windows", windows))))
    within = lambda w, u: F.contains(F.concat(F.lit(" "), u, F.lit(" ")), F.concat(F.lit(" "), w, F.lit(" ")))
    fresh = F.filter("windows", lambda w: ~F.exists("units", lambda u: (u["licence"] == w["licence"]) & within(w["unit"], u["unit"])))
    found = found.select("doc_id", "units", F.coalesce(fresh, F.expr("slice(units, 1, 0)")).alias("windows"))
    found = found.select("doc_id", "units", "windows", F.concat("units", "windows").alias("found"))
    whole = F.array_distinct(F.transform("units", lambda u: u["unit"]))
    # Windows of several templates over the same words are one notice, that of the longest.
    alone = F.filter("windows", lambda w: ~F.exists("found", lambda o: (o["unit"] != w["unit"]) & within(w["unit"], o["unit"])))
    best = F.reduce("found", F.struct(F.lit(0.0).alias("score"), F.lit("").alias("licence")), lambda b, r: F.when((r["score"] > b["score"]) | ((r["score"] == b["score"]) & (r["licence"] < b["licence"])), F.struct(r["score"].alias("score"), r["licence"].alias("licence"))).otherwise(b))
    some = F.size("found") > 0
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda r: r["licence"]))), ",").alias("licences"),
        F.size(F.array_union(whole, F.transform(alone, lambda w: w["unit"]))).cast("long").alias("n_notices"),
        F.when(some, best["licence"]).alias("best_licence"),
        F.when(some, F.round(best["score"], 6)).alias("best_score"),
    )


def oracle_sql(templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same rows in DuckDB, every template tried on every unit; it tries no windows, so notices inside prose are not in it."""
    rows = ", ".join(f"('{licence}', {len(b)}, {b!r})" for licence, b in template_rows(templates))
    return f"""
WITH templates(licence, n, bigrams) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
raw AS (
  SELECT k, unnest(list_concat(list_concat(string_split(text, chr(10)), string_split_regex(text, '\\n[ \\t\\r]*\\n')), [text])) AS unit FROM docs),
units AS (SELECT DISTINCT k, trim(regexp_replace(translate(unit, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')) AS unit FROM raw),
words AS (SELECT k, unit, string_split(unit, ' ') AS w FROM units WHERE unit <> ''),
grams AS (SELECT k, unit, len(b) AS n, b FROM (SELECT k, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM words WHERE len(w) > 1)),
scored AS (
  SELECT k, unit, licence, 2.0::DOUBLE * len(list_intersect(b, bigrams)) / (g.n + t.n) AS score
  FROM grams g CROSS JOIN templates t WHERE g.n <= 2 * t.n AND t.n <= 2 * g.n),
hits AS (SELECT * FROM scored WHERE score >= {threshold}),
best AS (
  SELECT k, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, count(DISTINCT unit) AS n_notices,
    arg_min(licence, (-score, licence)) AS best_licence, round(max(score), 6) AS best_score
  FROM hits GROUP BY k)
SELECT doc_id, coalesce(licences, '') AS licences, coalesce(n_notices, 0) AS n_notices, best_licence, best_score
FROM docs LEFT JOIN best USING (k)"""
