"""Licence scans and URL filters against their DuckDB oracles, on edge cases and on the small tables."""

import re

import duckdb
import pandas as pd
import pytest

from fathomlake.llm import license_scan, url_filters

SF = "/root/testdata/sf0.001"


def rows(frame):
    return sorted(map(repr, frame))


def compare(spark, df, sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    want = con.sql(sql)
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    got = [tuple(r[c] for c in names) for r in df.collect()]
    assert rows(got) == rows(con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())
    return got


TEXTS = [
    None, "", "\n\n", "Released under the MIT License.", "released   UNDER the-MIT license", "x\nLicensed under CC BY-NC 4.0.\ny",
    "Licensed under CC BY 4.0.", "Permission to use, copy, modify, and/or distribute this software for any purpose\nwith or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nfoo bar",
    "This work is licensed under the GNU General Public License, version 3.\nThis work is licensed under the GNU General Public License, version 3.", "mit", "word " * 40000, "under the under the under the under the", "Licensed under the Apache License, Version 2.0.\r\nReleased under the MIT License.",
]


def test_licence_scan(spark):
    frame = pd.DataFrame({"doc_id": pd.array([i if i != 2 else None for i in range(len(TEXTS))] + [3], "Int64"), "text": [*TEXTS, TEXTS[3]], "unit": "clash"})
    docs = spark.createDataFrame([(None if pd.isna(i) else int(i), t, u) for i, t, u in frame.itertuples(index=False)], "doc_id long, text string, unit string")
    got = compare(spark, license_scan.scan(docs), license_scan.oracle_sql(), documents=frame)
    assert sum(r[4] for r in got) >= 8
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_licence_scan_on_documents(spark):
    compare(spark, license_scan.scan(spark.read.parquet(f"{SF}/documents.parquet")), license_scan.oracle_sql(), documents=duckdb.sql(f"FROM '{SF}/documents.parquet'").df())


def brute_windows(text):
    """licence: the best score of all lines, paragraphs and the whole text; where none reaches the threshold, of all windows of a template's size."""
    split = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).split()
    pairs = lambda words: [f"{a} {b}" for a, b in zip(words, words[1:])]
    grams, best = pairs(split(text)), {}
    units = [pairs(split(u)) for u in [*text.split("\n"), *re.split("\n[ \t\r]*\n", text), text]]
    for of_units in (True, False):
        found = {}
        for licence, own in license_scan.template_rows():
            for part in units if of_units else [grams[i : i + len(own)] for i in range(len(grams))]:
                score = 2 * len(set(part) & set(own)) / (len(set(part)) + len(own))
                if score >= license_scan.THRESHOLD and licence not in best:
                    found[licence] = max(score, found.get(licence, 0))
        best |= found
    return best


PROSE = {
    "Copyright 2020 Jane Doe. Released under the MIT License.": "MIT",
    "We met in May; it is (released under the ISC-License), they said, and left.": "ISC",
    "old text " * 30 + "Licensed under CC BY-SA 4.0. " + "new text " * 30: "CC-BY-SA-4.0",
    "Ann wrote: " * 30 + license_scan.TEMPLATES["GPL-2.0"][1].replace("modify", "change") + " So be it.": "GPL-2.0",
    "x " * 50 + license_scan.BSD + ". THIS SOFTWARE IS PROVIDED AS IS": "BSD-2-Clause",
    "Note that " * 30 + license_scan.TEMPLATES["EPL-2.0"][1] + " and no more of it": "EPL-2.0",
    "A licence, a license; the GNU General of the public is under the MIT roof.": None,
    "/* " + license_scan.MIT + "\n * " + license_scan.MIT_REST + " */\nint main() {}": "MIT",
    "Released under the MIT License. " * 3: "MIT",
}


def test_copies_of_templates_score_one(spark):
    rows = [(n, t) for n, texts in license_scan.TEMPLATES.items() for t in texts]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    for r in license_scan.scan(docs).collect():
        assert r.best_score == 1 and r.doc_id in r.licences.split(",")


def test_keys_stand_in_whatever_reaches_the_threshold():
    for _, own in license_scan.template_rows():
        keys = license_scan.keys(own, license_scan.THRESHOLD)
        without = [b for b in own if not any(k == b or k in b.split() for k in keys)]
        assert len(without) < license_scan.least_shared(len(own), license_scan.THRESHOLD)


def test_licence_inside_prose(spark):
    docs = spark.createDataFrame(list(enumerate(PROSE)), "doc_id int, text string")
    for r in license_scan.scan(docs).collect():
        text = list(PROSE)[r.doc_id]
        want = brute_windows(text)
        assert r.best_licence == PROSE[text] and (r.n_notices >= 1) == bool(want)
        assert set(r.licences.split(",")) - {""} == set(want)
        assert not want or abs(r.best_score - max(want.values())) < 1e-6


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.NET/x", "http://example.net/en/a?b#c", "https://sub.Example.NET/en", "http://notexample.com/de/", "http://a.example.com/de/x://y",
    "https://x.org/fr/?q", "https://org/fr/z", "http://a.net", "http://www.casino-win.example.org/de/1.html", "http://www.casino-win.example.org/fr/1.html", "https://ADS.example.fr/banner", "https://x.fr/sponsored/1",
    "https://x.fr/a?session_id=1&x=2", "https://x.fr/xxx", "https://responsible-gambling.fr/xxx/", "a" * 20000 + "://net/" + "b/" * 9000, "http://user@host:80/p;x?y#z",
]


def test_url_filters(spark):
    frame = pd.DataFrame({"page_id": pd.array([i if i % 5 else None for i in range(len(URLS))] + [1], "Int64"), "url": [*URLS, URLS[1]], "host": "clash"})
    pages = spark.createDataFrame([(None if pd.isna(i) else int(i), u, h) for i, u, h in frame.itertuples(index=False)], "page_id long, url string, host string")
    got = compare(spark, url_filters.judge(pages), url_filters.oracle_sql(), pages=frame)
    assert {r[4] for r in got} == {"allow", "block"} and sum(r[4] == "block" for r in got) >= 6
    assert url_filters.judge(pages.limit(0)).count() == 0
    compare(spark, url_filters.judge(spark.read.parquet(f"{SF}/pages.parquet")), url_filters.oracle_sql(), pages=duckdb.sql(f"FROM '{SF}/pages.parquet'").df())


@pytest.mark.parametrize(("pattern", "literals"), [("||ads.", ["ads"]), ("/a*b/c", []), ("|http://x.y|", ["http", "x", "y"]), ("ads.x", []), ("^a^b", ["a"])])
def test_literals(pattern, literals):
    assert url_filters.PatternRule("block", pattern).literals == literals


def test_many_rules_are_found_by_hash(spark):
    hosts = tuple(url_filters.HostRule("block", f"h{i}.example", "/") for i in range(300))
    patterns = tuple(url_filters.PatternRule("block", f"/t{i}/") for i in range(300))
    urls = ["http://a.h17.example/x", "http://h299.example/", "http://h300.example/t5/", "http://h300.example/t5", "http://x/t299/t1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted(url_filters.judge(pages, hosts, patterns).collect())
    assert [(r.rule, r.verdict) for r in got] == [("h17.example/", "block"), ("h299.example/", "block"), (None, "block"), (None, "allow"), (None, "block")]
    assert [r.verdict for r in url_filters.judge(pages, (), ()).collect()] == ["allow"] * 5
