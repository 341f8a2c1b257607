"""Scalar functions and small operators on literals, against plain Python."""

import datetime

from pyspark.sql import functions as F

from fathomlake.functions import money, text
from fathomlake.operators import entities, figures, grounding, joins, passages, ranking, usage


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expr(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def test_urls(spark):
    urls = ["https://www.Example.co.uk/a/?utm_source=x&q=1#f", "http://user@h.example.org:80/p//", "nonsense", None, "HTTP://a.b"]
    assert column(spark, urls, text.host_of) == ["example.co.uk", "h.example.org", "", "", "a.b"]
    assert column(spark, urls, lambda u: text.site_of(text.host_of(u))) == ["example.co.uk", "example.org", "", "", "a.b"]
    assert column(spark, urls, text.url_key) == ["example.co.uk/a?q=1", "h.example.org/p", "nonsense", None, "a.b"]


def test_html(spark):
    html = "<head><title>A\n b</title><style>x{}</style><SCRIPT>1<2</SCRIPT></head><!-- no --><p>One &amp; two&nbsp;<b>three</b>"
    assert column(spark, [html, "", None], text.strip_html) == ["A b One & two three", "", None]
    assert column(spark, [html], text.html_title) == ["A b"]


def test_cutting(spark):
    assert column(spark, ["one  two three", "short", "unbroken-word-here", ""], lambda v: text.cut_on_word(v, 8)) == ["one two", "short", "unbroken", ""]
    assert column(spark, ["abcdefgh", "abc"], lambda v: text.clip(v, 5)) == ["abcd…", "abc"]
    assert column(spark, ["One. Two? [3] Three! 4.5 km"], text.sentences) == [["One.", "Two? [3]", "Three!", "4.5 km"]]
    assert column(spark, ["“A’s”"], text.plain_quotes) == ["\"A's\""]


def test_keys(spark):
    assert column(spark, ["  “Ｗhat is  it?” ", None, "a.b!."], text.answer_key) == ["what is it", None, "a.b"]
    want = []
    for word in ("", "a", "foobar"):
        h = 2166136261
        for c in word.encode():
            h = (h ^ c) * 16777619 % 2**32
        want.append(f"{h:08x}")
    assert column(spark, ["", "a", "foobar"], text.fnv1a) == want


def test_one_edit(spark):
    pairs = [("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("abc", "abd"), ("abcd", "badc"), ("ab", "ba"), ("abc", "cba"), ("", "a")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r.x for r in df.select(text.within_one_edit(F.col("a"), F.col("b")).alias("x")).collect()] == [False, True, True, True, False, True, False, True]


def test_numbers(spark):
    assert column(spark, ["1,200.00 and 3.50 or 7", "none"], text.number_tokens) == [["1200", "3.50", "7"], []]
    assert column(spark, ["in 1999, 2025-26 and 12025"], text.years_in) == [[1999, 2025]]
    df = spark.createDataFrame([(-2.5,), (2.345,), (2.5,)], "x double")
    assert [r.x for r in df.select(money.round_half_up(F.col("x"), 0).alias("x")).collect()] == [-2.0, 2.0, 3.0]
    days = spark.createDataFrame([(datetime.date(2000, 2, 29), datetime.date(2001, 2, 28)), (datetime.date(2000, 2, 29), datetime.date(2001, 3, 1))], "a date, b date")
    assert [r.x for r in days.select(money.completed_years(F.col("a"), F.col("b")).alias("x")).collect()] == [0, 1]


def test_figures():
    found = figures.figures_of("At 19:05 it cost $1.5 million, up 12% over 3 days and 1,200 km; $20k more.")
    assert [(u, a) for _, u, a, *_ in found] == [("clock", 1145.0), ("money", 1.5e6), ("percent", 12.0), ("day", 3.0), ("km", 1200.0), ("money", 2e4)]
    assert figures.figures_of("") == []
    found = figures.figures_of("The rate is 8.875 percent. It weighs 120 lbs, runs 5 m and 3-mile loops; v1.5 at 7:30 pm. Population: 3.2 billion (x12).")
    assert [(u, a, label) for _, u, a, _, label in found] == [("percent", 8.875, "rate"), ("lb", 120.0, None), ("m", 5.0, None), ("mi", 3.0, None), ("clock", 1170.0, None), ("number", 3.2e9, "population")]


def test_first_distinct_looks_at_what_is_kept(spark):
    rows = [("t", "x", 1.00049, 1, "a"), ("t", "x", 1.00051, 2, "b"), ("t", "x", 1.00149, 3, "c"), ("t", "x", 1.0016, 4, "d"), ("t", "y", 1.0, 5, "e"), ("u", "x", 1.0, 6, "f")]
    got = figures.first_distinct(spark.createDataFrame(rows, "k string, unit string, amount double, pos int, name string"), "k", "unit", "amount", "pos").collect()
    assert sorted(r.name for r in got) == ["a", "d", "e", "f"]


def test_quotations_of_few_words(spark):
    quotes = spark.createDataFrame([(1, "to be"), (2, "Not  to be, found!"), (3, "one two three four five six"), (4, "?!"), (5, "be to")], "q int, quote string")
    texts = spark.createDataFrame([(1, "To be or not to be: found."), (2, "zero one two three four five six seven"), (3, ""), (4, None)], "t int, text string")
    got = sorted(tuple(r) for r in grounding.verbatim(quotes, texts, "q", "quote", "t", "text").collect())
    assert got == [(1, 1), (2, 1), (3, 2)]
    assert grounding.verbatim(quotes.limit(0), texts, "q", "quote", "t", "text").count() == 0


def test_lines_score_by_stems_figures_and_edges(spark):
    lines = ["Nothing asked costs $5", "A fee of $5 for cancelled bookings", "You must cancel bookings", "cancel", None]
    stems = lambda: passages.question_stems(F.lit("What does cancelling a booking cost?"))
    assert spark.range(1).select(stems().alias("s")).first().s == ["cancel", "book", "cost"]
    assert column(spark, lines, lambda v: passages.line_score(v, stems())) == [1 + 1.5 + 1, 2 + 1.5 + 1, 2 + 1, 1.0, 0.0]
    assert column(spark, ["$5 at least"], lambda v: passages.line_score(v, stems())) == [0.0]


def test_entities_and_main_part(spark):
    texts = ["caf&eacute; &#8217;s &#x27;x&#X27; &mdash; &unknown; a&b &amp;lt; &#x1F600;&#0;", "plain", None, "&amp", "AT&amp;T&nbsp;1"]
    assert column(spark, texts, text.decode_entities) == ["café ’s 'x' — &unknown; a&b &lt; 😀\ufffd", "plain", None, "&amp", "AT&T 1"]
    page = "<body><nav>menu</nav><header>top</header><main><p>It&#39;s <b>here</b></p><footer>foot</footer></main><div>more</div></body>"
    assert column(spark, [page, "<article>a<script>x</article></script>b</article>c", "just <i>text</i>"], text.page_text) == ["It's here", "a b", "just text"]


def test_fnv_reads_utf16_units(spark):
    want = []
    for word in ("\U0001F600", "é", "a\U0001F600b"):
        h = 2166136261
        raw = word.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h ^ int.from_bytes(raw[i : i + 2], "big")) * 16777619 % 2**32
        want.append(f"{h:08x}")
    assert want[0] == "cb31c4b8"
    assert column(spark, ["\U0001F600", "é", "a\U0001F600b"], text.fnv1a) == want


def test_windows_go_on_past_midnight(spark):
    start = datetime.datetime(2024, 1, 1, 23, 59, 50)
    df = spark.createDataFrame([(i, start + datetime.timedelta(seconds=s), "k") for i, s in enumerate((0, 5, 12, 18, 59, 60))], "event_id long, ts timestamp, key string")
    got = {r.event_id: r.admitted for r in usage.fixed_window(df, "key", "ts", "event_id", 2, 60).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 5: True}
    assert {r.event_id for r in usage.greedy_spacing(df, "key", "ts", "event_id", 60).collect()} == {0, 5}


def test_clusters_of_long_chains(spark):
    rows = [(1, i, f"s{i}") for i in range(100)] + [(1, i + 1, f"s{i}") for i in range(100)] + [(2, 5, None), (1, 500, "alone")]
    got = {(r.scope, r.row): r.cluster for r in entities.clusters(spark.createDataFrame(rows, "scope int, row int, signal string"), "scope", "row", "signal").collect()}
    assert got == {(1, i): 0 for i in range(101)} | {(2, 5): 5, (1, 500): 500}


def test_completions_of_short_and_long_prefixes(spark):
    names = spark.createDataFrame([(1, "green tea"), (2, "evergreen"), (3, "tea green"), (4, "gr"), (5, "")], "id int, name string")
    prefixes = spark.createDataFrame([("g",), ("green",), ("green t",), ("zz",), ("",)], "prefix string")
    got = [(r.prefix, r.name, r.tier) for r in ranking.prefix_tiers(names, prefixes, "name", "id", 3).collect()]
    assert sorted(got) == sorted([("g", "green tea", 0), ("g", "gr", 0), ("g", "tea green", 1), ("green", "green tea", 0), ("green", "tea green", 1), ("green", "evergreen", 2), ("green t", "green tea", 0)])


def test_completions_beyond_few_prefixes(spark, monkeypatch):
    """A few prefixes are compared with every name, without a join of runs; more give the same."""
    names = spark.createDataFrame([(i, f"green tea {i} grand") for i in range(40)], "id int, name string")
    prefixes = spark.createDataFrame([("g",), ("green t",), ("gra",), ("1",), ("zz",)], "prefix string")
    few = ranking.prefix_tiers(names, prefixes, "name", "id", 3)
    assert "Generate" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ranking, "FEW_PREFIXES", 0)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, ranking.prefix_tiers(names, prefixes, "name", "id", 3).collect()))


def test_languages(spark):
    cjk, romance = (column(spark, ["漢字 ab", "les gens que nous avons dans la ville pour une fois avec eux", "the cat and the dog"], lambda v, k=k: passages.language_flags(v)[k]) for k in (0, 1))
    assert cjk == [0.5, 0.0, 0.0] and romance == [False, True, False]


def test_retry_window_does_not_slide(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=s), "k") for i, s in enumerate((0, 10, 20, 30, 40, 95, 101))]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, key string")
    got = {r.event_id: r.free_retry for r in usage.free_retries(df, "key", "ts", "event_id", 60, 3).collect()}
    assert [got[i] for i in range(7)] == [False, True, True, True, False, True, False]
    spend = df.withColumn("cost", F.lit(4.0))
    assert [r.admitted for r in usage.admitted_spend(spend, "key", "ts", "event_id", "cost", 9.0).orderBy("event_id").collect()] == [True, True] + [False] * 5


def test_asof_bounds(spark):
    t = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    left = spark.createDataFrame([(1, "u", t(100)), (2, "u", t(161)), (3, "v", t(100)), (4, "u", t(40))], "id int, k string, ts timestamp")
    right = spark.createDataFrame([("u", t(40), 7), ("u", t(100), 8), ("u", t(100), 9), ("w", t(100), 1)], "k string, at timestamp, rid int")
    got = {r.id: r.rid for r in joins.latest_within(left, right, ["k"], "ts", "at", "rid", 60).collect()}
    assert got == {1: 9, 2: None, 3: None, 4: 7}


def test_clusters_follow_chains(spark):
    rows = [(1, i, f"s{i // 2}") for i in range(12)] + [(1, i, f"t{(i + 1) // 2}") for i in range(8)] + [(2, 5, None)]
    got = {(r.scope, r.row): r.cluster for r in entities.clusters(spark.createDataFrame(rows, "scope int, row int, signal string"), "scope", "row", "signal").collect()}
    assert got == {(1, i): 0 if i < 8 else i // 2 * 2 for i in range(12)} | {(2, 5): 5}


def test_merged_records(spark):
    rows = [(1, 1, "d1", None, None, 3), (1, 2, None, "p1", "t", 5), (1, 3, "d1", "p1", "u", 9), (1, 4, None, "p1", "v", 1), (2, 1, "d1", None, "w", None), (2, 2, None, None, "x", 2), (2, 3, None, None, None, 2)]
    df = spark.createDataFrame(rows, "scope int, position int, doi string, pre string, title string, cites int")
    got = sorted(tuple(r) for r in entities.merged_records(df, "scope", "position", ("doi", "pre"), ["title"], "cites").collect())
    assert got == [(1, 1, "d1", "p1", "u", 9), (1, 2, None, "p1", "t", 5), (2, 1, "d1", None, "w", None), (2, 2, None, None, "x", 2), (2, 3, None, None, None, 2)]


def test_merged_records_of_many_scopes_without_a_group_each(spark):
    rows = spark.range(3000).selectExpr("id div 3 AS scope", "3 - id % 3 AS position", "IF(id % 3 = 1, NULL, 'd') AS doi", "IF(id % 3 < 2, 'p', NULL) AS pre", "CAST(NULL AS string) AS title", "CAST(id AS double) AS cites")
    merged = entities.merged_records(rows, "scope", "position", ("doi", "pre"), ["title"], "cites")
    assert "MapInArrow" in merged._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in merged.collect())
    assert got == sorted(r for i in range(1000) for r in ((i, 1, "d", "p", None, 3.0 * i + 2), (i, 2, None, "p", None, 3.0 * i + 1)))


def test_markdown_and_dates(spark):
    md = "# A title that is long enough to be kept in the text\n![x](y) nav\n- [See this](http://a) costs 5\n**Done.**"
    assert column(spark, [md], text.clean_markdown) == ["A title that is long enough to be kept in the text\nSee this costs 5\nDone."]
    day = lambda v: money.parsed_date(v, F.lit("2024-03-31").cast("date"))
    assert column(spark, ["1 month ago", "2 Days ago", "Oct 7, 2026", "2024-02-03T10:00Z", "5 hours ago", "soon", None], day) == [datetime.date(2024, 2, 29), datetime.date(2024, 3, 29), datetime.date(2026, 10, 7), datetime.date(2024, 2, 3), datetime.date(2024, 3, 31), None, None]


def test_a_denial_ends_at_a_letter_beyond_ascii(spark, tmp_path):
    from fathomlake.plans import more

    rows = [(1, 0, "user", "ar. Noñasc"), (2, 0, "user", "nothing"), (3, 0, "user", "he said no")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r.conv_id: r.denial for r in more.verdict_flags(spark, str(tmp_path)).collect()} == {1: True, 2: False, 3: True}
