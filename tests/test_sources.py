"""Parsers on small bodies of our own."""

from fathomlake.operators import cards, usage
from fathomlake.sources import feeds


def one(spark, body):
    return spark.createDataFrame([(1, body, "he"), (2, None, "x"), (3, "no such thing", "x")], "k int, body string, prefix string")


def test_sse(spark):
    body = "event: node\r\ndata: {\"a\": 1}\r\n\r\ndata: x\ndata: y\n\nevent: cut"
    got = [(r.seq, r.event, r.data) for r in feeds.sse_frames(one(spark, body), "k", "body").where("k = 1").orderBy("seq").collect()]
    assert got == [(0, "node", '{"a": 1}'), (1, "message", "x\ny")] == usage.sse_rows([body])


def test_suggestions(spark):
    got = feeds.suggestions(one(spark, '["he", ["hello", "HE", "hello", " help  me "]]'), "k", "body", "prefix").collect()
    assert [(r.position, r.suggestion) for r in got] == [(0, "hello"), (1, "help me")]


def test_wiki(spark):
    got = feeds.wiki_hits(one(spark, '{"query": {"search": [{"title": "A", "pageid": 7, "snippet": "an <b>x</b> &amp; y"}, {"pageid": 1}]}}'), "k", "body").collect()
    assert [(r.title, r.page_id, r.snippet) for r in got] == [("A", 7, "an x & y")]


def test_rss_and_atom(spark):
    rss = "<rss><channel><title>no</title><item><title><![CDATA[One two]]></title></item><item><title>Three &amp; four</title></item></channel></rss>"
    assert [r.title for r in feeds.rss_titles(one(spark, rss), "k", "body").collect()] == ["One two", "Three & four"]
    atom = "<feed><entry><id>http://arxiv.org/abs/2101.00001v2</id><title>A\n paper</title><published>2021-01-03T</published><author><name>B C</name></author><author><name> D </name></author></entry></feed>"
    (r,) = feeds.arxiv_works(one(spark, atom), "k", "body").collect()
    assert (r.arxiv_id, r.title, r.year, r.authors) == ("2101.00001", "A paper", 2021, "B C; D")


def test_links_and_abstracts(spark):
    html = '<a href="/in">in</a><a class=r href="https://a.b/?x=1&amp;y=2">An <i>A</i></a><a href="//d/l/?uddg=https%3A%2F%2Fc.d%2F&amp;r=1">C</a><a href="https://c.d/">again</a>'
    assert [(r.position, r.title, r.url) for r in feeds.result_links(one(spark, html), "k", "body").orderBy("position").collect()] == [(1, "An A", "https://a.b/?x=1&y=2"), (2, "C", "https://c.d/")]
    works = spark.createDataFrame([(1, {"we": [0, 3], "show": [1], "that": [2]})], "k int, idx map<string, array<int>>")
    assert [r.abstract for r in feeds.abstracts(works, "k", "idx").collect()] == ["we show that we"]


def test_flatten_nodes(spark):
    body = '[{"type": "hero", "text": "x"}, {"type": "section", "children": [{"type": "text"}, {"type": "tabs", "tabs": [{"children": [{"type": "list"}]}]}]}]'
    got = cards.flatten_nodes(one(spark, body), "k", "body").orderBy("path").collect()
    assert [(r.path, r.depth, r.type) for r in got] == [("0", 1, "hero"), ("1", 1, "section"), ("1.0", 2, "text"), ("1.1", 2, "tabs"), ("1.1.t0.0", 4, "list")]


def test_registered_functions(spark):
    from fathomlake.functions import registry

    assert set(registry.register(spark)) >= {"answer_key", "figures", "host_of"}
    row = spark.sql("SELECT host_of('https://www.A.org/x') AS h, salted_hash('a', 'b') AS s, round_cents(1.005D + 0.001D) AS c, chars_to_tokens(9) AS t, answer_key(' What? ') AS k, collapsed(' a  b ') AS b").first()
    assert (row.h, row.c, row.t, row.k, row.b) == ("a.org", 1.01, 3, "what", "a b") and len(row.s) == 64
    got = spark.sql("SELECT f.unit, f.amount FROM VALUES ('$5 and 3 km'), (CAST(NULL AS STRING)) AS t(x), LATERAL figures(t.x) AS f").collect()
    assert sorted(tuple(r) for r in got) == [("km", 3.0), ("money", 5.0)]
