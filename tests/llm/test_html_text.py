"""Cuts against all labellings, pages against what they hold, the query against a plain reading of the given pages."""

import html
import itertools
import random
import re

import pytest

from fathomlake.llm import html_text as ht

KIND = "page_id long, url string, html string, text int, n_chars string"


def energy(scores, edges, label):
    return sum(max(0, s) if not on else max(0, -s) for s, on in zip(scores, label)) + sum(c for a, b, c in edges if label[a] != label[b])


def test_cut_has_the_least_energy_of_all_labellings():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randint(1, 9)
        scores = [rng.randint(-6, 6) for _ in range(rng.randint(1, n))]
        edges = [(a, b, rng.randint(1, 5)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.4]
        got = ht.minimum_cut(n, scores, edges)
        best = min(itertools.product((False, True), repeat=n), key=lambda label: (energy(scores, edges, label), sum(label)))
        assert energy(scores, edges, got) == energy(scores, edges, best)
        assert sum(got) == sum(best)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head>
<body class="page no-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav>
<div id="cookie-notice">We use cookies.</div><div class="ad">Buy now!</div>{article}
<aside class="sidebar"><p>Popular: this and that, and more of it.</p></aside><form><label>Name</label><input><button>Go</button></form>
<section id="comments"><article class="comment"><p>I really liked this text, thank you.</p></article></section><footer>&copy; Site</footer></body></html>"""
BODY = "<h1>A &amp; B</h1><p>First <b>line<br>goes   on\n here.</p><p>Short.<ul><li>one<li>two <a href=x>with a link</a></ul><table><tr><td>x<td>y</table><p>&lt;b&gt; caf&eacute; &#8364;"
TEXT = "A & B\nFirst line goes on here.\nShort.\none\ntwo with a link\nx\ny\n<b> café €"


@pytest.mark.parametrize("wrapper", ["article", "main", "div role=main", 'div class="page-wrapper has-menu"><article'])
def test_article_among_all_kinds_of_boilerplate(wrapper):
    closing = wrapper.split()[0] if ">" not in wrapper else "article></div"
    page = PAGE.replace("{article}", f"<{wrapper}>{BODY}</{closing}>")
    assert ht.main_text(page, {}) == TEXT


def test_boilerplate_inside_the_article():
    inner = '<p>Text, one.</p><div class="share-buttons"><p>Share</p></div><div class="advert">Ad</div><aside>Side</aside><p hidden>No</p><p>Text, two.</p><div class="comments-area"><p class="content">Nice.</p></div>'
    assert ht.main_text(f"<article class='post comments-open'>{inner}</article>", {}) == "Text, one.\nText, two."


def test_pages_without_landmarks(spark):
    learned = ht.weights({("words6", 1): 90, ("words6", 0): 5, ("words2", 1): 10, ("words2", 0): 200, ("linked2", 0): 190, ("linked2", 1): 1, ("linked0", 1): 99, ("linked0", 0): 20, ("ended1", 1): 95, ("ended0", 1): 5, ("ended0", 0): 190, ("ended1", 0): 20})
    long = "A sentence of many words, which goes on and on, as sentences in articles do, until it comes to an end after all of it. "
    links = "".join(f"<div><a href=/{i}>Go there</a></div>" for i in range(8))
    page = f"<body><div>{links}</div><div><p>{long}</p><p>Then short.</p><p>{long}</p></div><div>{links}</div></body>"
    assert ht.main_text(page, learned) == f"{long.strip()}\nThen short.\n{long.strip()}"


@pytest.mark.parametrize("page", ["", " ", "<", "<p", "<!--", "<script>", "</p></div>", "<article>", "<a" * 50, "&#0;&#x110000;", "<![CDATA[x", "<title>x"])
def test_odd_pages(page):
    assert isinstance(ht.main_text(page, {}), str)


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "<article>" + "".join(f"<p>Line {i}.</p>" for i in range(3000)) + "</article>"
    assert ht.main_text(deep, {}).count("\n") == 2999
    assert ht.main_text("<article><p>" + "word " * 200_000, {}) == ("word " * 200_000).strip()


def test_rows(spark):
    rows = [(1, "u", PAGE.replace("{article}", f"<article>{BODY}</article>"), 1, "clash"), (None, None, None, 1, "x"), (2, "v", "", 1, "x")]
    rows += [rows[0]]
    got = [tuple(r) for r in ht.extract(spark.createDataFrame(rows, KIND)).collect()]
    assert sorted(got, key=str) == sorted([(1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (None, None, "", 0), (2, "v", "", 0)], key=str)
    empty = ht.extract(spark.createDataFrame([], KIND))
    assert empty.columns == ["page_id", "url", "text", "n_chars"] and empty.count() == 0


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in ht.extract(pages).collect()}
    for page in pages.collect():
        body = re.search("<article>(.*?)</article>", page.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:h1|p)>", body)]
        want = "\n".join(filter(None, parts))
        assert got[page.page_id].text == want and got[page.page_id].n_chars == len(want) and got[page.page_id].url == page.url
    assert len(got) == pages.count()
