"""Main text of web pages: blocks of a page are labelled content or boilerplate by a minimum cut.

A page is cut into blocks of text at its block-level tags. A block's score is what its place says (article, menu,
advert, comment ...) plus log odds of its form (length, links, punctuation, tag), learned from the blocks whose place is
plain. A positive score is the capacity from the source to the block, a negative one the capacity to the sink. Blocks
that follow each other are joined by an edge that weakens with their distance in the DOM, and every block by an edge to
its element, every element by one to its parent. The cut of least capacity leaves the content on the source's side.

Pages are judged one by one inside tasks; only the counts of forms, a table of fixed size, come to the driver.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Forms are counted over about so many pages, taken by a hash of page_id and url.
SAMPLE_PAGES = 2_000
#: Capacities are whole numbers, so many to a unit of score.
UNIT = 100
#: The edge of neighbours counts this much over their distance, and nothing beyond REACH steps in the DOM.
NEAR, REACH = 3 * UNIT, 12
#: The edge of a block or an element to the element around it.
AROUND = UNIT // 2
#: What the place of a block says; the form can't outweigh it.
ARTICLE, OUTSIDE, HINT, SURE, FORM_MOST = 8, -8, -16, -1000, 4

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without any text of the page.
SILENT = frozenset("script style template noscript svg math iframe object canvas audio video select textarea button datalist title".split())
BLOCK = frozenset(
    "html head body article main section nav aside header footer form div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot"
    " tr td th blockquote pre figure figcaption address details summary fieldset legend center dialog menu search hgroup".split()
)
#: An element that ends when one of these opens in the same list or table, and where the search for it stops.
ENDS_BEFORE = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table", "thead", "tbody", "tfoot")),
    "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
}
SURE_TAGS = frozenset("nav aside footer header form menu dialog search head".split())
SURE_ROLES = frozenset("navigation complementary contentinfo banner search dialog alertdialog alert menu menubar toolbar form".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsors sponsored promo promos promotion menu menus nav navbar navigation"
    " sidebar sidebars footer masthead topbar breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice notices disclaimer popup"
    " modal overlay banner newsletter subscribe subscription signup login share sharing social related recommended recommendations outbrain taboola"
    " toc skip widget widgets toolbar".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
#: Last words of class names that tell of a state and not of a part.
STATES = frozenset("open closed enabled disabled off on count active visible hidden no has with without".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_ENDED = re.compile(r"""[.!?…。！？]["'”’»)\]]*$""")


class Block(NamedTuple):
    text: str
    tag: str
    linked: int
    element: int
    place: str


@lru_cache(4096)
def hint(name: str) -> str:
    """What a class or id says: 'comment', 'aside' (any other part beside the article) or nothing. The first and last word count."""
    words = [w.lower() for w in _NAME.findall(name)]
    if not words or words[-1] in STATES or words[0] in STATES:
        return ""
    ends = {words[0], words[-1]}
    return "comment" if ends & COMMENTS else "aside" if ends & HINTS else ""


class Page(HTMLParser):
    """Reads a page into blocks and a tree of block-level elements, given as lists of parents and depths.

    place of an element: '' (nothing known), 'article', 'hint' (beside the article by class or id), 'comment', 'sure'
    (beside it by tag or role). An article or main element inside hinted wrappers is an article again.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.parent, self.depth, self.tags, self.places = [-1], [0], ["body"], [""]
        self.open, self.count = [0], {}
        self.pieces: list[str] = []
        self.linked, self.link, self.silent, self.nested = 0, False, "", 0
        self.has_article = False

    def flush(self) -> None:
        if self.pieces:
            if text := " ".join("".join(self.pieces).split()):
                at = self.open[-1]
                self.blocks.append(Block(text, self.tags[at], self.linked, at, self.places[at]))
                self.has_article = self.has_article or self.places[at] == "article"
            self.pieces, self.linked = [], 0

    def place(self, tag: str, attrs: dict[str, str]) -> str:
        around = self.places[self.open[-1]]
        role = attrs.get("role", "").lower()
        names = () if tag in ("html", "body") else (*attrs.get("class", "").split(), attrs.get("id", ""))
        said = {hint(n) for n in names}
        if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attrs.get("style", "")):
            return "sure"
        if "comment" in said or around == "comment":
            return "comment"
        if tag in ("article", "main") or role in ("article", "main"):
            wrapped = around in ("", "article", "hint") or around == "sure" and self.tags[self.open[-1]] == "form"
            return around if not wrapped else "hint" if "aside" in said else "article"
        if tag in SURE_TAGS or role in SURE_ROLES:
            return "sure"
        if around in ("sure", "hint"):
            return around
        return "hint" if "aside" in said else around

    def close_to(self, at: int) -> None:
        for node in self.open[at:]:
            self.count[self.tags[node]] -= 1
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent:
            self.nested += tag == self.silent
        elif tag in SILENT:
            self.silent, self.nested = tag, 1
            self.pieces.append(" ")
        elif tag == "br":
            self.pieces.append(" ")
        elif tag == "hr":
            self.flush()
        elif tag == "a":
            self.link = True
        elif tag in BLOCK:
            self.flush()
            self.link = False
            if self.tags[self.open[-1]] == "p" and len(self.open) > 1:
                self.close_to(len(self.open) - 1)
            ended, scope = ENDS_BEFORE.get(tag, ((), ()))
            if any(self.count.get(t) for t in ended):
                for i in range(len(self.open) - 1, 0, -1):
                    if self.tags[self.open[i]] in scope:
                        break
                    if self.tags[self.open[i]] in ended:
                        self.close_to(i)
                        break
            place = self.place(tag, {k: v or "" for k, v in attrs})
            self.parent.append(self.open[-1])
            self.depth.append(len(self.open))
            self.tags.append(tag)
            self.places.append(place)
            self.open.append(len(self.parent) - 1)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID or tag not in SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            self.nested -= tag == self.silent
            if not self.nested:
                self.silent = ""
        elif tag == "a":
            self.link = False
        elif tag in BLOCK:
            self.flush()
            self.link = False
            if self.count.get(tag):
                for i in range(len(self.open) - 1, 0, -1):
                    if self.tags[self.open[i]] == tag:
                        self.close_to(i)
                        break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.pieces.append(data)
            if self.link:
                self.linked += len(data.strip())


def read(html: str) -> Page:
    page = Page()
    page.feed(html)
    page.close()
    page.flush()
    return page


def form(b: Block) -> tuple[str, ...]:
    """What a block looks like, as one value for each of five features."""
    words = b.text.count(" ") + 1
    share = 3 * b.linked // max(1, len(b.text))
    tag = "h" if b.tag[0] == "h" and b.tag[1:].isdigit() else b.tag if b.tag in ("p", "li", "td", "div") else "other"
    marks = b.text.count(",") + b.text.count(". ")
    return f"words{min(7, words.bit_length())}", f"linked{min(2, share)}", f"ended{int(bool(_ENDED.search(b.text)))}", f"marks{min(3, marks)}", f"tag-{tag}"


def plain_label(page: Page, b: Block) -> int | None:
    """1 and 0 where the place of a block leaves no doubt, else nothing; training uses these."""
    return {"article": 1, "": None}.get(b.place, 0)


def weights(counts: dict[tuple[str, int], int]) -> dict[str, float]:
    """Log odds of each form for content against boilerplate, from counts by (form, label), smoothed."""
    totals = {y: 10 + sum(n for (f, k), n in counts.items() if k == y and f.startswith("ended")) for y in (0, 1)}
    return {f: math.log((counts.get((f, 1), 0) + 5) / totals[1]) - math.log((counts.get((f, 0), 0) + 5) / totals[0]) for f in {f for f, _ in counts}}


def score(page: Page, b: Block, learned: dict[str, float]) -> int:
    """A block's score in capacities: its place, and its form within FORM_MOST."""
    place = {"article": ARTICLE, "hint": HINT, "comment": HINT, "sure": SURE}.get(b.place, OUTSIDE if page.has_article else 1)
    looks = sum(learned.get(f, 0.0) for f in form(b))
    return round(UNIT * (place + max(-FORM_MOST, min(FORM_MOST, looks))))


def distance(page: Page, a: int, b: int) -> int:
    """Steps from one element to another through the tree, or more than REACH."""
    steps = 0
    while a != b and steps <= REACH:
        if page.depth[a] >= page.depth[b]:
            a = page.parent[a]
        else:
            b = page.parent[b]
        steps += 1
    return steps


def network(page: Page, learned: dict[str, float]) -> tuple[int, list[int], list[tuple[int, int, int]]]:
    """(vertices, scores of the blocks, undirected edges): blocks come first, then the elements that hold any."""
    scores = [score(page, b, learned) for b in page.blocks]
    vertex: dict[int, int] = {}
    edges = []
    for i, b in enumerate(page.blocks):
        below, at = i, b.element
        while at >= 0:
            known = at in vertex
            edges.append((below, vertex.setdefault(at, len(page.blocks) + len(vertex)), AROUND))
            if known:
                break
            below, at = vertex[at], page.parent[at]
    for i in range(len(page.blocks) - 1):
        steps = 1 + distance(page, page.blocks[i].element, page.blocks[i + 1].element)
        if steps <= REACH:
            edges.append((i, i + 1, NEAR // (1 + steps)))
    return len(page.blocks) + len(vertex), scores, edges


def minimum_cut(n: int, scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which of n vertices stay on the source's side of the least cut (the smallest such side), by Dinic's maximum flow.

    A positive score is a capacity from the source to its vertex, a negative one to the sink; edges hold both ways.
    """
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forth: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, s in enumerate(scores):
        if s > 0:
            edge(source, i, s, 0)
        elif s < 0:
            edge(i, sink, -s, 0)
    for a, b, c in edges:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                least = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                first = next(k for k, e in enumerate(path) if not room[e])
                at = to[path[first] ^ 1]
                del path[first:]
            while tried[at] < len(out[at]):
                e = out[at][tried[at]]
                if room[e] and level[to[e]] == level[at] + 1:
                    break
                tried[at] += 1
            else:
                if at == source:
                    break
                at = to[path.pop() ^ 1]
                tried[at] += 1
                continue
            path.append(e)
            at = to[e]


def main_text(html: str, learned: dict[str, float]) -> str:
    page = read(html)
    if not page.blocks:
        return ""
    content = minimum_cut(*network(page, learned))
    return "\n".join(b.text for b, kept in zip(page.blocks, content) if kept)


def learn(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Log odds of forms, counted over the blocks of about sample_pages pages whose place is plain; at most 46 rows are collected."""
    share = max(1, pages.count() // sample_pages)
    some = pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(share)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], int] = {}
        for batch in batches:
            for html in batch.column(0):
                page = read(html.as_py() or "")
                for b in page.blocks:
                    if (y := plain_label(page, b)) is not None:
                        for f in form(b):
                            found[f, y] = found.get((f, y), 0) + 1
        yield pa.RecordBatch.from_pylist([{"form": f, "label": y, "n": n} for (f, y), n in found.items()], schema=pa.schema([("form", pa.string()), ("label", pa.int32()), ("n", pa.int64())]))

    rows = some.select("html").mapInArrow(count, "form string, label int, n long").groupBy("form", "label").agg(F.sum("n").alias("n")).collect()
    return weights({(r.form, r.label): r.n for r in rows})


def extract(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html, any more columns are left out).

    text: blocks of content in page order, joined by one newline; character references decoded, white space inside a
    block as one space, and a line break (br) is such a space. A null or empty html, and a page without content, give an
    empty text. Null ids and urls stay null; repeated rows are each judged, alike. Pages of any length are read whole.
    """
    learned = learn(pages, sample_pages)
    ids = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py() or "", learned) for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return ids.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
