"""Prices, pictures, months and answering sentences: literals, and whole tables beside plain Python."""

import re

from pyspark.sql import functions as F

from fathomlake.functions import months, pictures, prices, text
from fathomlake.operators import pictures as best
from fathomlake.operators import prices as plans_prices
from fathomlake.operators import sourced
from fathomlake.plans import picks

SF = "/root/testdata/sf0.001"


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expr(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def check(spark, rule, cases):
    assert dict(zip(cases, column(spark, list(cases), rule))) == cases


def test_replaced_equals_python(spark):
    values = ["1a22b333", "a", "", "12", "1 2", None, "x9"]
    got = column(spark, values, lambda t: text.replaced(t, "[0-9]+", lambda x, before, after: F.concat(F.lit("<"), before, x, after, F.lit(">"))))
    between = lambda v: re.split("[0-9]+", v)
    want = [v if v is None else between(v)[0] + "".join(f"<{between(v)[i]}{x}{between(v)[i + 1]}>{between(v)[i + 1]}" for i, x in enumerate(re.findall("[0-9]+", v))) for v in values]
    assert got == want


def test_prices_in_prose(spark):
    keep = F.array(F.lit(9.5), F.lit(5000.0))
    check(spark, lambda t: prices.without_stray_prices(t, keep), {"costs $1,299.99 now, under $50.": "costs now, under $50.", "$9.50 stays ($20)": "$9.50 stays", "US$5k and x$5 left": "US$5k and x$5 left", "$3": "", "": "", None: None})
    check(spark, lambda t: prices.without_stray_prices(t, F.lit(None).cast("array<double>")), {"$9.50, so": ", so", "no": "no"})
    check(spark, lambda t: prices.within_budget(t, F.lit(150.0)), {"under $200, good": "good", "from $99, up to $120": "from $99, up to $120", "A · $400": "A", None: None})
    check(spark, lambda t: prices.chip_within(t, F.lit(150.0)), {"$300": None, "$99": "$99", "Under $200": None, "4 stars": "4 stars", "": "", None: None})
    check(spark, lambda t: prices.states_price(t, F.array(F.lit(150.0))), {"under $150": False, "$99 under $150": True, "no": False, None: False})


def test_price_rows(spark):
    rows = spark.createDataFrame([(1, "annual", 2, 5.0, "u", "b"), (1, "annual", 1, 4.0, None, "a"), (1, "monthly", 3, None, "u", "c"), (1, "monthly", 2, 7.0, "", "d"), (None, "annual", 1, None, None, "e")], "plan int, billing string, position int, amount double, source string, best_ string")
    got = {(r.plan, r.billing): r["best_"] for r in plans_prices.price_for_basis(rows, "plan", "billing", "position", "amount", "source").collect()}
    assert got == {(1, "annual"): "b", (1, "monthly"): "d", (None, "annual"): "e"}
    assert plans_prices.price_for_basis(rows.limit(0), "plan", "billing", "position", "amount", "source").count() == 0


def test_price_for_basis_of_tied_rows(spark):
    tied = [(1, "year", 5, 20.0, "b"), (1, "year", 5, 10.0, "c"), (1, "year", 5, 10.0, "a"), (1, "year", 4, None, "a")]
    for rows in (tied, tied[::-1], tied[1:] + tied[:1]):
        df = spark.createDataFrame(rows, "plan int, billing string, position int, amount double, source string").coalesce(1)
        (got,) = plans_prices.price_for_basis(df, "plan", "billing", "position", "amount", "source").collect()
        assert (got["amount"], got["source"]) == (10.0, "a")
    asked = spark.createDataFrame([(1, 1299.5, "monthly", "https://a.org/x"), (1, 20.0, "monthly", "https://a.org/y"), (1, None, "monthly", "https://a.org/x"), (2, 1299.5, "monthly", "https://a.org/x"), (1, 5.0, "monthly", None)], "scope int, amount double, billing string, source string")
    pages = spark.createDataFrame([(1, 2, "http://www.a.org/x/?q=1", "$9 billed monthly"), (1, 1, "https://a.org/x", "$1,299.5 billed annually"), (1, 1, "https://a.org/y", "$20 or so"), (1, 1, None, "$5 a year")], "scope int, position int, url string, text string")
    found = plans_prices.billing_from_sources(asked, pages, "scope", "position", "amount", "billing", "source", "url", "text").collect()
    assert sorted((r.scope, r.amount or 0, r.billing) for r in found) == [(1, 0, "monthly"), (1, 5.0, "monthly"), (1, 20.0, "monthly"), (1, 1299.5, "annual"), (2, 1299.5, "monthly")]


def test_months(spark):
    known = F.lit(1 << 9)
    check(spark, lambda t: months.without_unsourced_months(t, known), {
        "the revised US price from May, up from $449.99": "the revised US price, up from $449.99", "Oct 16 and Sept 3": "Oct 16 and", "You May go": "You May go", "in March 2024 it rose (June)": "in 2024 it rose", "Before May revision": "Before revision", "": "", None: None, "On October 5": "On October 5",
    })
    check(spark, months.month_bits, {"May 3 and Dec 5": 16 + 2048, "": 0, None: 0})
    slots = spark.createDataFrame([(1, 1, "in March 5", [1]), (1, 2, "in March 5", [2, 7]), (1, 3, "in March 5", [7]), (1, 4, "in June 2020", None), (2, 1, "in March 5 it", [1]), (3, 1, None, [])], "card int, slot int, text string, cites array<int>")
    sources = spark.createDataFrame([(1, 1, "March came"), (1, 2, "none"), (1, 2, "none")], "card int, source int, said string")
    got = sourced.with_sourced_months(slots, sources, "card", "slot", "text", "cites", "source", "said", F.lit("in June?"), F.lit("2024-10-01").cast("date"))
    assert sorted((r.card, r.slot, r.text) for r in got.collect()) == [(1, 1, "in March 5"), (1, 2, ""), (1, 3, "in March 5"), (1, 4, "in June 2020"), (2, 1, "it"), (3, 1, None)]


def test_pictures_of_items(spark):
    check(spark, lambda t: pictures.matches(F.lit("Sony WF-1000XM5"), t), {"Sony WF1000XM5 earbuds": True, "Sony XM5": False, "sony wf-1000xm5": True})
    check(spark, lambda t: pictures.matches(F.lit("red brick wall"), t), {"a red brick": True, "a brick": False, "": False})
    fits = lambda t: pictures.fits(F.lit("Kobo Clara BW eReader"), t, F.lit(None).cast("string"), F.lit("https://x.org/a/kobo-clara-bw.jpg?x=1"), F.array(F.lit("Kindle Paperwhite"), F.lit("Kobo Clara BW")))
    check(spark, fits, {"Kobo Clara BW eReader vs Kindle Paperwhite": True, "Kobo Clara": False, "Kobo Clara BW": True, None: False})
    items = spark.createDataFrame([(1, 1, "Kobo Clara"), (1, 2, "Kobo Libra"), (1, 3, "Kobo Clara"), (2, 1, "lamp shade"), (None, 1, "Kobo Clara"), (3, 1, "")], "g int, i int, name string")
    pool = spark.createDataFrame([(1, 1, "Kobo Clara new", None, "u1"), (1, 2, "Kobo Clara", None, "u2"), (1, 3, "Kobo Libra", None, "u2"), (1, 4, "Kobo Libra x", None, "u4"), (1, 5, "Kobo Libra", None, ""), (2, 1, "a lamp shade", None, "u5")], "g int, p int, t string, a string, u string")
    got = best.best_pictures(items, pool, "g", "i", "name", "p", "t", "a", "u").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2, "u2"), (1, 2, 4, "u4"), (1, 3, 1, "u1"), (2, 1, 1, "u5")]


def test_item_pictures_equal_a_plain_walk(spark):
    items, pool = picks.shelves(spark, SF)
    items, pool = items.collect(), pool.collect()
    words = lambda x: [w for w in re.split("[^a-z0-9]+", (x or "").lower()) if len(w) > 1]

    def has(low, w):
        return bool(re.search(rf"(^|[^a-z0-9]){w}([^a-z0-9]|$)", low)) if len(w) <= 3 else w in low

    def names(item, title):
        return all(has((title or "").lower(), w.lower()) for w in item.split())

    want = set()
    for card in sorted({i.card for i in items}):
        used, own = set(), sorted((i.item, i.name) for i in items if i.card == card)
        for k, name in own:
            rivals = {n for _, n in own if n != name and not names(n, name) and not names(name, n)}
            of_it = []
            for p in pool:
                if p.card != card or p.url in used or not names(name, p.title):
                    continue
                file = re.sub("[-_.]+", " ", re.search("([^/?]*)[?]", p.url)[1])
                mixed = " vs " in p.title or any(names(r, p.title) for r in rivals)
                if mixed and (not names(name, file) or any(names(r, file) for r in rivals)):
                    continue
                known = [w for w in words(name)]
                of_it.append((-sum(w in p.title.lower() for w in known) / len(known), sum(w not in known for w in words(p.title)), p.picture, p.url))
            if of_it:
                used.add(min(of_it)[3])
                want.add((card, k, min(of_it)[2]))
    got = {(r.card, r.item, r.picture) for r in picks.item_pictures(spark, SF).collect()}
    assert got == want and 20 < len(got) < len(items)


def test_answering_sentences_equal_a_plain_walk(spark):
    asked, pages = picks.threads(spark, SF)
    asked, pages = asked.collect(), pages.collect()
    want = {}
    for q in asked:
        words = {w for w in re.split("[^a-z0-9]+", (q.ask or "").lower()) if len(w) >= 4 and w not in sourced.QUOTE_STOP}
        for p in (p for p in pages if p.conv_id == q.conv_id and p.text and words):
            best_ = None
            for line in re.split(r"\n+", p.text):
                for said in re.split(r"(?<=[.!?])\s+", " ".join(line.split())):
                    if len(said) < 20 or len(said.split()) < 6 or re.search("[A-Za-z][0-9]", said) or len(re.findall(r"[0-9]+(?:\.[0-9]+)?", said)) >= 5:
                        continue
                    hits = sum(w in re.sub(sourced.ATTRIBUTION, "", said).lower() for w in words)
                    score = hits + bool(re.search(sourced.COUNTING, q.ask, re.I) and re.search("[0-9]", said)) - 3 * bool(re.search(sourced.ATTRIBUTION, said))
                    if hits >= min(2, len(words)) and (best_ is None or score > best_[1]):
                        best_ = said, score
            if best_:
                want[q.q_id, p.turn] = best_
    got = {(r.q_id, r.turn): (r.sentence, r.score) for r in picks.answering_sentences(spark, SF).collect()}
    assert got == want and len(got) > 20
