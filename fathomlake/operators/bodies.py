"""Nested cards: cut into text slots, judged as rows or folds of a card, and built again in the same shape.

A card is a JSON list of nodes; containers hold children or tabs. Every slot of text has a place in the card's order and
a path; decisions are tables of (card, path, text), a null text drops the slot. What is left empty by that goes: a node
without its text, an item list without items, a container without children. A body that is no JSON list or object gives
no slots and stays as it is.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomlake.functions.reading import join_spaced_decimals
from fathomlake.functions.text import collapsed

# The field of a node that is text, and of the items of a node that has items.
OWN_TEXT = {"text": "text", "callout": "text", "quote": "text", "draft": "text", "heading": "text", "hero": "caption", "tile": "value", "stat": "value"}
ITEM_TEXT = {"list": "text", "accordion": "text", "steps": "detail", "keyvalue": "value"}
#: Items and nodes that may lack their text.
OPTIONAL = {"hero", "steps"}
CONTAINERS = {"stack", "grid", "section", "scroller", "tabs"}

_SLOT = "card_ string, at int, path string, slot int, type string, label string, text string"


def loaded(body: str | None) -> list | None:
    try:
        nodes = json.loads(body)
    except (TypeError, ValueError, RecursionError):
        return None
    return nodes if isinstance(nodes, list) else [nodes] if isinstance(nodes, dict) else None


def _children(node: dict) -> list[tuple[str, list]]:
    """(path step, nodes) of what a node holds."""
    out = [("", node["children"])] if isinstance(node.get("children"), list) else []
    if node.get("type") == "tabs" and isinstance(node.get("tabs"), list):
        out += [(f"t{i}", t["children"]) for i, t in enumerate(node["tabs"]) if isinstance(t, dict) and isinstance(t.get("children"), list)]
    return out


def _walk(nodes: list) -> Iterator[tuple[str, int, str, str | None, str]]:
    """(path, top-level slot, type, label, text) of every text of a card, in order; a stack instead of recursion, so depth is no limit."""
    stack = [(n, str(i), i) for i, n in reversed(list(enumerate(nodes)))]
    while stack:
        node, path, slot = stack.pop()
        if not isinstance(node, dict):
            continue
        kind = str(node.get("type"))
        if isinstance(text := node.get(OWN_TEXT.get(kind, "")), str):
            yield path, slot, kind, node.get("label") if isinstance(node.get("label"), str) else None, text
        items = node.get("items") if kind in ITEM_TEXT else None
        for i, item in enumerate(items if isinstance(items, list) else []):
            text = item.get(ITEM_TEXT[kind]) if isinstance(item, dict) else item
            if isinstance(text, str):
                label = item.get("label") if isinstance(item, dict) else None
                yield f"{path}.i{i}", slot, kind, label if isinstance(label, str) else None, text
        for step, held in reversed(_children(node)):
            stack += [(n, f"{path}.{step}{i}", slot) for i, n in reversed(list(enumerate(held)))]


#: Bytes of bodies whose cards are parsed together, one card at least: what Python holds beside a batch goes by this, not by the batch.
PART_BYTES = 1 << 20


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of cards in slices of at most PART_BYTES of bodies (its second column)."""
    start, held = 0, 0
    for i, size in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        if held and held + (size or 0) > PART_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size or 0
    yield batch.slice(start)


def _each(cards: DataFrame, run: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in _parts(batch):
                yield from run(part)

    return cards.mapInArrow(batches, schema)


def text_slots(cards: DataFrame, card: str, body: str) -> DataFrame:
    """(card, at, path, slot, type, label, text): texts of nested cards in reading order; slot is the number of the top-level node."""
    schema = pa.schema([("card_", pa.string()), ("at", pa.int32()), ("path", pa.string()), ("slot", pa.int32()), ("type", pa.string()), ("label", pa.string()), ("text", pa.string())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for at, (path, slot, kind, label, said) in enumerate(_walk(loaded(text) or [])):
                rows.append({"card_": key, "at": at, "path": path, "slot": slot, "type": kind, "label": label, "text": said})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kind = cards.schema[card].dataType
    out = _each(cards.select(F.col(card).cast("string"), body), run, _SLOT)
    return out.select(F.col("card_").cast(kind).alias(card), "at", "path", "slot", "type", "label", "text")


def _edited(nodes: list, path: str, edits: dict[str, str | None]) -> list:
    """Nodes with the edits put in, without what they leave empty. Depth is bounded by what json reads."""
    out = []
    for i, node in enumerate(nodes):
        at = f"{path}{i}"
        if not isinstance(node, dict):
            out.append(node)
            continue
        kind, node = str(node.get("type")), dict(node)
        if at in edits:
            field = OWN_TEXT[kind]
            if edits[at]:
                node[field] = edits[at]
            elif kind in OPTIONAL:
                node.pop(field)
            else:
                continue
        if kind in ITEM_TEXT and isinstance(node.get("items"), list):
            items = []
            for k, item in enumerate(node["items"]):
                here = f"{at}.i{k}"
                if here not in edits:
                    items.append(item)
                elif edits[here]:
                    items.append({**item, ITEM_TEXT[kind]: edits[here]} if isinstance(item, dict) else edits[here])
                elif kind in OPTIONAL and isinstance(item, dict):
                    items.append({k: v for k, v in item.items() if k != ITEM_TEXT[kind]})
            if node["items"] and not items:
                continue
            node["items"] = items
        if isinstance(node.get("children"), list):
            held = _edited(node["children"], f"{at}.", edits)
            if node["children"] and not held and kind in CONTAINERS:
                continue
            node["children"] = held
        if kind == "tabs" and isinstance(node.get("tabs"), list):
            tabs = [{**t, "children": _edited(t["children"], f"{at}.t{k}", edits)} if isinstance(t, dict) and isinstance(t.get("children"), list) else t for k, t in enumerate(node["tabs"])]
            kept = [t for t, old in zip(tabs, node["tabs"]) if not (isinstance(old, dict) and old.get("children") and not t["children"])]
            if tabs and not kept:
                continue
            node["tabs"] = kept
        out.append(node)
    return out


def rebuilt(cards: DataFrame, edits: DataFrame, card: str, body: str) -> DataFrame:
    """(card, body): cards with the edits (card, path, text) put in; a card without edits stays as it is, byte for byte."""
    gathered = edits.groupBy(card).agg(F.map_from_entries(F.collect_list(F.struct("path", "text"))).alias("edits_"))
    rows = cards.select(card, body).join(gathered, card, "left")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for text, changes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            nodes = loaded(text) if changes else None
            out.append(text if nodes is None else json.dumps(_edited(nodes, "", dict(changes)), ensure_ascii=False))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["card_", "body_"])

    kind = cards.schema[card].dataType
    out = _each(rows.select(F.col(card).cast("string"), body, "edits_"), run, "card_ string, body_ string")
    return out.select(F.col("card_").cast(kind).alias(card), F.col("body_").alias(body))


def sentence_key(text: Column) -> Column:
    """What a sentence says: lower case, letters and digits without citations, 80 characters at most."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"\[\d+\]", ""), "[^a-z0-9 ]+", " ")
    return F.substring(F.trim(F.regexp_replace(bare, " +", " ")), 1, 80)


def split_sentences(text: Column) -> Column:
    return F.split(collapsed(join_spaced_decimals(text)), r"(?<=[.!?])\s+")


def polished(cards: DataFrame, card: str, body: str, cap: int = 600, least: int = 12) -> DataFrame:
    """(card, body) without sentences, items and quotations that a card has said before, texts within `cap` characters at a sentence's end.

    Two sentences say the same if their keys are equal; a key of fewer than `least` characters may come again. A text's
    first sentence stays, however long. Texts and accordions are cut into sentences, items and quotations count whole;
    headings, figures, drafts and the details of steps are left alone.
    """
    slots = text_slots(cards, card, body).where(F.col("type").isin("text", "callout", "hero", "list", "accordion", "quote"))
    whole = F.col("type").isin("list", "quote")
    limit = F.when(F.col("type") == "callout", min(cap, 280)).when(F.col("type") == "hero", 160).otherwise(cap)
    parts = F.when(whole, F.array("text")).otherwise(split_sentences(F.col("text")))
    rows = slots.select(card, "at", "path", "text", whole.alias("whole_"), limit.alias("cap_"), F.posexplode(parts).alias("pos", "part"))
    w = Window.partitionBy(card, "at").orderBy("pos")
    rows = rows.withColumn("used_", F.sum(F.length("part") + 1).over(w) - 1).where((F.col("pos") == 0) | F.col("whole_") | (F.col("used_") <= F.col("cap_")))
    rows = rows.withColumn("key_", sentence_key(F.col("part")))
    again = F.row_number().over(Window.partitionBy(card, "key_").orderBy("at", "pos")) > 1
    rows = rows.withColumn("kept_", ~(again & (F.length("key_") >= least)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kept_"), F.struct("pos", "part")))), lambda x: x["part"]), " ")
    texts = rows.groupBy(card, "path", "text").agg(joined.alias("new_"))
    changed = texts.where(F.col("new_") != F.col("text")).select(card, "path", F.when(F.col("new_") != "", F.col("new_")).alias("text"))
    return rebuilt(cards, changed, card, body)


def content_words(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"\[[0-9]+\]", " "), r"[^a-z0-9\s]", " ")
    return F.filter(F.split(bare, r"\s+"), lambda w: F.length(w) > 2)


def said_once(cards: DataFrame, card: str, body: str, run: int = 8) -> DataFrame:
    """(card, body) without sentences that share `run` words in a row with one that a card has kept before.

    A dropped sentence is not remembered, so this is a fold over a card's sentences in order: the state is the runs of
    words that were kept.
    """
    slots = text_slots(cards, card, body).where(F.col("type").isin("text", "callout", "quote", "draft", "heading", "hero"))
    rows = slots.select(card, "at", "path", "text", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("pos", "part"))
    words = content_words(F.col("part"))
    runs = F.when(F.size(words) >= run, F.transform(F.sequence(F.lit(1), F.size(words) - run + 1), lambda i: F.array_join(F.slice(words, i, run), " "))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("runs_", runs)
    listed = rows.groupBy(card).agg(F.array_sort(F.collect_list(F.struct("at", "pos", "path", "part", "runs_"))).alias("all_"))
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<boolean>").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        new = ~F.arrays_overlap(state["seen"], x["runs_"])
        return F.struct(F.when(new, F.concat(state["seen"], x["runs_"])).otherwise(state["seen"]).alias("seen"), F.concat(state["kept"], F.array(new)).alias("kept"))

    kept = listed.select(card, "all_", F.aggregate("all_", start, step)["kept"].alias("kept_"))
    parts = kept.select(card, F.explode(F.arrays_zip("all_", "kept_")).alias("x")).select(card, "x.all_.at", "x.all_.pos", "x.all_.path", "x.all_.part", F.col("x.kept_").alias("kept_"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kept_"), F.struct("pos", "part")))), lambda x: x["part"]), " ")
    texts = parts.groupBy(card, "path").agg(F.min("kept_").alias("all_kept_"), collapsed(joined).alias("new_"))
    changed = texts.where(~F.col("all_kept_")).select(card, "path", F.when(F.col("new_") != "", F.col("new_")).alias("text"))
    return rebuilt(cards, changed, card, body)


# Words of a label that don't tell one fact from another.
LABEL_STOP = ("the", "and", "for", "with", "from", "this", "that", "per", "total", "value")


def fact_keys(label: Column, value: Column) -> Column:
    """The keys one fact is known by: its value with each word of its label; none for a value of one character."""
    said = F.trim(F.regexp_replace(F.regexp_replace(F.lower(value), r"\[\d+\]", ""), "[^a-z0-9.$%€£]+", " "))
    words = F.filter(F.split(F.lower(F.coalesce(label, F.lit(""))), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~F.array_contains(F.array(*map(F.lit, LABEL_STOP)), w))
    words = F.when(F.size(words) > 0, words).otherwise(F.array(F.lit("")))
    return F.when(F.length(said) >= 2, F.transform(words, lambda w: F.concat(said, F.lit("|"), w))).otherwise(F.array().cast("array<string>"))


def long_key(value: Column) -> Column:
    """A value of a sentence's length, plain; null if it is short."""
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(value), r"\[\d+\]", ""), "[^a-z0-9]+", " "))
    return F.when(F.length(key) >= 40, key)


def without_repeated_facts(cards: DataFrame, card: str, body: str) -> DataFrame:
    """(card, body) without figures and rows whose fact an earlier top-level node of the card keeps.

    A fact is repeated if it shares a key with a kept one, or if its long value stands in a long text shown before. Nodes
    of one slot don't take facts from each other: the fold goes from slot to slot.
    """
    slots = text_slots(cards, card, body).where(F.col("type").isin("tile", "stat", "keyvalue", "text", "callout", "quote", "hero"))
    fact = F.col("type").isin("tile", "stat", "keyvalue")
    none = F.array().cast("array<string>")
    long = long_key(F.col("text"))
    rows = slots.select(card, "slot", F.struct("at", "path", fact.alias("fact"), F.when(fact, fact_keys(F.col("label"), F.col("text"))).otherwise(none).alias("keys"), F.when(F.col("type") != "stat", long).alias("long")).alias("x"))
    by_slot = rows.groupBy(card, "slot").agg(F.array_sort(F.collect_list("x")).alias("xs")).groupBy(card).agg(F.array_sort(F.collect_list(F.struct("slot", "xs"))).alias("slots_"))
    start = F.struct(none.alias("keys"), none.alias("longs"), none.alias("dropped"))

    def step(state: Column, s: Column) -> Column:
        repeated = lambda x: x["fact"] & (F.arrays_overlap(x["keys"], state["keys"]) | F.coalesce(F.exists(state["longs"], lambda shown: F.contains(shown, x["long"])), F.lit(False)))
        kept, gone = F.filter(s["xs"], lambda x: ~repeated(x)), F.filter(s["xs"], repeated)
        longs = F.filter(F.transform(kept, lambda x: x["long"]), lambda v: v.isNotNull())
        return F.struct(
            F.concat(state["keys"], F.flatten(F.transform(kept, lambda x: x["keys"]))).alias("keys"),
            F.concat(state["longs"], longs).alias("longs"),
            F.concat(state["dropped"], F.transform(gone, lambda x: x["path"])).alias("dropped"),
        )

    dropped = by_slot.select(card, F.explode(F.aggregate("slots_", start, step)["dropped"]).alias("path")).withColumn("text", F.lit(None).cast("string"))
    return rebuilt(cards, dropped, card, body)


# A label before a number, a cut number at the end, a number with decimals.
CUT_LABEL = r"(?i)\b(?:chapter|section|page|step|item|figure|table|note|version|part|vol)\.?\s+\d+\.?\s*$"
CUT_NUMBER = r"(\d+)\.?\s*$"
DECIMALS = r"(\d+\.\d+(?:\s?°[CF]|\s?%)?)"


def with_cut_decimals(cards: DataFrame, card: str, body: str, least: int = 40, most_hint: int = 80) -> DataFrame:
    """(card, body): a text that stops at the whole part of a number gets the decimals that the same card states, if there is one such number only.

    Numbers with decimals come from texts of up to `most_hint` characters. A text of fewer than `least` characters, one
    that ends in a label with a number ("page 12") and one that has the decimals itself stay. A quotation left open is
    closed.
    """
    slots = text_slots(cards, card, body)
    hints = slots.where(F.length("text") <= most_hint).select(card, F.explode(F.regexp_extract_all("text", F.lit(DECIMALS), F.lit(1))).alias("full_"))
    hints = hints.withColumn("whole_", F.regexp_extract("full_", r"^(\d+)", 1)).distinct()
    opened = F.regexp_replace("text", r'^([\s\S]*)["“«]([^"“”«»]*)$', "$1\u0001$2")
    inside = F.when(F.contains(opened, F.lit("\u0001")), F.regexp_extract(opened, "\u0001([\\s\\S]*)$", 1)).otherwise(F.col("text"))
    closed = F.col("text").rlike(r'["”»]\s*$')
    last = F.when(closed, F.regexp_extract("text", r'["“«]([^"“”«»]*)["”»]\s*$', 1)).otherwise(inside)
    cut = slots.where(F.col("type").isin("text", "callout", "quote", "hero")).withColumn("inside_", last)
    cut = cut.where((F.length("inside_") >= least) & ~F.col("inside_").rlike(CUT_LABEL)).withColumn("whole_", F.regexp_extract("inside_", CUT_NUMBER, 1)).where("whole_ <> ''")
    own = F.exists(F.regexp_extract_all("inside_", F.lit(r"(?:^|\D)(\d+)\.\d"), F.lit(1)), lambda n: n == F.col("whole_"))
    found = cut.where(~own).join(hints, [card, "whole_"]).groupBy(card, "path", "text", "inside_").agg(F.min("full_").alias("full_"), F.count("*").alias("n_")).where("n_ = 1")
    tail = F.regexp_extract("text", r'(["”»]?\s*)$', 1)
    head = F.regexp_replace(F.col("text").substr(F.lit(1), F.length("text") - F.length(tail)), r"\d+\.?\s*$", "")
    quotes = F.length("text") - F.length(F.regexp_replace("text", '["“«]', ""))
    ends = F.length("text") - F.length(F.regexp_replace("text", "[”»]", ""))
    straight = (F.length("text") - F.length(F.replace("text", F.lit('"')))) % 2 == 1
    closer = F.when(tail.rlike('["”»]'), tail).when(straight, '"').when((quotes > ends) & F.contains("text", F.lit("“")) & (ends == 0), "”").otherwise("")
    return rebuilt(cards, found.select(card, "path", F.concat(head, "full_", closer).alias("text")), card, body)
