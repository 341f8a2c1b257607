"""Validation of nested card nodes against rules that are data: types, fields, limits of length, number and depth."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomlake.operators.bodies import _parts, loaded

MAX_DEPTH, MAX_ITEMS = 5, 12

# The types of nodes, their fields with limits, and what a node or an item must have.
TONES = "default muted primary positive negative warning"
RULES: dict[str, dict[str, Any]] = {
    "stack": {"fields": "children! direction:row|col gap:sm|md|lg align:start|center|end|between wrap?"},
    "grid": {"fields": "children! cols#2|3|4=2 gap:sm|md|lg"},
    "section": {"fields": "children! title80 icon@ tone~"},
    "scroller": {"fields": "children!"},
    "tabs": {"fields": "", "items": ("tabs", "label40! children!", 1)},
    "divider": {"fields": ""},
    "hero": {"fields": "value120! unit16 label80 caption200 icon@ tone~"},
    "heading": {"fields": "text160! eyebrow60 level#1|2|3"},
    "text": {"fields": "text1200! tone~ size:sm|md|lg"},
    "stat": {"fields": "label60! value40! unit16 icon@ delta30 trend:up|down|flat image500"},
    "tile": {"fields": "label60! value40 sub80 icon@ imageRef% imageQuery80 active? source$"},
    "keyvalue": {"fields": "", "items": ("items", "label60! value160! icon@", 1)},
    "list": {"fields": "style:bullet|check|number|icon|media", "items": ("items", "text300! icon@ meta60 imageRef% imageQuery80 source$", 1), "bare": "text"},
    "chart": {"fields": "kind:bar|hbar|line|area|pie=bar title80 unit20", "items": ("data", "label24! value#!", 2)},
    "progress": {"fields": "label80! value#! caption80"},
    "rating": {"fields": "value#! max#=5 label60"},
    "table": {"fields": "columns*40! rows**120! highlight#"},
    "timeline": {"fields": "", "items": ("items", "when30! title120! text240 source$", 1)},
    "steps": {"fields": "", "items": ("items", "title120! detail300", 1), "bare": "title"},
    "proscons": {"fields": "pros*200 cons*200", "any": ("pros", "cons")},
    "badges": {"fields": "items*40!"},
    "quote": {"fields": "text400! source80"},
    "callout": {"fields": "text400! title80 tone~ icon@"},
    "links": {"fields": "", "items": ("items", "source$! label100 note80", 1), "bare": "source"},
    "video": {"fields": "source$! caption120"},
    "draft": {"fields": "text4000! label60"},
    "code": {"fields": "code6000! lang24"},
    "image": {"fields": "ref% query80 caption120 aspect:wide|square|tall", "any": ("ref", "query")},
    "gallery": {"fields": "refs%* query80", "any": ("refs", "query")},
    "profile": {"fields": "name100! subtitle120 imageRef% imageQuery80", "items": ("facts", "label40! value120!", 0)},
    "choices": {"fields": "label60", "items": ("options", "label40! prompt200! selected?", 2)},
    "accordion": {"fields": "", "items": ("items", "title120! text800!", 1)},
    "reveal": {"fields": "", "items": ("items", "front200! back400!", 1)},
    "actions": {"fields": "", "items": ("items", "label40! query200! icon@ kind:search|ask|refine", 1)},
    "citations": {"fields": "refs#*!"},
}
_NUMBER = re.compile(r"\d[\d,]*(?:\.\d+)?(?:\s?°[CF]|\s?%)?")
_FIELD = re.compile(r"^([A-Za-z]+)([:#@~?%$*]+|\d+)?(.*)$")


def plain_text(s: str) -> str:
    """Without marks of headings and bold, and without the last of an odd number of quotation marks, unless a number is cut after it."""
    t = re.sub(r"\*\*|__", "", re.sub(r"(?m)^[ \t]*#{1,6}[ \t]+", "", s))
    if t.count('"') % 2:
        head, _, after = t.rpartition('"')
        if not (len(after) >= 40 and re.search(r"\d\.\s*$", after)):
            t = head + after
    return re.sub(r"[ \t]+\n", "\n", t).strip()


def within(s: str, most: int) -> str:
    """At most so many characters, or a few more where the cut would fall into a number."""
    if len(s) <= most:
        return s
    start = max(0, most - 16)
    ends = [start + m.end() for m in _NUMBER.finditer(s[start : most + 16]) if start + m.start() < most < start + m.end()]
    return s[: ends[-1] if ends else most]


def _string(v: Any, most: int) -> str | None:
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return str(v)
    s = plain_text(v) if isinstance(v, str) else ""
    return within(s, most) if s else None


def _number(v: Any) -> float | int | None:
    if isinstance(v, str):
        try:
            v = float(re.sub(r"[^\d.-]", "", v) or "x")
        except ValueError:
            return None
        v = int(v) if v.is_integer() else v
    return v if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else None


def _source(v: Any) -> int | None:
    n = _number(re.sub(r"\D", "", v) if isinstance(v, str) else v)
    return int(n) if n is not None and n == int(n) and 1 <= n <= 30 else None


def _icon(v: Any) -> str | None:
    return re.sub("[^a-z0-9-]", "", (_string(v, 40) or "").lower()) or None


class Cleaner:
    """Applies the rules to one card; `dropped` counts what went, by reason."""

    def __init__(self, images: int):
        self.images, self.dropped = images, Counter()

    def _items(self, v: Any) -> list:
        if not isinstance(v, list):
            return []
        self.dropped["items over the limit"] += max(0, len(v) - MAX_ITEMS)
        return v[:MAX_ITEMS]

    def _strings(self, v: Any, most: int) -> list[str]:
        return [s for x in self._items(v) if (s := _string(x, most))]

    def _ref(self, v: Any) -> int | None:
        n = _number(v)
        return math.floor(n) if n is not None and 0 <= n < self.images else None

    def _value(self, v: Any, mark: str, rest: str, depth: int) -> Any:
        """A field's value by its mark: digits limit a text, : # choose among values, others as named in RULES."""
        if mark.isdigit():
            return _string(v, int(mark))
        options = [x for x in rest.rstrip("!").partition("=")[0].split("|") if x]
        default = rest.rstrip("!").partition("=")[2]
        if mark == ":":
            return v if isinstance(v, str) and v in options else default or None
        if mark == "#":
            n = _number(v)
            fits = n is not None and (not options or str(n) in options)
            return n if fits else int(default) if default else None
        if mark == "?":
            return v is True
        if mark == "**":
            return [r for row in self._items(v) if (r := self._strings(row, int(rest.rstrip("!"))))] or None
        if mark == "*":
            return self._strings(v, int(rest.rstrip("!"))) or None
        if mark in ("%*", "#*"):
            return [n for x in self._items(v) if (n := self._ref(x) if mark == "%*" else _source(x)) is not None] or None
        if mark == "":
            return self.nodes(v, depth + 1) or None
        return {"@": _icon, "~": lambda x: x if x in TONES.split() else None, "%": self._ref, "$": _source}[mark](v)

    def _fields(self, raw: dict, spec: str, depth: int) -> dict | None:
        """The fields of a node or an item, or nothing if one that it must have is missing."""
        out: dict[str, Any] = {}
        for part in spec.split():
            name, mark, rest = _FIELD.match(part).groups()
            value = self._value(raw.get(name), mark or "", rest, depth)
            if value is None and part.endswith("!"):
                return None
            if value is not None and value is not False:
                out[name] = value
        return out

    def node(self, raw: Any, depth: int) -> dict | None:
        rule = RULES.get(raw.get("type")) if isinstance(raw, dict) and isinstance(raw.get("type"), str) else None
        if rule is None:
            self.dropped["unknown type"] += 1
            return None
        out = self._fields(raw, rule["fields"], depth)
        if out is not None and "items" in rule:
            name, spec, least = rule["items"]
            items = []
            for item in self._items(raw.get(name)):
                if not isinstance(item, dict):
                    item = {rule.get("bare", ""): item}
                items.append(self._fields(item, spec, depth))
            kept = [x for x in items if x]
            self.dropped["incomplete item"] += len(items) - len(kept)
            out = {**out, name: kept} if len(kept) >= least else None
        if out is None or "any" in rule and not any(out.get(k) is not None for k in rule["any"]):
            self.dropped["incomplete node"] += 1
            return None
        if raw["type"] == "progress":
            out["value"] = max(0, min(100, out["value"]))
        return {"type": raw["type"], **out}

    def nodes(self, raw: Any, depth: int = 0) -> list[dict]:
        if depth > MAX_DEPTH:
            self.dropped["nodes too deep"] += len(raw) if isinstance(raw, list) else 0
            return []
        return [n for x in self._items(raw) if (n := self.node(x, depth))]


def sanitized(cards: DataFrame, card: str, body: str, images: int = 30) -> DataFrame:
    """(card, body, dropped): nodes by the rules, in their order, and how many of what went; no JSON gives an empty list.

    A list holds at most 12 things and a card is at most five containers deep; longer texts are cut, but not inside a
    number; references to pictures and sources must be of ones that exist.
    """
    kind = cards.schema[card].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            bodies, counts = [], []
            for text in batch.column(1).to_pylist():
                cleaner = Cleaner(images)
                bodies.append(json.dumps(cleaner.nodes(loaded(text)), ensure_ascii=False))
                counts.append([(k, v) for k, v in sorted(cleaner.dropped.items()) if v])
            columns = [batch.column(0), pa.array(bodies, pa.string()), pa.array(counts, pa.map_(pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["card_", "body_", "dropped"])

    out = cards.select(F.col(card).cast("string"), body).mapInArrow(run, "card_ string, body_ string, dropped map<string, long>")
    return out.select(F.col("card_").cast(kind).alias(card), F.col("body_").alias(body), "dropped")
