"""URL verdicts by host-and-path rules and by pattern rules, all in column expressions.

Host rules are filed under their host; a url looks up each suffix of its host. Pattern rules: each is filed under the
rarest, over all urls, of the literal tokens that every matching url has to contain; a url's tokens fetch the candidates
and only those run their regular expression. Both files are hashed: an array of twice as many slots as keys, so that a
lookup reads one slot, however many rules there are. Rules are data of the job (thousands, not rows of a table), and
travel as literals; urls are neither joined nor shuffled.

Pattern language: `*` any characters, `^` one character that is no letter, digit, `%`, `-` or `_`, or the end, `||` at
the start: the start of a host label, `|` at an end: that end of the url. Letters match in lower case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class HostRule:
    """Fits `host` and its subdomains where the path begins with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """An exception (allow) goes before any block."""

    verdict: str
    pattern: str

    @property
    def regex(self) -> str:
        """A regular expression that Java and RE2 read alike."""
        body, start, end = self.pattern.lower(), "", ""
        if body.startswith("||"):
            body, start = body[2:], r"^[^/?#]*://([^/?#]*\.)?"
        elif body.startswith("|"):
            body, start = body[1:], "^"
        if body.endswith("|"):
            body, end = body[:-1], "$"
        special = {"*": ".*", "^": "([^a-z0-9%_-]|$)"}
        return start + "".join(special.get(c) or re.sub(r"([^a-z0-9_/:=&%-])", r"\\\1", c) for c in body) + end

    @property
    def literals(self) -> list[str]:
        """Tokens that stand whole in every matching url: cut off on both sides by something that is no letter or digit."""
        body = self.pattern.lower()
        left = body.startswith("|")
        right = body.endswith("|")
        body = body.strip("|")
        found = []
        for m in re.finditer(TOKEN, body):
            before = body[m.start() - 1] if m.start() else "|" if left else "*"
            after = body[m.end()] if m.end() < len(body) else "|" if right else "*"
            if "*" not in (before, after):
                found.append(m.group())
        return sorted(set(found))


HOST_RULES = (
    HostRule("block", "net", "/"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)
PATTERN_RULES = (
    PatternRule("block", ".casino-win."),
    PatternRule("block", "||casino-"),
    PatternRule("block", "||poker-"),
    PatternRule("block", ".free-pills."),
    PatternRule("block", "||adult."),
    PatternRule("block", "^xxx^"),
    PatternRule("block", "^porn^"),
    PatternRule("block", "^viagra^"),
    PatternRule("block", "||ads."),
    PatternRule("block", "||doubleclick."),
    PatternRule("block", "/sponsored/"),
    PatternRule("block", "/affiliate/*click"),
    PatternRule("block", "?utm_source=spam"),
    PatternRule("block", "/wp-login.php"),
    PatternRule("block", "/cgi-bin/"),
    PatternRule("block", "^session_id=*&"),
    PatternRule("allow", "||www.casino-win.*/fr/*.html|"),
    PatternRule("allow", "^responsible-gambling^"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty for a null url and one without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(url, UPPER, LOWER), F.lit(f"({TOKEN})"), 1))


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many urls each of these (the rules') tokens stands: one row a token comes to the driver."""
    each = urls.select(F.explode(url_tokens(F.col("url"))).alias("token")).where(F.col("token").isin(tokens))
    return {r["token"]: r["count"] for r in each.groupBy("token").count().collect()}


def filed(entries: dict[str, list[Column]], kind: str):
    """A function from a string column to the rules (array of `kind`) filed under it: one slot by hash, then its few keys."""
    if not entries:
        return lambda key: F.array().cast(f"array<{kind}>")
    n = 1 << (2 * len(entries) - 1).bit_length()
    slots: list[list[Column]] = [[] for _ in range(n)]
    for key, rules in sorted(entries.items()):
        slots[crc32(key.encode()) % n].append(F.struct(F.lit(key).alias("key"), F.array(*rules).alias("rules")))
    none = F.array().cast(f"array<struct<key:string,rules:array<{kind}>>>")
    table = F.array(*(F.array(*own) if own else none for own in slots))
    return lambda key: F.flatten(F.transform(F.filter(F.get(table, (F.crc32(key) % n).cast("int")), lambda e: e["key"] == key), lambda e: e["rules"]))


def judge(pages: DataFrame, host_rules: tuple[HostRule, ...] = HOST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule (null if no host rule fits) and verdict for every row of `pages`.

    The longest fitting host rule decides; without one, pattern rules do: allow where an exception matches or nothing
    blocks. A null url, or one without `://`, has an empty host and path; its tokens are still looked up. Rows with
    the same page_id are judged each; other columns are ignored.
    """
    urls = pages.select("page_id", "url")
    host, path = host_and_path(F.col("url"))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))

    by_host: dict[str, list[Column]] = {}
    for r in sorted(host_rules, key=lambda r: -len(r.name)):
        by_host.setdefault(r.host, []).append(F.struct(F.lit(len(r.name)).alias("length"), F.lit(r.name).alias("rule"), F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict")))
    fitting = F.filter(F.flatten(F.transform(suffixes, filed(by_host, "struct<length:int,rule:string,path:string,verdict:string>"))), lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(fitting)

    counts = token_counts(urls, sorted({t for r in pattern_rules for t in r.literals})) if pattern_rules else {}
    by_token: dict[str, list[Column]] = {}
    always = []
    for r in pattern_rules:
        rule = F.struct(F.lit(r.regex).alias("regex"), F.lit(r.verdict).alias("verdict"))
        if r.literals:
            by_token.setdefault(min(r.literals, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
        else:
            always.append(rule)
    nothing = F.array().cast("array<struct<regex:string,verdict:string>>")
    everywhere = F.array(*always) if always else nothing
    candidates = F.concat(everywhere, F.flatten(F.transform(url_tokens(F.col("url")), filed(by_token, "struct<regex:string,verdict:string>"))))
    low = F.translate("url", UPPER, LOWER)
    hits = F.filter(F.coalesce(candidates, nothing), lambda r: F.regexp_like(low, r["regex"]))
    by_pattern = F.when(F.exists(hits, lambda r: r["verdict"] == "allow") | (F.size(hits) == 0), "allow").otherwise("block")

    found = urls.withColumns({"host": host, "path": path}).withColumn("best", best)
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), by_pattern).alias("verdict"))


def oracle_sql(host_rules: tuple[HostRule, ...] = HOST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES) -> str:
    """The same rows in DuckDB, every rule tried on every url."""
    hosts = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in host_rules)
    quoted = lambda verdict: " OR ".join("regexp_matches(translate(url, '%s', '%s'), '%s')" % (UPPER, LOWER, r.regex.replace("'", "''")) for r in pattern_rules if r.verdict == verdict) or "false"
    return f"""
WITH rules(verdict, host, path) AS (VALUES {hosts}),
cut AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT row_number() OVER () AS k, page_id, url,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut),
best AS (
  SELECT p.k, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.k)
SELECT p.page_id, p.host, p.path, b.rule,
  coalesce(b.verdict, CASE WHEN coalesce({quoted('allow')}, false) THEN 'allow' WHEN coalesce({quoted('block')}, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b USING (k)"""
