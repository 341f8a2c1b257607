"""Encoding and decoding with a word-level BPE whose words end in a suffix, by a trie of distinct words.

White space never lies within a word, so a text is cut at white space and each distinct run ("chunk") is encoded once
per worker. A batch's new words are walked as a trie in depth-first order (sorted order with the common prefix kept):
for each prefix the last token of its encoding is propagated, so a prefix that many words share is encoded once. The
last token at a node is the longest token ending there that may follow the last token of what stands before it: two
tokens may stand together when merging their joined characters gives these two again. A word's tokens are then read
off backwards from the node of its end symbol.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import WORKER_CACHES, BoundedCache, mapped, sliced
from .token_counts import SPACE, tokenizer

RUN = re.compile(f"[^{SPACE}]+")
#: str.split() also cuts at these, which the tokenizer takes for punctuation.
NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Up to here characters have no decompositions to put together and lower-case alike in every version of Unicode.
LATIN = "\xff"
CACHE_LIMIT = 1 << 19
INNER, FINAL = 0, 1
#: Marks that may close a word.
TAIL = ".,;:!?*$%&#"
NONE: dict[str, bool] = {}
PAIR_LIMIT = 1 << 20


def runs(text: str) -> list[str]:
    return RUN.findall(text) if NOT_SPACE.search(text) else text.split()


class WordBpe:
    """A tokenizer file's vocabulary, merges and pre-tokenizer pattern, with caches for one worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.bytes = byte_symbols()
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.shown = {i: str(i) for i in self.tokens}
        self.root = self.token_trie()
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.whole: dict[str, bool] = {}
        self.library = tokenizer(path)[0]

    def symbols(self, token: str) -> tuple[str, ...]:
        """A token's characters; the suffix belongs to the last of them."""
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return (*body[:-1], body[-1] + self.suffix)
        return tuple(token)

    def token_trie(self) -> dict:
        """The vocabulary by characters; a node's INNER and FINAL are its tokens within a word and at its end."""
        root: dict = {}
        for token in self.vocab:
            final = bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix
            node = root
            for c in token[: -len(self.suffix)] if final else token:
                node = node.setdefault(c, {})
            node[FINAL if final else INNER] = token
        return root

    def merged(self, symbols: Iterable[str]) -> list[str]:
        """Merges by rank, the leftmost first: what the trie's states have to agree with."""
        parts = list(symbols)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: str, right: str) -> bool:
        if self.n_pairs >= PAIR_LIMIT:
            self.pairs.clear()
            self.n_pairs = 0
        known = self.merged((*self.symbols(left), *self.symbols(right))) == [left, right]
        self.pairs.setdefault(left, {})[right] = known
        self.n_pairs += 1
        return known

    def reachable(self, token: str) -> bool:
        """Whether merging the token's own characters gives the token; kept for what the vocabulary has."""
        if token not in self.vocab:
            return False
        known = self.whole[token] = self.merged(self.symbols(token)) == [token]
        return known

    def ending(self, open_tokens: list[tuple[int, dict]], kind: int, last: list[str]) -> tuple[str, int] | None:
        """The last token of a prefix, and where it begins: the longest that may follow what stands before it."""
        for start, node in open_tokens:
            token = node.get(kind)
            if token is None or not (self.whole[token] if token in self.whole else self.reachable(token)):
                continue
            if not start:
                return token, start
            fits = self.pairs.get(last[start], NONE).get(token)
            if self.may_follow(last[start], token) if fits is None else fits:
                return token, start
        return None

    def encode_words(self, words: Iterable[str]) -> dict[str, list[str]]:
        """Tokens of byte-level words. Sorted words are the trie in depth-first order; states are kept along the path."""
        found: dict[str, list[str]] = {}
        root, suffix, ending = self.root, self.suffix, self.ending
        # Of each prefix of the path: the places where a token may have begun that goes on, the last token, its begin.
        going: list[list[tuple[int, dict]]] = [[]]
        last, begin = [""], [0]
        before = ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del going[shared + 1 :], last[shared + 1 :], begin[shared + 1 :]
            n = len(word)
            for end in range(len(going), n + 1):
                c = word[end - 1]
                now = [(start, node[c]) for start, node in going[-1] if c in node]
                if c in root:
                    now.append((end - 1, root[c]))
                going.append(now)
                token, start = ending(now, INNER, last) or (c, end - 1)  # a symbol that the vocabulary doesn't have
                last.append(token)
                begin.append(start)
            token, start = ending(going[n], FINAL, last) or (word[n - 1] + suffix, n - 1)
            tokens = [token]
            while start:
                tokens.append(last[start])
                start = begin[start]
            found[word] = tokens[::-1]
            before = word
        return found

    def words(self, chunk: str) -> list[str]:
        """The byte-level words of a chunk without white space; a special string stands for itself."""
        if chunk.isascii() or max(chunk) <= LATIN:
            low = chunk.lower()
            if low.isalpha():
                return [self.to_bytes(low)]
            stem = low.rstrip(TAIL)
            if stem.isalpha():  # the pattern takes letters and marks apart; no contraction or special string begins with these marks
                return [self.to_bytes(stem), low[len(stem) :]]
        if "<|" in chunk and self.cut.search(chunk):
            parts, at = [], 0
            for m in self.cut.finditer(chunk):
                parts += [*self.plain(chunk[at : m.start()]), m.group()]
                at = m.end()
            return parts + self.plain(chunk[at:])
        return self.plain(chunk)

    def plain(self, chunk: str) -> list[str]:
        if not chunk:
            return []
        if max(chunk) > LATIN:  # the library's own Unicode tables decide
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]
        low = chunk.lower()
        if low.isalpha():
            return [self.to_bytes(low)]
        return [self.to_bytes(w) for w in self.pattern.findall(low)]

    def to_bytes(self, word: str) -> str:
        return word if word.isascii() and word.isalnum() else "".join(self.bytes[b] for b in word.encode())

    def encode_chunks(self, chunks: Iterable[str]) -> dict[str, tuple[int, str, str]]:
        """Of each chunk: the number of tokens, their ids joined by spaces, and what these decode to. Each distinct word is encoded once."""
        words = {c: self.words(c) for c in chunks}
        special, vocab, shown, tokens = self.special, self.vocab, self.shown, self.tokens
        known = {w: (1, shown[i], tokens[i]) for w, i in special.items()}
        for w, own in self.encode_words({w for own in words.values() for w in own if w not in special}).items():
            ids = [vocab[t] for t in own]
            known[w] = (len(ids), " ".join([shown[i] for i in ids]), " ".join([tokens[i] for i in ids]))
        return {c: known[own[0]] if len(own) == 1 else self._joined([known[w] for w in own]) for c, own in words.items()}

    def decode(self, ids: Iterable[int]) -> str:
        """The library's decoding for a file without decoder: tokens joined by one space; ids that it doesn't have are left out."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])

    @staticmethod
    def _joined(parts: list[tuple[int, str, str]]) -> tuple[int, str, str]:
        return sum(p[0] for p in parts), " ".join(p[1] for p in parts), " ".join(p[2] for p in parts)


def byte_symbols() -> list[str]:
    """The usual printable stand-ins of byte-level BPE: visible Latin-1 bytes stand for themselves, others from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


_workers: dict[str, tuple[WordBpe, BoundedCache]] = {}
WORKER_CACHES.extend((_workers,))


def worker(path: str) -> tuple[WordBpe, BoundedCache]:
    if path not in _workers:
        _workers[path] = (WordBpe(path), BoundedCache(CACHE_LIMIT))
    return _workers[path]


def encode_decode(docs: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row; with `keep` also ids (array<int>) and decoded.

    A text decodes to what its chunks' ids decode to, joined by one space. Null and empty texts have no
    tokens and the digests of the empty string; repeated rows and null doc_ids give a row each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, cache = worker(path)
        for batch in sliced(batches):
            chunks = [runs(text) for text in batch["text"]]
            if missing := cache.missing(set().union(*chunks)):
                cache.update(bpe.encode_chunks(missing))
            rows = []
            for own in chunks:
                n, ids, decoded = zip(*map(cache.__getitem__, own)) if own else ((), (), ())
                ids, decoded = " ".join(ids), " ".join(decoded)
                row = (sum(n), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append(row + (([int(i) for i in ids.split()], decoded) if keep else ()))
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", batch["doc_id"])
            yield out

    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep
    return mapped(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep)
