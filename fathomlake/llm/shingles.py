"""Sets of word n-grams as sorted 64-bit hashes, computed over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX = np.uint64(0xBF58476D1CE4E5B9)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Characters of text that are hashed at once.
BLOCK = 400_000

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i below n at least; kept by the worker."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 3 * BLOCK)
        for name, b in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, and the index of each word's text."""
    encoded = [t.encode() for t in texts]
    data = np.frombuffer((b" " + b" ".join(encoded) + b" ").lower(), np.uint8)
    up, down = powers(len(data) + 1)
    space = SPACES[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)
    words = mixed((sums[ends - 1] - sums[starts - 1]) * down[starts])
    begins = np.cumsum([1, *(len(e) + 1 for e in encoded)])[:-1]
    return words, np.searchsorted(begins, starts, "right") - 1


def combined(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k words in a row; shorter than the input by k - 1."""
    n = len(words) - k + 1
    h = words[:n] + np.uint64(k)
    for j in range(1, k):
        h = mixed(h * BASE + words[j : j + n])
    return mixed(h)


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Each text's set as a sorted array: k-word shingles; the whole sequence as one if it has fewer words; else empty."""
    words, of = word_hashes(texts)
    counts = np.bincount(of, minlength=len(texts))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    every = combined(words, k) if len(words) >= k else np.zeros(0, np.uint64)
    sets = []
    for i, n in enumerate(counts):
        a = bounds[i]
        if n >= k:
            sets.append(np.unique(every[a : a + n - k + 1]))
        else:
            sets.append(combined(words[a : a + n], n) if n else np.zeros(0, np.uint64))
    return sets


def sets_of(batch: pd.DataFrame, k: int) -> Iterator[tuple[str, np.ndarray]]:
    """(doc_id, set) of a batch's rows, a block of texts at a time."""
    size, ids, texts = 0, [], []
    for doc_id, text in zip(batch["doc_id"], batch["text"]):
        ids.append(doc_id)
        texts.append(text)
        size += len(text)
        if size >= BLOCK:
            yield from zip(ids, shingle_sets(texts, k))
            size, ids, texts = 0, [], []
    if ids:
        yield from zip(ids, shingle_sets(texts, k))
