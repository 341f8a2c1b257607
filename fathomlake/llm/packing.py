"""Documents as pieces of token ids, packed into sequences by vector best-fit.

Tokenizing: white-space runs are encoded once per worker and kept as packed 32-bit ids. Plain words go to a byte-level
encoder built from the same file: a word's end is a byte MARK whose merges with the byte before it come first, all
others keep their ranks. It merges any two tokens whose joined bytes are a token, which is the file's own result, as
each of its tokens is what its own characters merge to (tests check that). The rest goes to the library. A document's
ids, closed by END, are cut only where they exceed the sequence length.

Packing: pieces are dealt evenly, by a hash of a row number, into groups of about GROUP_ROWS pieces, as many groups as
the input needs; a group is packed in one task. Each open sequence has three residual capacities: tokens, documents and
attention cost. Cost is counted in attention tiles: a piece attends to itself in blocks of a SIDE-th of the sequence,
and its last, partly filled block costs as much as a full one, so many short pieces can use up this capacity before
the tokens are used up. A piece, the longest first, goes to the sequence where, under
every constraint, the weighted norm of what would remain is least ("norm") or the weighted dot product of its demand
with what is there is greatest ("dot"). Sequences with the same three residuals are interchangeable and scored once;
all distinct residuals are scored for each piece.
"""

from __future__ import annotations

import json
import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORKER_CACHES, BoundedCache, mapped, saved, sliced
from .token_counts import tokenizer
from .word_bpe import LATIN, TAIL, byte_symbols, runs

END = 0
MARK = "\0"
CACHE_LIMIT = 1 << 18
GROUP_ROWS = 50_000
WEIGHTS = (1.0, 1e-3, 1e-3)
#: A sequence's length is this many attention tiles; a full piece costs the square of it.
SIDE = 16
#: What a sequence may hold unless told otherwise: a document for so many tokens, and the tiles of this many full pieces.
TOKENS_A_DOCUMENT, FULL_PIECES = 8, 1.25

_caches: dict[str, BoundedCache] = {}
_encoders: dict[str, tuple[tiktoken.Encoding, np.ndarray]] = {}
WORKER_CACHES.extend((_caches, _encoders))


def word_encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder of marked words, and for each id whether it ends a word; once for each worker."""
    if path not in _encoders:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, byte = model["end_of_word_suffix"], {c: b for b, c in enumerate(byte_symbols())}
        ranks, ends = {}, np.zeros(max(model["vocab"].values()) + 1, bool)
        for token, i in model["vocab"].items():
            ends[i] = token.endswith(suffix)
            ranks[bytes(byte[c] for c in token.removesuffix(suffix)) + MARK.encode() * int(ends[i])] = i
        _encoders[path] = (tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={}), ends)
    return _encoders[path]


def encoded_words(words: list[str], path: str) -> list[bytes]:
    """Packed ids of words without white space or MARK, as they stand."""
    encoder, ends = word_encoder(path)
    ids = np.array(encoder.encode_ordinary(" ".join([w + MARK for w in words])), np.uint32)
    data, cuts = ids.tobytes(), [0, *(4 * (np.flatnonzero(ends[ids]) + 1)).tolist()]
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def packed_ids(library, path: str, chunks: list[str]) -> list[bytes]:
    """Ids of white-space-free chunks as 32-bit words. Spellings that differ in case or in closing marks share their word's encoding.

    The file's pattern takes letters and marks apart, and none of TAIL begins a contraction or a special string, so a
    chunk of letters and such marks has the ids of both in turn.
    """
    plan, plain, other = [], {}, {}
    for chunk in chunks:
        stem = chunk.lower()
        if stem.isalpha():
            mark = ""
        else:
            low, stem = stem, stem.rstrip(TAIL)
            mark = low[len(stem) :]
        if (stem.isalpha() or not stem and mark) and (chunk.isascii() or max(chunk) <= LATIN):
            plain[stem] = other[mark] = b""
        else:
            stem, mark = chunk, ""
            other[stem] = b""
        plan.append((stem, mark))
    plain.pop("", None)
    other.pop("", None)
    found = dict(zip(plain, encoded_words(list(plain), path))) if plain else {}
    found |= {c: array("I", e.ids).tobytes() for c, e in zip(other, library.encode_batch(list(other), add_special_tokens=False))}
    found[""] = b""
    return [found[stem] + found[mark] for stem, mark in plan]


def pieces(docs: DataFrame, path: str, length: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of at most `length` tokens; null and empty texts are END alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library = tokenizer(path)[0]
        cache = _caches.setdefault(path, BoundedCache(CACHE_LIMIT))
        end = array("I", [END]).tobytes()
        for batch in sliced(batches):
            chunks = [runs(text) for text in batch["text"]]
            if missing := cache.missing(set().union(*chunks)):
                cache.update(zip(missing, packed_ids(library, path, missing)))
            rows = []
            for doc_id, own in zip(batch["doc_id"], chunks):
                ids = b"".join(map(cache.__getitem__, own)) + end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(docs, run, "piece int, start long, length long, ids_crc32 long")


def tiles(n: int, length: int) -> int:
    """Attention cost of a piece of n tokens in a sequence of `length`."""
    return (-(-n // max(1, length // SIDE))) ** 2


def best_fit(lengths: list[int], tokens: int, documents: int, cost: int, rule: str = "norm", weights: tuple = WEIGHTS) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece; ties go to the smallest residuals."""
    state = np.zeros((3, 64), np.int64)  # of each distinct residual: tokens, documents, cost
    open_there: list[list[int]] = []  # the sequences that have it
    where: dict[tuple[int, int, int], int] = {}
    scale = np.array(weights) / (tokens, documents, cost)
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    opened = 0

    def take(k: int) -> tuple[tuple[int, int, int], int]:
        """A sequence of the k-th residual; the last residual moves to its place once it has no other."""
        own = tuple(state[:, k].tolist())
        sequence = open_there[k].pop()
        if not open_there[k]:
            del where[own]
            last = len(open_there) - 1
            if k < last:
                state[:, k], open_there[k] = state[:, last], open_there[last]
                where[tuple(state[:, k].tolist())] = k
            open_there.pop()
        return own, sequence

    def put(own: tuple[int, int, int], sequence: int) -> None:
        nonlocal state
        if own not in where:
            k = where[own] = len(open_there)
            open_there.append([])
            if k == state.shape[1]:
                state = np.concatenate([state, np.zeros_like(state)], axis=1)
            state[:, k] = own
        open_there[where[own]].append(sequence)

    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[i]
        demand = np.array([n, 1, tiles(n, tokens)])
        left = state[:, : len(open_there)]
        fits = np.flatnonzero((left >= demand[:, None]).all(axis=0))
        if len(fits):
            if rule == "norm":
                score = (((left[:, fits] - demand[:, None]) * scale[:, None]) ** 2).sum(axis=0)
            else:
                score = -((left[:, fits] * (demand * scale**2)[:, None]).sum(axis=0))
            best = fits[score == score.min()]
            best = min(best, key=lambda k: tuple(state[:, k])) if len(best) > 1 else best[0]
            own, sequence = take(int(best))
        else:
            own, sequence = (tokens, documents, cost), opened
            opened += 1
        placed[i] = (sequence, tokens - own[0])
        rest = tuple((np.array(own) - demand).tolist())
        if min(rest) > 0:
            put(rest, sequence)
    return placed


def pack(parts: DataFrame, length: int = 2048, documents: int | None = None, cost: int | None = None, rule: str = "norm", group_rows: int = GROUP_ROWS) -> DataFrame:
    """`parts` (of pieces()) with sequence_id and offset; every piece is in exactly one sequence, without gaps.

    `documents` and `cost` (attention tiles) bound a sequence beside `length`; unset, a sequence may hold a document for
    each TOKENS_A_DOCUMENT tokens and the tiles of FULL_PIECES full pieces. A cost that is too low for a full
    piece would make it infeasible and is refused. An empty table gives an empty result.
    """
    documents, cost = documents or max(1, length // TOKENS_A_DOCUMENT), cost or int(FULL_PIECES * tiles(length, length))
    if cost < tiles(length, length):
        raise ValueError("cost must allow a full piece")
    kind = parts.schema["doc_id"].dataType
    parts = saved(parts.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("row_", F.monotonically_increasing_id()), "pieces")
    groups = max(1, math.ceil(parts.count() / group_rows))

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("row_", ignore_index=True)
        at = best_fit(own["length"].tolist(), length, documents, cost, rule)
        own["sequence_id"] = [(int(key[0]) << 32) + s for s, _ in at]
        own["offset"] = [o for _, o in at]
        return own[names]

    schema = parts.drop("row_").schema.add("sequence_id", "long").add("offset", "long")
    names = schema.names
    packed = parts.groupBy(F.pmod(F.xxhash64("row_"), F.lit(groups)).alias("group_")).applyInPandas(run, schema)
    return packed.withColumn("doc_id", F.col("doc_id").cast(kind))


def pack_documents(docs: DataFrame, path: str, length: int = 2048, **limits) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of every document."""
    return pack(pieces(docs, path, length), length, **limits)
