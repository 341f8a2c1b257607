"""Token counts without shuffling pre-tokens: a broadcast table of frequent chunks, then worker caches.

A chunk is a run of white space with the run of other characters after it (or the white space at the end of a text).
The library's pattern never joins what follows white space to what stands before it, and its look-ahead stays inside a
run of white space, so a text's tokens are its chunks' tokens in order. Special strings have no white space in them,
so each lies within one chunk, where the library finds it.

Tier 1: a hash table of frequent chunks and their token counts, broadcast (at most HOT_CHUNKS). It is filled from about
SAMPLE_ROWS documents, taken by chance; it decides what is looked up quickly and no count.
Tier 2: each worker's bounded cache; what is in neither is encoded by the library, once per batch and chunk.
No chunk of the documents at large is shuffled: only what the sample's chunks come to, which its bound bounds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORKER_CACHES, BoundedCache, mapped, sliced, texts

#: White space as Unicode has it, and as the tokenizers' patterns have it: without U+001C to U+001F.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
HOT_CHUNKS = 1 << 16
#: Documents that the table of frequent chunks is filled from, and chunks that a task of theirs passes on.
SAMPLE_ROWS, TASK_CHUNKS = 20_000, 1 << 14
#: Entries of a worker's counter or cache.
COUNTER_LIMIT = 1 << 19
CACHE_LIMIT = 1 << 19

_workers: dict[str, tuple] = {}
WORKER_CACHES.extend((_workers,))


def tokenizer(path: str):
    """The library's tokenizer for a file, once for each worker."""
    if path not in _workers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _workers[path] = (t, BoundedCache(CACHE_LIMIT))
    return _workers[path]


def _frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's most frequent chunks by lossy counting: entries that stay at one count go whenever the counter is full."""
    counts: Counter = Counter()
    for batch in batches:
        for text in batch["text"]:
            counts.update(CHUNK.findall(text))
        floor = 1
        while len(counts) > COUNTER_LIMIT:
            counts = Counter({k: v for k, v in counts.items() if v > floor})
            floor *= 2
    top = counts.most_common(TASK_CHUNKS)
    yield pd.DataFrame(top, columns=["chunk", "n"])


def hot_table(docs: DataFrame, path: str, size: int = HOT_CHUNKS) -> dict[str, int]:
    """Token counts of the chunks that are most frequent in a sample of rows, at most `size` of them; one that the sample has once is not frequent.

    Each row is taken by chance, whatever its id and text, so there are about SAMPLE_ROWS rows in any table.
    """
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    sample = texts(docs).select("text").sample(False, share, 7)
    found = sample.mapInPandas(_frequent, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n")).where("n > 1")
    chunks = [r["chunk"] for r in found.orderBy(F.desc("n"), "chunk").limit(size).collect()]
    encoded = tokenizer(path)[0].encode_batch(chunks, add_special_tokens=False)
    return {c: len(e.ids) for c, e in zip(chunks, encoded)}


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, hot_chunks: int = HOT_CHUNKS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of `docs`.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null doc_ids give a row each; other columns are
    ignored; an empty table gives an empty result.
    """
    hot = docs.sparkSession.sparkContext.broadcast(hot_table(docs, path, hot_chunks))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library, cache = tokenizer(path)
        frequent = hot.value
        for batch in sliced(batches):
            chunks = [CHUNK.findall(text) for text in batch["text"]]
            rare = set().union(*chunks).difference(frequent)
            if missing := cache.missing(rare):
                cache.update(zip(missing, map(len, library.encode_batch(missing, add_special_tokens=False))))
            n = [sum(frequent[c] if c in frequent else cache[c] for c in own) for own in chunks]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": [len(t.encode()) for t in batch["text"]], "n_tokens": n})

    return mapped(docs, count, "n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
