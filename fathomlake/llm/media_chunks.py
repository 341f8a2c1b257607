"""Media columns as deduplicated, content-defined chunks, and media rebuilt from them and verified.

A text's payload is its UTF-8, padded with zero bytes to a positive multiple of 64, and its media is that payload as
8-bit samples in a WAV file. The payload is cut where a rolling gear hash of the last 32 bytes has its top bits zero,
so equal passages give equal chunks wherever they stand.

1. Manifests: each row's chunk digests and sizes, without bytes.
2. Owners: by a join on digests, each chunk belongs to the smallest doc_id that has it; the others refer to it. Digests
   that more than one in HOT_SHARES of all references have are at most HOT_SHARES; they are joined by broadcast, so
   that no task gets all documents that share a passage.
3. Store: each row again, with the bytes (compressed) of the chunks that it owns and no others.
4. Rebuilding: rows that own all their chunks need no join. For the others, chunks are fetched by digest (the hot ones
   once a worker, by broadcast), and the ordered list puts them together. Every rebuilt media is checked against its manifest's digest.

A row without doc_id can't be referred to: it owns whatever it has. Null and empty texts have 64 zero bytes. Repeated
rows are stored and rebuilt each; rows with the same doc_id and other texts share ownership.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, sliced, texts

MIN_CHUNK, MAX_CHUNK, CUT_BITS = 1024, 16384, 12
RATE = 8000
#: Up to so many references (of some 30 bytes) are broadcast to the rows; beyond, they are joined by shuffle.
BROADCAST_REFERENCES = 1_000_000
#: Bound of the hot digests; their chunks, of MAX_CHUNK bytes each at most, come to 32 MB.
HOT_SHARES = 2_000


def gear_table() -> np.ndarray:
    """256 pseudo-random words by the splitmix64 rule from a fixed seed."""
    words, state = [], 0x5EED
    for _ in range(256):
        state = (state + 0x9E3779B97F4A7C15) % (1 << 64)
        z = (state ^ (state >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB % (1 << 64)
        words.append((z ^ (z >> 31)) >> 32)
    return np.array(words, np.uint32)


GEAR = gear_table()


def payload(text: str) -> bytes:
    data = text.encode()
    return data + bytes(-len(data) % 64 if data else 64)


def wav_header(n: int) -> bytes:
    """Mono, 8-bit PCM: n samples follow."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def cut_points(payloads: list[bytes]) -> list[list[int]]:
    """Ends of each payload's chunks. No cut lies in a chunk's first MIN_CHUNK bytes, so no window reaches into another payload."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):  # h[i] becomes the sum of gear[data[i - k]] << k over the last 2 * shift bytes
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift)) if len(h) > shift else h[shift:]
    candidates = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    found, begin = [], 0
    for p in payloads:
        end, at, cuts = begin + len(p), begin, []
        while end - at > MIN_CHUNK:
            k = np.searchsorted(candidates, at + MIN_CHUNK)
            cut = int(candidates[k]) if k < len(candidates) else end
            at = min(cut, at + MAX_CHUNK, end)
            cuts.append(at - begin)
        if at < end:
            cuts.append(end - begin)
        found.append(cuts)
        begin = end
    return found


def chunked(batch: pd.DataFrame) -> Iterator[tuple[bytes, list[bytes], list[bytes]]]:
    """Of each row: the payload, its chunks and their digests."""
    payloads = [payload(t) for t in batch["text"]]
    for p, cuts in zip(payloads, cut_points(payloads)):
        chunks = [p[a:b] for a, b in zip([0, *cuts], cuts)]
        yield p, chunks, [hashlib.sha256(c).digest()[:16] for c in chunks]


def feature(samples: np.ndarray) -> str:
    """Mean, root mean square about the middle, zero crossings and entropy of 8-bit samples."""
    x = samples.astype(np.float64) - 128
    p = np.bincount(samples, minlength=256) / len(samples)
    p = p[p > 0]
    sign = x >= 0
    return f"mean={x.mean():.6f};rms={np.sqrt((x * x).mean()):.6f};crossings={np.count_nonzero(sign[1:] != sign[:-1])};entropy={-(p * np.log2(p)).sum() + 0.0:.6f}"


def _rows(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("string"))


def references(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, owner) of the chunks that a row has and another document owns."""

    def manifest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches):
            yield pd.DataFrame({"doc_id": batch["doc_id"], "digests": [sorted(set(d)) for _, _, d in chunked(batch)]})

    chunks = _rows(docs).where("doc_id IS NOT NULL").mapInPandas(manifest, "doc_id string, digests array<binary>")
    chunks = chunks.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode("digests").alias("digest"))
    chunks = saved(chunks.distinct(), "chunk-refs")
    owners = chunks.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).where("n > 1")
    hot = F.broadcast(owners.where(F.col("n") > chunks.count() / HOT_SHARES).select("digest", "owner"))
    cold = owners.where(F.col("n") <= chunks.count() / HOT_SHARES).select("digest", "owner")
    owned = chunks.join(hot, "digest").unionByName(chunks.join(hot, "digest", "left_anti").join(cold, "digest"))
    return saved(owned.where("doc_id <> owner"), "chunk-owners")


def store(docs: DataFrame, foreign: DataFrame) -> DataFrame:
    """The chunk store: of each row doc_id, n_bytes, media_sha256, digests in order, and the bytes that it owns."""
    lists = foreign.groupBy("doc_id").agg(F.collect_set("digest").alias("foreign"))
    if foreign.limit(BROADCAST_REFERENCES + 1).count() <= BROADCAST_REFERENCES:
        lists = F.broadcast(lists)
    lists = lists.withColumn("doc_id", F.col("doc_id").cast("string"))
    rows = _rows(docs).join(lists, "doc_id", "left").select("doc_id", "text", F.coalesce("foreign", F.array().cast("array<binary>")).alias("foreign"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=6).compress
        for batch in sliced(batches):
            out = []
            for doc_id, text, foreign, (p, chunks, digests) in zip(batch["doc_id"], batch["text"], batch["foreign"], chunked(batch)):
                theirs = {bytes(d) for d in foreign}
                own = {d: c for d, c in zip(digests, chunks) if d not in theirs}
                sha = hashlib.sha256(wav_header(len(p)) + p).hexdigest()
                out.append((doc_id, len(text.encode()), len(p), sha, digests, len(theirs), [{"digest": d, "bytes": pack(c)} for d, c in own.items()]))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "payload_bytes", "media_sha256", "digests", "n_foreign", "own"])

    kinds = "doc_id string, n_bytes long, payload_bytes long, media_sha256 string, digests array<binary>, n_foreign int, own array<struct<digest:binary,bytes:binary>>"
    return saved(rows.mapInPandas(write, kinds), "chunk-store")


def rebuilt(stored: DataFrame, foreign: DataFrame) -> tuple[DataFrame, dict[bytes, bytes]]:
    """`stored` with a column of all chunks that a row needs, its own and those fetched by digest; and the hot chunks, which no row carries."""
    counts = saved(foreign.groupBy("digest").count(), "digest-counts")
    hot = F.broadcast(counts.where(F.col("count") > foreign.count() / HOT_SHARES).select("digest"))
    complete = stored.where("n_foreign = 0").withColumn("chunks", F.col("own"))
    shared = counts.select("digest")
    if shared.limit(BROADCAST_REFERENCES + 1).count() <= BROADCAST_REFERENCES:
        shared = F.broadcast(shared)  # so that the bytes of chunks that nobody refers to stay where they are
    bytes_of = stored.select(F.explode("own").alias("c")).select("c.digest", "c.bytes").join(shared, "digest", "left_semi").dropDuplicates(["digest"])
    bytes_of = saved(bytes_of, "shared-chunks")
    common = {bytes(r["digest"]): bytes(r["bytes"]) for r in bytes_of.join(hot, "digest", "left_semi").collect()}  # HOT_SHARES rows at most
    cold = foreign.join(hot, "digest", "left_anti").join(bytes_of, "digest")
    fetched = cold.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.collect_list(F.struct("digest", "bytes")).alias("fetched"))
    partial = stored.where("n_foreign > 0").join(fetched, "doc_id", "left").withColumn("chunks", F.concat("own", F.coalesce("fetched", F.array().cast("array<struct<digest:binary,bytes:binary>>")))).drop("fetched")
    return complete.unionByName(partial), common


def media_features(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks.

    Everything but n_bytes and n_chunks is computed from media rebuilt from the store; a media whose digest is not its
    manifest's stops the job.
    """
    kind = docs.schema["doc_id"].dataType
    foreign = references(docs)
    rows, common = rebuilt(store(docs, foreign), foreign)
    hot = docs.sparkSession.sparkContext.broadcast(common)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                by_digest = {bytes(c["digest"]): c["bytes"] for c in r.chunks}
                media = wav_header(r.payload_bytes) + b"".join(unpack(by_digest.get(bytes(d)) or hot.value[bytes(d)]) for d in r.digests)
                sha = hashlib.sha256(media).hexdigest()
                if sha != r.media_sha256:
                    raise ValueError(f"media of document {r.doc_id} is not what was stored: {sha}")
                p = media[44:]
                out.append((r.doc_id, r.n_bytes, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), sha, feature(np.frombuffer(p, np.uint8)), len(r.digests)))
            yield pd.DataFrame(out, columns=names)

    kinds = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"
    names = [c.split()[0] for c in kinds.split(", ")]
    return rows.mapInPandas(read, kinds).withColumn("doc_id", F.col("doc_id").cast(kind))
