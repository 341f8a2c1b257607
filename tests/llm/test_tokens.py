"""Token counts, encoding and packing against the library itself, on awkward texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fathomlake.llm import packing, token_counts, word_bpe

AWKWARD = [
    None, "", " ", "  \n ", "a", "a  b", "a \n\n b ", "x\x1cy \x1f", "<|endoftext|>", "a <|endoftext|> b", "q<|endoftext|>\n<|startoftext|>r",
    "it's WE'LL İstanbul ΑΣ Σ ß ſ", "café café", "naïve\xa0non breaking", "1234 ²½ 中文字符", "😀😀 ‍", "a" * 5000, "word " * 3000, "퟿\U00016a3b",
]


def documents(spark):
    rng = random.Random(5)
    letters = "abcXYZ'é́Σİ0²<|endoftext|>$ \n\t\x1c\xa0😀ß.!中"
    rows = AWKWARD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows += rows[-5:]
    return rows, spark.createDataFrame([(i if i % 7 else None, t, 1, "clash") for i, t in enumerate(rows)], "doc_id long, text string, piece int, n_tokens string").repartition(3)


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows, docs = documents(spark)
    library = Tokenizer.from_file(path)
    want = sorted((i if i % 7 else -1, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 20) for i, t in enumerate(rows))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, path, limit=20, hot_chunks=16).collect())
    assert got == want
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_encode_and_decode_equal_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows, docs = documents(spark)
    library = Tokenizer.from_file(path)
    want = []
    for i, t in enumerate(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i if i % 7 else -1, len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)))
    got = word_bpe.encode_decode(docs, path, keep=True).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, " ".join(map(str, r.ids)), r.decoded) for r in got) == sorted(want)
    assert all(r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() for r in got)
    assert all(r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() for r in got)
    assert word_bpe.encode_decode(docs.limit(0), path).count() == 0
    decode = word_bpe.WordBpe(path).decode
    assert all(decode(r.ids) == r.decoded for r in got)
    assert decode([5, 10**9, 320]) == library.decode([5, 320], skip_special_tokens=False)


@pytest.mark.parametrize("limits", [{}, {"documents": 3}, {"rule": "dot", "documents": 16}, {"group_rows": 40, "cost": 260}])
def test_pieces_are_packed_whole(spark, limits):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows, docs = documents(spark)
    library = Tokenizer.from_file(path)
    want = []
    for i, t in enumerate(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i if i % 7 else -1, k, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    got = packing.pack_documents(docs, path, 64, **limits).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 64 and len(own) <= limits.get("documents", 8) and sum(packing.tiles(n, 64) for _, n in own) <= limits.get("cost", 320)
    if not limits:
        assert len(bins) <= 1.05 * max(sum(w[3] for w in want) / 64, len(want) / 8) + 1
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_marked_words_encode_as_the_library_does():
    path = public_tokenizers.path("word_bpe_49k.json")
    bpe, library = word_bpe.WordBpe(path), Tokenizer.from_file(path)
    assert all(bpe.reachable(t) for t in bpe.vocab if t not in bpe.special)
    rng = random.Random(8)
    pieces = [t.removesuffix(bpe.suffix) for t in bpe.vocab if t.isascii() and t.removesuffix(bpe.suffix).isalpha() and t.islower()]
    words = sorted({"".join(rng.choice(pieces) for _ in range(rng.randint(1, 3))) for _ in range(20_000)} | {"été", "größe", "ñandú", "x", "."})
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(words, add_special_tokens=False)]
    assert packing.encoded_words(words, path) == want


def plain_best_fit(lengths, tokens, documents, cost, rule, weights=packing.WEIGHTS):
    """Every open sequence scored for every piece."""
    bins, placed = [], {}
    scale = np.array(weights) / (tokens, documents, cost)
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        demand = np.array([lengths[i], 1, packing.tiles(lengths[i], tokens)])
        best = None
        for k, left in enumerate(bins):
            if (left >= demand).all():
                score = (((left - demand) * scale) ** 2).sum() if rule == "norm" else -(left * (demand * scale**2)).sum()
                if best is None or (score, tuple(left)) < best[:2]:
                    best = (score, tuple(left), k)
        if best is None:
            bins.append(np.array([tokens, documents, cost]))
            best = (0, (), len(bins) - 1)
        placed[i] = tuple(bins[best[2]])
        bins[best[2]] = bins[best[2]] - demand
    return placed, sorted(map(tuple, bins))


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize(("documents", "cost"), [(1000, 10_000), (6, 10_000), (1000, 256), (9, 280)])
def test_best_fit_equals_a_plain_scan_under_capacities_that_bind(rule, documents, cost):
    rng = random.Random(documents + cost)
    lengths = [rng.choice([rng.randint(1, 9), rng.randint(100, 300), rng.randint(1, 1024)]) for _ in range(500)]
    got = packing.best_fit(lengths, 1024, documents, cost, rule, (1.0, 0.4, 0.3))
    want, left = plain_best_fit(lengths, 1024, documents, cost, rule, (1.0, 0.4, 0.3))
    bins = {}
    for i, (sequence, offset) in enumerate(got):
        assert offset == 1024 - want[i][0]
        bins.setdefault(sequence, []).append(lengths[i])
    have = sorted((1024 - sum(b), documents - len(b), cost - sum(packing.tiles(n, 1024) for n in b)) for b in bins.values())
    assert have == left
    if documents < 1000:
        assert any(d == 0 and t > 0 for t, d, _ in have)
    if cost == 256:
        assert any(c == 0 and t > 0 for t, _, c in have)
