"""Exact round trips through the chunk store."""

import hashlib
import random
import wave
import zlib
from io import BytesIO

import numpy as np
import pytest

from fathomlake.llm import media_chunks as m


@pytest.mark.parametrize("shares", [1, 4, 2_000])  # no digest is hot, some are, all are
def test_round_trip_and_sharing(spark, monkeypatch, shares):
    monkeypatch.setattr(m, "HOT_SHARES", shares)
    rng = random.Random(4)
    passage = " ".join(rng.choice(["alpha", "béta", "gamma", "delta"]) + str(rng.randint(0, 9999)) for _ in range(6000))
    rows = [None, "", "a", "é" * 32, "x" * 63, "x" * 64, "x" * 65, passage, passage, "other start " * 50 + passage + " other end", "z" * 100_000]
    docs = spark.createDataFrame([(i if i != 6 else None, t, 0) for i, t in enumerate(rows)] + [(2, "a", 0)], "doc_id long, text string, digest int").repartition(3)
    got = m.media_features(docs).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        text = (rows[6] if r.doc_id is None else rows[r.doc_id]) or ""
        p = text.encode() + bytes(64 if not text else -len(text.encode()) % 64)
        media = m.wav_header(len(p)) + p
        with wave.open(BytesIO(media)) as w:
            assert (w.getsampwidth(), w.readframes(w.getnframes())) == (1, p)
        want = (len(text.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest(), m.feature(np.frombuffer(p, np.uint8)))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) == want
    by_id = {r.doc_id: r for r in got}
    assert by_id[7].n_chunks > 5 and by_id[7].asDict() | {"doc_id": 8} == by_id[8].asDict()
    own = {r.doc_id: len(r.own) for r in m.store(docs, m.references(docs)).collect()}
    assert own["7"] == by_id[7].n_chunks and own["8"] == 0 and 0 < own["9"] < by_id[9].n_chunks / 2
    assert m.media_features(docs.limit(0)).count() == 0


def test_cuts_follow_the_content():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    (a,), (b,) = m.cut_points([data]), m.cut_points([b"inserted" + data])
    assert a[-1] == len(data) and all(m.MIN_CHUNK < y - x <= m.MAX_CHUNK for x, y in zip(a, a[1:-1]))
    assert len({x + 8 for x in a} & set(b)) > 0.9 * len(a)
    assert m.cut_points([data[:5000], data]) == [m.cut_points([data[:5000]])[0], a]

    h = 0
    for x in data[:40]:
        h = ((h << 1) + int(m.GEAR[x])) % (1 << 32)
    g = m.GEAR[np.frombuffer(data[:40], np.uint8)]
    for shift in (1, 2, 4, 8, 16):
        g[shift:] = g[shift:] + (g[:-shift] << np.uint32(shift))
    assert int(g[-1]) == h
