"""Streams: round trips, the stepwise path against the scalar one, damage, and other encoders' frames."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from gaugeline.llm import flac


def payloads(seed):
    rnd = random.Random(seed)
    out = [bytes(rnd.choice([rnd.randrange(256), 120, 121, 122]) for _ in range(64 * rnd.randint(1, 150))) for _ in range(25)]
    out += [bytes(64), b"\xff" * 6400, bytes([0, 255]) * 3200, bytes(rnd.choice([100, 255, 0]) if rnd.random() < 0.01 else 128 for _ in range(12800))]
    return out + [bytes((128 + i // 40) % 256 for i in range(64 * 130))]


def scalar(stream):
    at, out = flac.metadata(stream).frames_at, []
    while at < len(stream):
        x, end = flac.decode_scalar(stream, at, 8)
        out += x
        at = end + 2
    return bytes(v + 128 for v in out)


@pytest.mark.parametrize("lpc", [None, ((1,), 5, 0), ((7, -3, 2), 6, 3)])
def test_round_trip(lpc):
    given = payloads(1)
    streams = flac.encode(given, lpc)
    back, spans = flac.decode(streams)
    assert back == given
    for s, p, blocks in zip(streams, given, spans, strict=True):
        assert scalar(s) == p
        assert [b[0] for b in blocks] == list(range(0, len(p), flac.BLOCK_SIZE))
        for first, n, at in blocks:  # any block can be read by its offset alone
            assert bytes(v + 128 for v in flac.decode_scalar(s, at, 8)[0]) == p[first : first + n]
        # Without the seek table frames are found one after the other.
        bare = s[:4] + b"\x80" + s[5:42] + s[flac.metadata(s).frames_at :]
        assert flac.decode([bare])[0] == [p]


def bits(*fields):
    v = n = 0
    for value, width in fields:
        v, n = v << width | value & (1 << width) - 1, n + width
    return (v << (-n % 8)).to_bytes((n + 7) // 8, "big")


def stream_of(body, n, samples):
    head = bytes([0xFF, 0xF8, 6 << 4 | 4, 2, 0, n - 1])
    frame = head + bytes([flac.crc8(head)]) + body
    import numpy as np

    raw = np.frombuffer(frame, dtype=np.uint8)
    frame += int(flac.crc16(raw, np.array([0]), np.array([len(frame)]))[0]).to_bytes(2, "big")
    info = n.to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | n).to_bytes(8, "big") + hashlib.md5(bytes(x & 255 for x in samples)).digest()
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame


def test_partitions_and_escapes():
    """A frame with two partitions, one Rice-coded and one of raw residuals; order 1."""
    samples = [3, 4, 6, 5, 5, 5, -9, 20]
    residuals = [b - a for a, b in zip(samples, samples[1:], strict=False)]
    fields = [(9 << 1, 8), (samples[0], 8), (0, 2), (1, 4), (1, 4)]
    for e in residuals[:3]:
        u = e << 1 ^ e >> 31
        fields += [(1, (u >> 1) + 1), (u & 1, 1)]
    fields += [(15, 4), (6, 5), *((e, 6) for e in residuals[3:])]
    assert flac.decode([stream_of(bits(*fields), 8, samples)])[0] == [bytes(x + 128 & 255 for x in samples)]


def test_damage_is_found():
    rnd = random.Random(3)
    streams = flac.encode(payloads(2))
    for _ in range(120):
        s = bytearray(rnd.choice(streams))
        at = flac.metadata(bytes(s)).frames_at
        s[rnd.randrange(at, len(s))] ^= 1 << rnd.randrange(8)
        with pytest.raises((ValueError, IndexError)):
            flac.decode([bytes(s)])


def test_documents(spark):
    texts = ["abc", None, "", "é" * 5000, "😀 word " * 900, "x" * 64, "x" * 64, "line\n" * 13]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = {r["doc_id"]: r for r in flac.media_digest(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["feature"] == flac.feature(payload)
    assert rows[5].asDict() | {"doc_id": 6} == rows[6].asDict()
    back = flac.pcm_blocks(flac.add_media(df)).orderBy("doc_id", "block").collect()
    for i, t in enumerate(texts):
        assert b"".join(r["pcm"] for r in back if r["doc_id"] == i).rstrip(b"\0") == (t or "").encode().rstrip(b"\0")
    assert flac.media_digest(df.limit(0)).count() == 0


def test_long_payloads_in_parts(monkeypatch):
    """A payload of many batches, and many payloads in one, have the same streams whatever the batch."""
    rnd = random.Random(12)
    given = [bytes(rnd.choices(b"abcde fgh\n", k=n)) for n in (70_000, 64, 4096, 9000)] + [b"\0" * 20_000, bytes(range(256)) * 40]
    want, facts = flac.encode(given), [flac.feature(p) for p in given]
    monkeypatch.setattr(flac, "BATCH_BYTES", 5000)
    assert flac.encode(given) == want and [flac.feature(p) for p in given] == facts
    back, spans = flac.decode(want)
    assert back == given and [sum(x[1] for x in s) for s in spans] == list(map(len, given))


def test_linear_predictors_are_chosen():
    """Samples that swing take a predictor of their own; smooth ones a fixed order above 1; all come back."""
    n = np.arange(8192)
    swing = (128 + 90 * np.sin(n * 2.1) + np.random.default_rng(1).integers(-2, 3, len(n))).astype(np.uint8).tobytes()
    smooth = (128 + 100 * np.sin(n / 50)).astype(np.uint8).tobytes()
    streams = flac.encode([swing, smooth])
    kinds = [[flac._head(s, m.frames_at + p[1]).kind for p in m.points] for s, m in zip(streams, map(flac.metadata, streams), strict=True)]
    assert set(kinds[0]) == {32 + flac.LPC_ORDER - 1} and all(k >= 10 for k in kinds[1])
    assert flac.decode(streams)[0] == [swing, smooth]
    for s, k in zip(streams, kinds, strict=True):
        m = flac.metadata(s)
        for p, first in zip(m.points, (0, 4096), strict=True):
            x, _ = flac.decode_scalar(s, m.frames_at + p[1], 8)
            assert bytes(v + 128 for v in x) == [swing, smooth][s is streams[1]][first : first + 4096]
