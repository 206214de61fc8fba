from __future__ import annotations

import hashlib
import random
import struct
import zlib

import pytest

from millrace.llm import flac


@pytest.mark.parametrize("size", [1, 15, 16, 17, 191, 192, 1151, 1152, 1153, 4000])
def test_round_trip(size):
    rng = random.Random(size)
    payloads = [bytes(rng.randrange(256) for _ in range(size)), b"a" * size, bytes((i * 3) % 256 for i in range(size)), bytes(rng.choice(b"the cat ") for _ in range(size))]
    streams = flac.encode(payloads)
    assert flac.decode(streams) == payloads
    assert [flac.encode([p])[0] for p in payloads] == streams


def test_damage_is_found():
    stream = flac.encode([b"some text that is long enough to have codes in it " * 30])[0]
    first = flac._metadata(stream)[2]
    for at in (first + 1, first + 5, first + 60, len(stream) - 1):
        bad = bytearray(stream)
        bad[at] ^= 0x10
        with pytest.raises((ValueError, StopIteration, IndexError)):
            flac.decode([bytes(bad)])


def test_seek_points():
    payload = bytes(i % 251 for i in range(3000))
    info, points, first = flac._metadata(flac.encode([payload])[0])
    assert info["samples"] == 3000 and info["bits"] == 8
    assert [p[0] for p in points] == [0, 1152, 2304] and [p[2] for p in points] == [1152, 1152, 696]


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, width):
        self.bits += format(value & ((1 << width) - 1), f"0{width}b") if width else ""

    def rice(self, value, k):
        u = value << 1 if value >= 0 else (-value << 1) - 1
        self.bits += "0" * (u >> k) + "1"
        self.put(u, k)


def by_hand(samples, bits, order, partitions, wide, escape=False):
    """A stream of one frame with Rice partitions, written bit by bit, without a seek table."""
    n = len(samples)
    head = bytes((0xFF, 0xF8, 0x74, {8: 2, 16: 8}[bits], 0)) + struct.pack(">H", n - 1)
    w = Writer()
    w.put((8 + order) << 1, 8)
    for s in samples[:order]:
        w.put(s, bits)
    w.put(int(wide == 5), 2)
    w.put(partitions, 4)
    size = n >> partitions
    residual = [samples[i] - sum(c * samples[i - 1 - j] for j, c in enumerate(flac._FIXED[order])) for i in range(order, n)]
    for p in range(1 << partitions):
        part = residual[max(0, p * size - order) : (p + 1) * size - order]
        if escape and p % 2:
            w.put((1 << wide) - 1, wide)
            w.put(20, 5)
            for r in part:
                w.put(r, 20)
        else:
            w.put(3 + p, wide)
            for r in part:
                w.rice(r, 3 + p)
    w.bits += "0" * (-len(w.bits) % 8)
    frame = head + bytes((flac.crc8(head),)) + int(w.bits, 2).to_bytes(len(w.bits) // 8, "big")
    crc = 0
    for b in frame:
        crc = (crc << 8 & 0xFFFF) ^ int(flac._CRC16[(crc >> 8) ^ b])
    info = struct.pack(">HH", n, n) + bytes(6) + (8000 << 44 | (bits - 1) << 36 | n).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame + struct.pack(">H", crc)


@pytest.mark.parametrize(("order", "partitions", "wide", "escape"), [(0, 0, 4, False), (1, 2, 4, False), (2, 3, 5, False), (3, 1, 4, True), (4, 2, 5, True)])
def test_foreign_streams(order, partitions, wide, escape):
    rng = random.Random(order)
    for bits in (8, 16):
        top = 1 << (bits - 1)
        samples = [rng.randrange(-top, top) >> rng.randrange(4) for _ in range(256)]
        raw = flac.decode([by_hand(samples, bits, order, partitions, wide, escape)])[0]
        got = [b - 128 for b in raw] if bits == 8 else list(struct.unpack(f"<{len(raw) // 2}h", raw))
        assert got == samples


def test_digests(documents, odd_documents, no_documents):
    truth = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    for r in flac.media_digests(documents).collect():
        payload = truth[r.doc_id] + b" " * (-len(truth[r.doc_id]) % 192)
        assert (r.n_bytes, r.payload_bytes) == (len(truth[r.doc_id]), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
    rows = flac.media_digests(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    empty = {tuple(r)[1:] for r in rows if r.doc_id in (3, 4)}
    assert len(empty) == 1 and next(iter(empty))[:2] == (0, 192)
    assert len({r for r in rows if r.doc_id == 1}) == 1
    assert flac.media_digests(no_documents).count() == 0


def test_blocks(documents):
    docs = documents.limit(5)
    texts = {r.doc_id: flac.payload_of(r.text.encode()) for r in docs.collect()}
    media = flac.encode_media(docs)
    parts = {}
    for r in flac.pcm_blocks(media).collect():
        parts.setdefault(r.doc_id, {})[r.sample_offset] = bytes(r.pcm)
        assert len(r.pcm) == r.n_samples
    assert {d: b"".join(x for _, x in sorted(p.items())) for d, p in parts.items()} == texts
