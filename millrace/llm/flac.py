"""Texts as FLAC media columns: encode, decode, seek, features (operator 5).

A text's bytes, filled up with spaces to a positive multiple of ``UNIT``, become 8-bit mono samples (byte - 128) of a
FLAC stream: STREAMINFO with the MD5 of the samples, a seek table with a point for each block, and fixed-size blocks.
A block's predictor is the cheapest of the fixed ones of order 0 to 2 and a quantised linear predictor; residuals are
Rice-coded.

The decoder reads constant, verbatim, fixed and linear-prediction subframes, Rice partitions of both parameter sizes
and escapes, for mono streams of up to 16 bits a sample. It checks every frame header's CRC-8 and every frame's CRC-16
and takes each frame's place from the seek table (or, without one, reads frame after frame). Frames of all streams of a
slice are coded in lockstep: step i handles sample i of every frame, so memory is bounded by the slice.

A null text is an empty text. Equal texts give equal streams.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import batch_slices, text_buffer

UNIT, BLOCK, RATE, LPC_ORDER, PRECISION = 192, 1152, 8000, 4, 10
_SLICE = 2 << 20
#: Coefficients of the fixed predictors, block sizes with a code of their own.
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
_SIZE_CODES = {192: 1, 576: 2, 1152: 3, 2304: 4, 4608: 5, 256: 8, 512: 9, 1024: 10, 2048: 11, 4096: 12}


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    top, mask, table = 1 << (bits - 1), (1 << bits) - 1, []
    for value in range(256):
        c = value << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ polynomial if c & top else c << 1) & mask
        table.append(c)
    return np.array(table, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CRC8_LIST = _CRC8.tolist()
#: Leading zeros of 16 bits.
_ZEROS = (16 - np.ceil(np.log2(np.arange(1 << 16) + 1))).astype(np.int64)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8_LIST[c ^ b]
    return c


def crc16_frames(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges, in lockstep over their bytes."""
    out = np.zeros(len(starts), np.uint16)
    order = np.argsort(-sizes, kind="stable")
    at, left, crc = starts[order], sizes[order], np.zeros(len(starts), np.uint16)
    longest = int(left[0]) if len(left) else 0
    active = np.searchsorted(-left, -np.arange(1, longest + 1), "right")
    for i in range(longest):
        n = active[i]
        c = crc[:n]
        crc[:n] = (c << np.uint16(8)) ^ _CRC16[(c >> np.uint16(8)) ^ data[at[:n] + i]]
    out[order] = crc
    return out


# ------------------------------------------------------------------------------------------------- encoding


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
    for b in range(width):
        bits[at + b] = (values >> (width - 1 - b)) & 1


def _linear(samples: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients and shifts of a linear predictor for each row. Sums are of integers, so that a row's
    result doesn't depend on its neighbours."""
    n = samples.shape[1]
    auto = np.stack([(samples[:, k:] * samples[:, : n - k]).sum(axis=1) for k in range(order + 1)], axis=1).astype(float)
    error = auto[:, 0] * (1 + 1e-9) + 1.0
    coefficients = np.zeros((len(samples), order))
    for i in range(order):  # Levinson-Durbin
        reflect = auto[:, i + 1].copy()
        for j in range(i):
            reflect -= coefficients[:, j] * auto[:, i - j]
        reflect /= error
        old = coefficients[:, :i].copy()
        for j in range(i):
            coefficients[:, j] = old[:, j] - reflect * old[:, i - 1 - j]
        coefficients[:, i] = reflect
        error = np.maximum(error * (1 - reflect * reflect), 1e-3)
    most = np.abs(coefficients).max(axis=1)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(np.maximum(most, 1e-9))).astype(np.int64), 0, 15)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(coefficients * np.exp2(shift)[:, None]), -limit - 1, limit).astype(np.int64), shift


def _residuals(samples: np.ndarray, coefficients: np.ndarray, shift: np.ndarray | int) -> np.ndarray:
    order = coefficients.shape[1]
    n = samples.shape[1]
    predicted = np.zeros((len(samples), n - order), np.int64)
    for j in range(order):
        predicted += coefficients[:, j : j + 1] * samples[:, order - 1 - j : n - 1 - j]
    return samples[:, order:] - (predicted >> (shift if isinstance(shift, int) else shift[:, None]))


def _folded(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 63)


def _encode_group(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of equal size: (bytes of all, size of each). samples: a row for each frame; numbers: their frame numbers."""
    m, n = samples.shape
    choices = [(o, np.tile(np.array(_FIXED[o], np.int64), (m, 1)).reshape(m, o), np.zeros(m, np.int64)) for o in range(3)]
    linear, shift = _linear(samples, LPC_ORDER)
    choices.append((LPC_ORDER, linear, shift))
    cost = np.stack([np.abs(_residuals(samples, c, s)).sum(axis=1) + 8 * o + (40 if k == 3 else 0) for k, (o, c, s) in enumerate(choices)], axis=1)
    pick = cost.argmin(axis=1)
    frames: list[bytes] = [b""] * m
    for k, (order, coefficients, shifts) in enumerate(choices):
        rows = np.flatnonzero(pick == k)
        if len(rows):
            for row, frame in zip(rows.tolist(), _encode_rows(samples[rows], numbers[rows], order, coefficients[rows], shifts[rows], k == 3), strict=True):
                frames[row] = frame
    sizes = np.array([len(f) for f in frames], np.int64)
    return np.frombuffer(b"".join(frames), np.uint8), sizes


def _encode_rows(samples: np.ndarray, numbers: np.ndarray, order: int, coefficients: np.ndarray, shift: np.ndarray, linear: bool) -> list[bytes]:
    m, n = samples.shape
    u = _folded(_residuals(samples, coefficients, shift))
    costs = np.stack([(u >> k).sum(axis=1) + u.shape[1] * (1 + k) for k in range(9)], axis=1)
    k = costs.argmin(axis=1)
    heads = [_frame_head(n, int(x)) for x in numbers.tolist()]
    head_bits = np.array([8 * len(h) for h in heads], np.int64)
    # subframe header, warm-up samples, predictor, residual header, then the codes
    fixed = 8 + 8 * order + (9 + PRECISION * order if linear else 0)
    body = head_bits + fixed
    code = (u >> k[:, None]) + 1 + k[:, None]
    ends = np.cumsum(code, axis=1)
    total_bits = body + 10 + ends[:, -1]
    sizes = (total_bits + 7) // 8 + 2
    base = np.concatenate(([0], np.cumsum(sizes)[:-1])) * 8
    bits = np.zeros(int(sizes.sum()) * 8, np.uint8)
    at = base + head_bits
    kind = (32 + order - 1) if linear else (8 + order)
    _put(bits, at, np.full(m, kind << 1), 8)
    at = at + 8
    for j in range(order):
        _put(bits, at, samples[:, j] & 255, 8)
        at = at + 8
    if linear:
        _put(bits, at, np.full(m, PRECISION - 1), 4)
        _put(bits, at + 4, shift, 5)
        at = at + 9
        for j in range(order):
            _put(bits, at, coefficients[:, j] & ((1 << PRECISION) - 1), PRECISION)
            at = at + PRECISION
    _put(bits, at + 6, k, 4)  # Rice coding with 4-bit parameters, one partition
    start = (base + body + 10)[:, None] + ends - code
    stop = start + (u >> k[:, None])
    bits[stop] = 1
    for b in range(int(k.max(initial=0))):  # bit b of the remainder, counted from its top
        rows = np.flatnonzero(k > b)
        bits[stop[rows] + 1 + b] = (u[rows] >> (k[rows, None] - 1 - b)) & 1
    data = np.packbits(bits)
    for i, h in enumerate(heads):
        a = int(base[i]) >> 3
        data[a : a + len(h)] = np.frombuffer(h, np.uint8)
    starts = base >> 3
    crc = crc16_frames(data, starts, sizes - 2)
    data[starts + sizes - 2], data[starts + sizes - 1] = crc >> 8, crc & 255
    raw = data.tobytes()
    return [raw[a : a + s] for a, s in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _frame_head(n: int, number: int) -> bytes:
    code = _SIZE_CODES.get(n, 7)
    head = bytes((0xFF, 0xF8, code << 4 | 4, 0x02)) + _utf8(number) + (struct.pack(">H", n - 1) if code == 7 else b"")
    return head + bytes((crc8(head),))


def _utf8(x: int) -> bytes:
    """A number in the extended UTF-8 of frame headers."""
    if x < 0x80:
        return bytes((x,))
    more = next(k for k in range(1, 7) if x < 1 << (6 - k + 6 * k))
    lead = 0xFF << (7 - more) & 0xFF | x >> (6 * more)
    return bytes([lead, *(0x80 | x >> (6 * k) & 0x3F for k in range(more - 1, -1, -1))])


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload (8-bit unsigned samples; not empty)."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    data = np.frombuffer(b"".join(payloads), np.uint8)
    signed = data.astype(np.int64) - 128
    counts = (sizes + BLOCK - 1) // BLOCK
    owner = np.repeat(np.arange(len(payloads)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.repeat(np.cumsum(sizes) - sizes, counts) + number * BLOCK
    length = np.minimum(BLOCK, np.repeat(sizes, counts) - number * BLOCK)
    frames: list[bytes] = [b""] * len(owner)
    for n in np.unique(length).tolist():
        rows = np.flatnonzero(length == n)
        if n < 16:  # too short for a block of its own kind: stored as it is
            for r in rows.tolist():
                head = _frame_head(n, int(number[r])) + b"\x02" + (signed[start[r] : start[r] + n] & 255).astype(np.uint8).tobytes()
                crc = int(crc16_frames(np.frombuffer(head, np.uint8), np.array([0]), np.array([len(head)]))[0])
                frames[r] = head + struct.pack(">H", crc)
            continue
        raw, each = _encode_group(signed[start[rows][:, None] + np.arange(n)], number[rows])
        body, ends = raw.tobytes(), np.cumsum(each)
        for r, a, b in zip(rows.tolist(), (ends - each).tolist(), ends.tolist(), strict=True):
            frames[r] = body[a:b]
    out, at = [], 0
    for payload, count in zip(payloads, counts.tolist(), strict=True):
        own = frames[at : at + count]
        at += count
        out.append(_stream_head(payload, own) + b"".join(own))
    return out


def _stream_head(payload: bytes, frames: list[bytes]) -> bytes:
    n, sizes = len(payload), [len(f) for f in frames]
    block = min(BLOCK, max(16, n))
    digest = hashlib.md5(payload.translate(_FLIP)).digest()
    info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8, "big") + digest
    points, offset = [], 0
    for i, size in enumerate(sizes):
        points.append(struct.pack(">QQH", i * BLOCK, offset, min(BLOCK, n - i * BLOCK)))
        offset += size
    seek = b"".join(points)
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek


#: Unsigned bytes to the bytes of the signed samples, and back.
_FLIP = bytes(b ^ 0x80 for b in range(256))


# ------------------------------------------------------------------------------------------------- decoding


@dataclass
class Frame:
    stream: int
    first: int  # sample
    size: int  # samples
    start: int  # byte in the buffer
    end: int
    order: int = 0
    shift: int = 0
    coefficients: tuple[int, ...] = ()
    warm: tuple[int, ...] = ()
    at: int = 0  # bit of the residual's first code
    partitions: int = 0
    wide: int = 4
    constant: int | None = None
    raw: bool = False
    bits: int = 8


def _metadata(stream: bytes) -> tuple[dict, list[tuple[int, int, int]], int]:
    """(STREAMINFO's fields, seek points, place of the first frame)."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, points, last = 4, {}, [], False
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = {"block": struct.unpack(">H", body[2:4])[0], "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & ((1 << 36) - 1), "md5": body[18:34]}
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
        at += 4 + size
    return info, points, at


class _Bits:
    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at

    def take(self, width: int) -> int:
        a, b = self.at >> 3, (self.at + width + 7) >> 3
        value = int.from_bytes(self.data[a:b], "big") >> (8 * (b - a) - (self.at & 7) - width)
        self.at += width
        return value & ((1 << width) - 1)

    def signed(self, width: int) -> int:
        value = self.take(width)
        return value - (1 << width) if value >> (width - 1) else value


def _read_head(data: bytes, frame: Frame, bits: int, block: int) -> None:
    """Parse a frame's header and its subframe's, up to the residual's codes."""
    a = frame.start
    if data[a] != 0xFF or data[a + 1] & 0xFE != 0xF8:
        raise ValueError("no frame where one is expected")
    code, sample_code, at = data[a + 2] >> 4, data[a + 3] >> 1 & 7, a + 4
    lead = data[at]
    extra = 0 if lead < 0x80 else next(k for k in range(1, 7) if not lead & (0x40 >> k))
    number = lead if not extra else int.from_bytes(bytes([lead & (0x3F >> extra)]), "big")
    for k in range(extra):
        number = number << 6 | data[at + 1 + k] & 0x3F
    at += 1 + extra
    if code == 6:
        size, at = data[at] + 1, at + 1
    elif code == 7:
        size, at = int.from_bytes(data[at : at + 2], "big") + 1, at + 2
    else:
        size = next(n for n, c in _SIZE_CODES.items() if c == code)
    at += {12: 1, 13: 2, 14: 2}.get(data[a + 2] & 15, 0)
    if data[at] != crc8(data[a:at]):
        raise ValueError("a frame header's CRC-8 doesn't match")
    frame.size, frame.first = size, (number if data[a + 1] & 1 else number * block)
    frame.bits = {1: 8, 2: 12, 4: 16}.get(sample_code, bits)
    read = _Bits(data, 8 * (at + 1))
    kind = read.take(8)
    if kind & 1:
        raise ValueError("wasted bits are not read")
    kind >>= 1
    if kind == 0:
        frame.constant, frame.end = read.signed(frame.bits), (read.at + 7) // 8
        return
    if kind == 1:
        frame.raw, frame.at = True, read.at
        return
    linear = kind >= 32
    frame.order = kind - 31 if linear else kind - 8
    frame.warm = tuple(read.signed(frame.bits) for _ in range(frame.order))
    if linear:
        precision = read.take(4) + 1
        frame.shift = read.signed(5)
        frame.coefficients = tuple(read.signed(precision) for _ in range(frame.order))
    else:
        frame.coefficients = _FIXED[frame.order]
    frame.wide = 5 if read.take(2) else 4
    frame.partitions = read.take(4)
    frame.at = read.at


def decode(streams: list[bytes]) -> list[bytes]:
    """The samples of each stream: as unsigned bytes if it has 8 bits a sample, else as little-endian int16."""
    parsed = [_metadata(s) for s in streams]
    buffer = b"".join(streams)
    base = np.concatenate(([0], np.cumsum([len(s) for s in streams]))).tolist()
    frames: list[Frame] = []
    for i, (info, points, first) in enumerate(parsed):
        if info["channels"] != 1 or info["bits"] > 16:
            raise ValueError("mono streams of up to 16 bits are read")
        covered = sum(p[2] for p in points)
        if covered == info["samples"]:
            places = [base[i] + first + p[1] for p in points]
            for a, b in zip(places, [*places[1:], base[i + 1]], strict=True):
                frames.append(Frame(i, 0, 0, a, b))
        else:  # no table of all blocks: one frame after the other
            at, got = base[i] + first, 0
            while got < info["samples"]:
                frame = Frame(i, 0, 0, at, base[i + 1])
                one = _decode_frames(buffer, [frame], parsed)
                frames.append(frame)
                at, got = frame.end, got + len(one[0])
    samples = _decode_frames(buffer, frames, parsed)
    out: list[list[np.ndarray]] = [[] for _ in streams]
    for frame, x in zip(frames, samples, strict=True):
        out[frame.stream].append(x)
    done = []
    for (info, _, _), parts in zip(parsed, out, strict=True):
        whole = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        raw = whole.astype(np.int8).tobytes() if info["bits"] == 8 else whole.astype("<i2").tobytes()
        if any(info["md5"]) and hashlib.md5(raw).digest() != info["md5"]:
            raise ValueError("the samples' MD5 doesn't match")
        done.append(raw.translate(_FLIP) if info["bits"] == 8 else raw)
    return done


def _decode_frames(buffer: bytes, frames: list[Frame], parsed: list) -> list[np.ndarray]:
    """Decode frames in lockstep, set each frame's end and check its CRC-16."""
    for f in frames:
        info = parsed[f.stream][0]
        _read_head(buffer, f, info["bits"], info["block"])
    data = np.frombuffer(buffer + bytes(16), np.uint8)
    words = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        words |= data[k : k + len(words)].astype(np.uint64) << np.uint64(56 - 8 * k)
    out: list[np.ndarray | None] = [None] * len(frames)
    coded = []
    for i, f in enumerate(frames):
        if f.constant is not None:
            out[i] = np.full(f.size, f.constant, np.int64)
        elif f.raw:
            read = _Bits(buffer, f.at)
            out[i] = np.array([read.signed(f.bits) for _ in range(f.size)], np.int64)
            f.end = (read.at + 7) // 8
        else:
            coded.append(i)
    coded.sort(key=lambda i: -frames[i].size)
    if coded:
        samples, ends = _lockstep(words, [frames[i] for i in coded])
        for j, i in enumerate(coded):
            out[i] = samples[: frames[i].size, j]
            frames[i].end = int(ends[j] + 7) // 8
    starts, ends = np.array([f.start for f in frames], np.int64), np.array([f.end for f in frames], np.int64)
    stored = data[ends].astype(np.uint16) << 8 | data[ends + 1]
    if (crc16_frames(data, starts, ends - starts) != stored).any():
        raise ValueError("a frame's CRC-16 doesn't match")
    for f in frames:
        f.end += 2
    return out


def _peek(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 57 or more bits from each place on, at the top of 64."""
    return words[at >> 3] << (at & 7).astype(np.uint64)


def _lockstep(words: np.ndarray, frames: list[Frame]) -> tuple[np.ndarray, np.ndarray]:
    """(samples by step and frame, bit after each frame's last code). frames: longest first."""
    m, longest = len(frames), frames[0].size
    sizes = np.array([f.size for f in frames], np.int64)
    order = np.array([f.order for f in frames], np.int64)
    shift = np.array([f.shift for f in frames], np.int64)
    at = np.array([f.at for f in frames], np.int64)
    wide = np.array([f.wide for f in frames], np.int64)
    part = sizes >> np.array([f.partitions for f in frames], np.int64)
    deepest = int(order.max())
    coefficients = np.zeros((max(1, deepest), m), np.int64)
    samples = np.zeros((longest, m), np.int64)
    for j, f in enumerate(frames):
        if f.order:
            coefficients[: f.order, j] = f.coefficients
            samples[: f.order, j] = f.warm
    k, raw, boundary = np.zeros(m, np.int64), np.zeros(m, np.int64), order.copy()
    escaped = np.zeros(m, bool)
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right").tolist()
    marks = {int(b) for b in np.unique(order)} | {int(p) * x for p, f in zip(part, frames, strict=True) for x in range(1 << f.partitions)}
    for i in range(longest):
        n = active[i]
        rows = np.flatnonzero(order[:n] <= i) if i < deepest else None
        if i in marks:
            due = np.flatnonzero((boundary[:n] == i) & (order[:n] <= i))
            if len(due):
                size = wide[due]
                k[due] = (_peek(words, at[due]) >> (64 - size).astype(np.uint64)).astype(np.int64)
                at[due] += size
                odd = due[k[due] == (1 << wide[due]) - 1]
                escaped[due] = False
                if len(odd):
                    escaped[odd] = True
                    raw[odd] = (_peek(words, at[odd]) >> np.uint64(59)).astype(np.int64)
                    at[odd] += 5
                    k[odd] = 0
                boundary[due] = (i // part[due] + 1) * part[due]
        if rows is None:
            here, kk = at[:n], k[:n]
        else:
            here, kk = at[rows], k[rows]
        window = _peek(words, here)
        zeros = _ZEROS[(window >> np.uint64(48)).astype(np.int64)]
        lead = zeros
        rest = window << (zeros + 1).astype(np.uint64)
        far = np.flatnonzero(zeros == 16)
        if len(far):
            lead = zeros.copy()
            place, more = here[far] + 16, far
            while len(more):
                z = _ZEROS[(_peek(words, place) >> np.uint64(48)).astype(np.int64)]
                lead[more] += z
                on = z == 16
                more, place = more[on], place[on] + 16
                if len(place) and int(place.max()) >> 3 >= len(words) - 2:
                    raise ValueError("a Rice code runs over the end")
            rest[far] = _peek(words, here[far] + lead[far] + 1)
        folded = (lead << kk) | ((rest >> (63 - kk).astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
        residual = (folded >> 1) ^ -(folded & 1)
        moved = lead + 1 + kk
        esc = escaped[:n] if rows is None else escaped[rows]
        if esc.any():
            width = (raw[:n] if rows is None else raw[rows])[esc]
            value = (window[esc] >> np.uint64(1) >> (63 - width).astype(np.uint64)).astype(np.int64)
            residual[esc] = np.where((width > 0) & (value >> np.maximum(width - 1, 0) == 1), value - (1 << width), value)
            moved[esc] = width
        predicted = np.zeros(n, np.int64)
        for j in range(min(deepest, i)):
            predicted += coefficients[j, :n] * samples[i - 1 - j, :n]
        predicted >>= shift[:n]
        if rows is None:
            at[:n] += moved
            samples[i, :n] = predicted + residual
        else:
            at[rows] += moved
            samples[i, rows] = predicted[rows] + residual
    return samples, at


# ------------------------------------------------------------------------------------------------- DataFrames


def payload_of(text: bytes) -> bytes:
    return text + b" " * ((-len(text)) % UNIT or (0 if text else UNIT))


def _payloads(column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    data, offsets = text_buffer(column)
    raw = data.tobytes()
    return np.diff(offsets), [payload_of(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the FLAC stream of every row of ``docs`` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for part in batch_slices(batch, "text", _SLICE):
                sizes, payloads = _payloads(part.column(1))
                yield pa.record_batch([part.column(0), pa.array(sizes), pa.array(encode(payloads), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, block, sample_offset, n_samples, pcm): the decoded blocks of ``media`` (doc_id, media). A reader that
    wants a range of samples takes the blocks whose offsets meet it."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                stream = batch.column(1)[i].as_py()
                if stream is None:
                    continue
                info, points, _ = _metadata(stream)
                pcm, wide = decode([stream])[0], 1 if info["bits"] == 8 else 2
                points = points or [(0, 0, info["samples"])]
                doc = pa.array([batch.column(0)[i].as_py()] * len(points), pa.int64())
                yield pa.record_batch(
                    [doc, pa.array(range(len(points)), pa.int32()), pa.array([p[0] for p in points], pa.int64()), pa.array([p[2] for p in points], pa.int32()), pa.array([pcm[p[0] * wide : (p[0] + p[2]) * wide] for p in points], pa.binary())],
                    names=["doc_id", "block", "sample_offset", "n_samples", "pcm"],
                )

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, "doc_id long, block int, sample_offset long, n_samples int, pcm binary")


def feature(pcm: bytes) -> str:
    """Sums over the samples, all integers: how many, their sum and energy, zero crossings, and the peak."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"samples={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings};peak={int(np.abs(x).max())}"


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(docs: DataFrame) -> DataFrame:
    """Digests of every row's payload as read back from its FLAC stream, and of the stream."""

    def run(batches):
        for batch in batches:
            for part in batch_slices(batch, "text", _SLICE):
                sizes, payloads = _payloads(part.column(1))
                media = encode(payloads)
                del payloads
                back = decode(media)
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array(sizes),
                        pa.array([len(p) for p in back], pa.int64()),
                        pa.array([hashlib.sha256(p).hexdigest() for p in back], pa.string()),
                        pa.array([zlib.crc32(p[-16:]) for p in back], pa.int64()),
                        pa.array([len(x) for x in media], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in media], pa.string()),
                        pa.array([feature(p) for p in back], pa.string()),
                    ],
                    names=[c.split()[0] for c in _DIGEST.split(", ")],
                )

    return _rows(docs).mapInArrow(run, _DIGEST)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
