"""Shared pieces of the training-data operators: Arrow text buffers, word hashes, checkpoints.

Conventions of all operators here: a null text is an empty text unless an operator says otherwise, repeated rows
are answered once each, extra columns are ignored or passed through under their own names, and empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from millrace import session
from millrace.operators.checkpoints import checkpointed as checkpointed

#: Bytes of text that the vectorised kernels take at once. Bounds a worker's memory whatever the Arrow batch holds: a
#: byte takes some 60 bytes of temporary arrays, and workers that have ended a task keep their tables of powers.
SLICE_BYTES = 1 << 20
#: Rows and bytes of a batch that goes to a Python worker, at most (a longer text stands alone).
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def ship_package(spark: SparkSession) -> None:
    """Let executors import this package, and hand texts to Python workers in batches of bounded bytes: the buffers of a
    batch lie outside of the heap, and grow by doubling."""
    session.ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``limit`` bytes; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def batch_slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about ``limit`` bytes of the named text column."""
    _, offsets = text_buffer(batch.column(batch.schema.get_field_index(name)))
    for i, j in row_slices(offsets, limit):
        yield batch.slice(i, j - i)


# ---------------------------------------------------------------------------------------------- word hashes

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power_table(base: int, n: int, key: str) -> np.ndarray:
    """base**i mod 2**64 for i < n, kept for the process and grown by doubling."""
    table = _powers.get(key)
    if table is None or len(table) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        table = np.empty(size, np.uint64)
        table[0] = 1
        filled = 1
        with np.errstate(over="ignore"):
            while filled < size:
                step = np.uint64(pow(base, filled, 1 << 64))
                table[filled : 2 * filled] = table[:filled] * step
                filled *= 2
        _powers[key] = table
    return table


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that polynomial hashes spread over all bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _word_bytes() -> np.ndarray:
    """True for bytes of words: ASCII letters and digits, and all bytes beyond ASCII."""
    table = np.zeros(256, bool)
    table[128:] = True
    for a, b in (("0", "9"), ("a", "z"), ("A", "Z")):
        table[ord(a) : ord(b) + 1] = True
    return table


WORD_BYTES = _word_bytes()


def _unspaced(data: np.ndarray, inside: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """The first bytes of whole three-byte characters of scripts without spaces; marks among them leave ``inside``."""
    lead = np.flatnonzero((data[:-2] >= 0xE0) & (data[:-2] <= 0xEF)) if len(data) > 2 else np.zeros(0, np.int64)
    if not len(lead):
        return []
    a, b, c = data[lead], data[lead + 1], data[lead + 2]
    marks = (a == 0xE3) & (b == 0x80)
    marks |= (a == 0xEF) & ((b == 0xBC) & ((c <= 0x8F) | (c >= 0x9A) & (c <= 0xA0) | (c >= 0xBB)) | (b == 0xBD) & ((c <= 0x80) | (c >= 0x9B) & (c <= 0xA5)))
    for k in range(3):
        inside[lead[marks] + k] = False
    single = ~marks & ((a >= 0xE3) & (a <= 0xE9) | (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB))
    return [(lead[single], 3)]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of normalised text and their 64-bit hashes.

    ``data`` is lower-cased UTF-8; a word is a run of ASCII letters, digits and non-ASCII characters other than general
    punctuation, CJK punctuation and full-width marks. Scripts that put no spaces between words (Han, kana, Bopomofo,
    Thai, Lao) have a word for each character. Returns (hash, start byte, end byte, first word of each row and one past
    the last).
    """
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, np.zeros(len(offsets), np.int64)
    inside = WORD_BYTES[data]
    lead = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80)) if n > 2 else np.zeros(0, np.int64)
    for k in range(3):
        inside[lead + k] = False
    nbsp = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] <= 0xBF)) if n > 1 else lead
    inside[nbsp] = False
    inside[nbsp + 1] = False
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True  # a row's first byte starts a word of its own
    for start, width in _unspaced(data, inside):  # so do a character of these scripts, and what follows it
        cut[start] = cut[start + width] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    power, inverse = _power_table(_BASE, n, "up"), _power_table(_INVERSE, n, "down")
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
        hashes = mix64((prefix[ends] - prefix[starts]) * inverse[starts])
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of every k words in a row of all rows' words (len - k + 1 of them)."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = words[:m].copy()
        for i in range(1, k):
            h = h * np.uint64(_BASE) + words[i : i + m]
    return h


def whole_grams(first: np.ndarray, k: int, n_words: int) -> np.ndarray:
    """True where k words from here on stay within one row; first: as word_hashes returns it."""
    m = max(0, n_words - k + 1)
    ok = np.ones(m, bool)
    for b in range(1, k):
        at = first[1:-1] - b
        ok[at[(at >= 0) & (at < m)]] = False
    return ok


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))
