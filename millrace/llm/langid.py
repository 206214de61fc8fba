"""Language identification by hyperdimensional profiles (operator 8).

Every letter has a random vector of +1 and -1. A 3-gram's vector binds (multiplies) its letters' vectors, the first
permuted twice and the second once, so that order counts; a text's vector bundles (adds) those of its 3-grams, word
edges included. A language's prototype bundles the unit vectors of its training texts, and a text gets the language
whose prototype has the highest cosine with it.

Letters are lower-cased; Latin ones up to U+024F have a vector of their own, others share ``SHARED`` ones by code
point; everything that isn't a letter is a word's edge. A text that is null or has no letter is ``und`` with score 0.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import batch_slices, text_buffer

#: Dimensions of a vector, training texts of a language at most, and letters that share vectors beyond Latin.
DIMENSIONS, TRAINING_DOCS, SHARED = 1024, 2_000, 512
_OWN = 0x250
_SYMBOLS = 1 + _OWN + SHARED
_DENSE_CELLS = 1 << 22
#: Bytes of text whose 3-gram vectors are made together.
_SLICE = 4 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The symbol of each code point: 0 for what isn't a letter."""
    table = np.zeros(0x110000, np.int16)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            k = ord(low[0])
            table[c] = 1 + k if k < _OWN else 1 + _OWN + (k * 2654435761 >> 7) % SHARED
    return table


@lru_cache(maxsize=1)
def _vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols' vectors: permuted twice, once and not at all. A permutation is a roll."""
    base = np.random.default_rng(20240501).integers(0, 2, (_SYMBOLS, DIMENSIONS), dtype=np.int8) * 2 - 1
    return np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """The bound vectors of 3-grams (codes of three symbols)."""
    a, b, c = _vectors()
    return a[codes // (_SYMBOLS * _SYMBOLS)] * b[codes // _SYMBOLS % _SYMBOLS] * c[codes % _SYMBOLS]


def text_grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the distinct codes, distinct codes, has letters): the 3-grams of a column of texts; a run of
    non-letters is one edge."""
    data, offsets = text_buffer(column)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    n = len(offsets) - 1
    symbols = _letters()[points].astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(starts))
    keep = (symbols > 0) | (np.concatenate(([1], symbols[:-1])) > 0)
    symbols, row = symbols[keep], row[keep]
    # An edge at both ends of every row, so that 3-grams don't reach into a neighbour.
    rows_with = np.flatnonzero(np.bincount(row, weights=symbols > 0, minlength=n) > 0)
    first, last = np.searchsorted(row, rows_with, "left"), np.searchsorted(row, rows_with, "right")
    symbols = np.insert(symbols, np.concatenate((last, first)), 0)  # at one place a row's end comes before the next one's begin
    row = np.insert(row, np.concatenate((last, first)), np.concatenate((rows_with, rows_with)))
    has = np.zeros(n, bool)
    has[rows_with] = True
    if len(symbols) < 3:
        none = np.zeros(0, np.int64)
        return none, none, none, has
    inside = (row[:-2] == row[2:]) & (symbols[1:-1] > 0)
    used = np.flatnonzero(np.bincount(symbols, minlength=_SYMBOLS))
    k = len(used)
    if k**3 <= 1 << 23:  # few symbols: their 3-grams are counted in a table
        small = np.zeros(_SYMBOLS, np.int64)
        small[used] = np.arange(k)
        symbols = small[symbols]
        codes = ((symbols[:-2] * k + symbols[1:-1]) * k + symbols[2:])[inside]
        there = np.bincount(codes, minlength=k**3) > 0
        at = (np.cumsum(there) - 1)[codes]
        known = np.flatnonzero(there)
        known = (used[known // (k * k)] * _SYMBOLS + used[known // k % k]) * _SYMBOLS + used[known % k]
    else:
        codes = ((symbols[:-2] * _SYMBOLS + symbols[1:-1]) * _SYMBOLS + symbols[2:])[inside]
        known, at = np.unique(codes, return_inverse=True)
    return row[:-2][inside], at, known, has


def text_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, has letters) of a column of texts, by a product of their 3-gram counts and the 3-gram vectors."""
    row, at, known, has = text_grams(column)
    n, width = len(column), len(known)
    out = np.zeros((n, DIMENSIONS), np.float32)
    for low, high in _blocks(row, n, max(1, _DENSE_CELLS // max(1, width))):
        counts = np.bincount((row[low:high] - row[low]) * width + at[low:high])
        height = int(row[high - 1] - row[low]) + 1
        dense = np.zeros(height * width, np.float32)
        dense[: len(counts)] = counts
        for i in range(0, width, 16_384):
            out[row[low] : row[low] + height] += dense.reshape(height, width)[:, i : i + 16_384] @ gram_vectors(known[i : i + 16_384]).astype(np.float32)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1), has


def _blocks(row: np.ndarray, n: int, rows: int):
    """Ranges of the 3-grams of so many rows each, whose table of counts has a bounded number of cells."""
    for first in range(0, n, rows):
        low, high = np.searchsorted(row, first, "left"), np.searchsorted(row, first + rows, "left")
        if low < high:
            yield low, high


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def prototypes(docs: DataFrame, most: int = TRAINING_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes) learned from ``docs`` (doc_id, text, lang): rows that aren't held out, with a lang.

    At most about ``most`` texts of a language are used: those whose hash falls under the share that this number is of
    the language's rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text"))
    rows = rows.where(~is_held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    shares = {r["lang"]: most / r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    if not shares:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    share = F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair])
    point = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(point < share[F.col("lang")]).select("lang", "text")

    def run(batches):
        for batch in batches:
            for part in batch_slices(batch, "text", _SLICE):
                vectors, has = text_vectors(part.column(1))
                langs = np.array(part.column(0).to_pylist(), object)
                names = sorted(set(langs[has].tolist()))
                sums = [vectors[has & (langs == x)].sum(axis=0, dtype=np.float64).astype("<f8").tobytes() for x in names]
                yield pa.record_batch([pa.array(names, pa.string()), pa.array(sums, pa.binary())], names=["lang", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(DIMENSIONS)
        for x in sorted(table.column("part").to_pylist()):
            total += np.frombuffer(x, "<f8")
        return pa.table({"lang": table.column("lang").slice(0, 1), "part": pa.array([total.astype("<f8").tobytes()], pa.binary())})

    # A part holds the texts of a slice of the bounded sample: few come together here.
    parts = sample.mapInArrow(run, "lang string, part binary").groupBy("lang").applyInArrow(add, "lang string, part binary")
    found = sorted((r["lang"], r["part"]) for r in parts.collect())  # one row for each language
    matrix = np.array([np.frombuffer(p, "<f8") for _, p in found]).reshape(-1, DIMENSIONS)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return [x for x, _ in found], (matrix / np.where(norms > 0, norms, 1)).astype(np.float32)


def identify(docs: DataFrame, most: int = TRAINING_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``; score is the cosine, at least 0. Of equal
    cosines the first language counts. If nothing was learned all texts are ``und``."""
    shared = docs.sparkSession.sparkContext.broadcast(prototypes(docs, most))

    def run(batches):
        langs, matrix = shared.value
        for batch in batches:
            for part in batch_slices(batch, "text", _SLICE):
                vectors, has = text_vectors(part.column(2))
                known = has & bool(langs)
                cosine = vectors @ matrix.T if langs else np.zeros((part.num_rows, 1), np.float32)
                best = cosine.argmax(axis=1)
                names = [langs[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
                score = np.where(known, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0).astype(float)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), is_held_out(doc_id).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
