"""Benchmark decontamination by greedy string tiling (operator 10).

Texts are lower-cased words (runs of letters and digits; marks between or around words don't count; scripts without
spaces have a word for each character). Seeds are the Karp-Rabin hashes of ``least`` words in a row; a document is
compared with the items whose seeds it shares. For each such pair the longest match of words that no tile covers yet is
marked, again and again, until none of ``least`` words is left, so passages count in whatever order they come. A document
leaks an item if the tiles cover at least ``coverage`` of the item's words. Pairs whose shared seeds can't cover that much
are dropped before places are joined, so a seed that many items have costs its items once for a document.

Items of fewer than ``least`` words have no seed. One of ``SHORT_WORDS`` or more leaks into documents that have all of it
in a row, a shorter one only into documents that are it, since a word or two of it stand in any text.

The benchmark is read in blocks of bounded size, one at a time on the driver, each broadcast by itself: a benchmark of B
bytes takes B / ``BLOCK_BYTES`` passes over the documents, and its size changes nothing else. With several blocks each
one's leaks are kept before the next, and its broadcast is released.

A null or empty text has no words and leaks nothing; items without an id or text are left out. Repeated documents are
answered once each, equal items each for themselves; long texts are compared whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import batch_slices, checkpointed, gram_hashes, lowered, text_buffer, whole_grams, word_hashes

#: Words of the shortest tile, the share of an item's words that is a leak, and bytes of items in a block.
LEAST_WORDS, LEAST_COVERAGE, BLOCK_BYTES = 5, 0.6, 16 << 20
#: Words from which on a short item is looked for inside documents; places of seeds that are joined at once; leaking
#: documents up to which their keys are broadcast.
SHORT_WORDS, MOST_PLACES, BROADCAST_ROWS = 3, 1 << 21, 400_000


class ItemBlock:
    """Some items of the benchmark: their words' hashes, and their seeds sorted by hash."""

    def __init__(self, ids: list[int], texts: list[str | None], least: int) -> None:
        data, offsets = text_buffer(lowered(pa.array(texts, pa.large_string())))
        words, _, _, first = word_hashes(data, offsets)
        self.ids, self.words, self.first, self.least = np.array(ids, np.int64), words, first, least
        seeds = gram_hashes(words, least)
        at = np.flatnonzero(whole_grams(first, least, len(words)))
        at = at[np.argsort(seeds[at], kind="stable")]
        self.seed, self.seed_at = seeds[at], at
        size = np.diff(first)
        self.short: dict[int, dict[int, list[int]]] = {}  # by number of words: the items by the hash of all their words
        for i in np.flatnonzero((size > 0) & (size < least)).tolist():
            k = int(size[i])
            whole = int(gram_hashes(words[first[i] : first[i + 1]], k)[0])
            self.short.setdefault(k, {}).setdefault(whole, []).append(i)

    def item_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1


def item_blocks(bench: DataFrame, least: int = LEAST_WORDS, block_bytes: int = BLOCK_BYTES) -> Iterator[ItemBlock]:
    """The benchmark in blocks of about ``block_bytes`` of text, one at a time on the driver."""
    ids, texts, size = [], [], 0
    for row in bench.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1].encode("utf-8", "surrogatepass"))
        if size >= block_bytes:
            yield ItemBlock(ids, texts, least)
            ids, texts, size = [], [], 0
    if ids:
        yield ItemBlock(ids, texts, least)


def tiles(doc: np.ndarray, item: np.ndarray, runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (doc word, item word, words) out of maximal common runs, longest first, then by place."""
    marked_doc, marked_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    heap = [(-n, i, d) for d, i, n in runs if n >= least]
    heapq.heapify(heap)
    out, left = [], len(item)
    while heap and left >= least:
        n, i, d = heapq.heappop(heap)
        n = -n
        taken = marked_doc[d : d + n] | marked_item[i : i + n]
        if taken.any():  # what is free of it may still be a match
            edge = np.diff(np.concatenate(([1], taken.astype(np.int8), [1])))
            for a, b in zip(np.flatnonzero(edge == -1).tolist(), np.flatnonzero(edge == 1).tolist(), strict=True):
                if b - a >= least:
                    heapq.heappush(heap, (a - b, i + a, d + a))
            continue
        marked_doc[d : d + n] = True
        marked_item[i : i + n] = True
        left -= n
        out.append((d, i, n))
    return out


def _runs(doc_at: np.ndarray, item_at: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Maximal common runs from the places of common seeds: seeds that follow each other on one diagonal."""
    order = np.lexsort((doc_at, doc_at - item_at))
    d, i = doc_at[order], item_at[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(d) != 1) | (np.diff(i) != 1))))
    length = np.diff(np.concatenate((new, [len(d)]))) + least - 1
    return list(zip(d[new].tolist(), i[new].tolist(), length.tolist(), strict=True))


def _shared_items(block: ItemBlock, seeds: np.ndarray, coverage: float) -> np.ndarray:
    """The items of which so many places have one of these distinct seeds that tiles might cover enough."""
    lo, hi = np.searchsorted(block.seed, seeds), np.searchsorted(block.seed, seeds, "right")
    places = np.zeros(len(block.ids), np.int64)
    ends = np.cumsum(hi - lo)
    for part in np.split(np.arange(len(seeds)), np.searchsorted(ends, np.arange(MOST_PLACES, ends[-1], MOST_PLACES))):
        if len(part):
            at = np.concatenate([block.seed_at[x:y] for x, y in zip(lo[part].tolist(), hi[part].tolist(), strict=True)])
            places += np.bincount(block.item_of(at), minlength=len(places))
    return np.flatnonzero((places > 0) & (places * block.least >= coverage * np.diff(block.first)))


def _leaks_of(row: int, doc: np.ndarray, at: np.ndarray, seeds: np.ndarray, block: ItemBlock, coverage: float) -> list[tuple[int, int, int, int, int]]:
    """The leaks into one document. doc: its words; at, seeds: its places that have a seed of some item, and that seed."""
    k, out = block.least, []
    for item in _shared_items(block, np.unique(seeds), coverage).tolist():
        begin, end = int(block.first[item]), int(block.first[item + 1])
        words, n = block.words[begin:end], end - begin
        own = gram_hashes(words, k)
        order = np.argsort(own, kind="stable")
        lo, hi = np.searchsorted(own[order], seeds), np.searchsorted(own[order], seeds, "right")
        count = hi - lo
        doc_at = np.repeat(at, count)  # the join of the document's seeds with the item's
        item_at = order[np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())]
        same = np.ones(len(doc_at), bool)
        for j in range(k):
            same &= doc[doc_at + j] == words[item_at + j]
        doc_at, item_at = doc_at[same], item_at[same]
        reach = np.zeros(n + 1, np.int64)  # words that any seed covers: tiles can't cover more
        np.add.at(reach, item_at, 1)
        np.add.at(reach, np.minimum(item_at + k, n), -1)
        if not len(doc_at) or (np.cumsum(reach[:n]) > 0).sum() < coverage * n:
            continue
        found = tiles(doc, words, _runs(doc_at, item_at, k), k)
        covered = sum(t[2] for t in found)
        if covered >= coverage * n:
            out.append((row, int(block.ids[item]), len(found), covered, n))
    return out


def leaks(column: pa.Array, block: ItemBlock, coverage: float) -> list[tuple[int, int, int, int, int]]:
    """(row, item id, tiles, words covered, words of the item) of the leaks in a column of texts."""
    data, offsets = text_buffer(lowered(column))
    words, _, _, first = word_hashes(data, offsets)
    k, out = block.least, []
    seeds = gram_hashes(words, k)
    if len(seeds) and len(block.seed):
        lo = np.searchsorted(block.seed, seeds)
        hit = np.flatnonzero((block.seed[np.minimum(lo, len(block.seed) - 1)] == seeds) & whole_grams(first, k, len(words)))
        for r in np.unique(np.searchsorted(first, hit, "right") - 1).tolist():
            base, end = int(first[r]), int(first[r + 1])
            mine = hit[np.searchsorted(hit, base) : np.searchsorted(hit, end)]
            out += _leaks_of(r, words[base:end], mine - base, seeds[mine], block, coverage)
    for n, items in block.short.items():
        hashes = gram_hashes(words, n)
        keys = np.fromiter(items, np.uint64, len(items))
        hit = np.flatnonzero(np.isin(hashes, keys) & whole_grams(first, n, len(words)))
        row = np.searchsorted(first, hit, "right") - 1
        whole = np.diff(first)[row] == n
        for r, h in sorted({(int(r), int(hashes[at])) for r, at, alone in zip(row, hit, whole, strict=True) if n >= SHORT_WORDS or alone}):
            out += [(r, int(block.ids[i]), 1, n, n) for i in items[h]]
    return sorted(out, key=lambda x: x[0])


_OUT = "doc_id long, item_id long, n_tiles int, covered_words int, item_words int, coverage double"


def _block_size(bench: DataFrame) -> int:
    return bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def leaked_pairs(docs: DataFrame, bench: DataFrame, least: int = LEAST_WORDS, coverage: float = LEAST_COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_tiles, covered_words, item_words, coverage) of every leak of an item of ``bench``
    (item_id, text) into a row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], _OUT)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    several = _block_size(bench) >= block_bytes
    for block in item_blocks(bench, least, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                for part in batch_slices(batch, "text"):
                    hits = leaks(part.column(1), shared.value, coverage)
                    r, item, n, covered, words = (list(x) for x in zip(*hits, strict=True)) if hits else ([],) * 5
                    yield pa.record_batch(
                        [part.column(0).take(pa.array(r, pa.int64())), pa.array(item, pa.int64()), pa.array(n, pa.int32()), pa.array(covered, pa.int32()), pa.array(words, pa.int32()), pa.array([c / w for c, w in zip(covered, words, strict=True)], pa.float64())],
                        names=["doc_id", "item_id", "n_tiles", "covered_words", "item_words", "coverage"],
                    )

        of_block = rows.mapInArrow(run, _OUT)
        if several:
            of_block = checkpointed(of_block)
            shared.unpersist()
        found = found.unionByName(of_block)
    return found


def without_leaks(docs: DataFrame, bench: DataFrame, least: int = LEAST_WORDS, coverage: float = LEAST_COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that leak no item; all columns stay. A benchmark of one block filters documents where they are
    read; with more, the texts that leak are kept by their hashes, and documents with such a text go."""
    spark, schema = docs.sparkSession, docs.schema
    if _block_size(bench) >= block_bytes:
        keys = [F.xxhash64(F.lit(seed), F.col("text").cast("string")) for seed in (1, 2)]
        texts = docs.where("text is not null").select(*[k.alias(f"__k{i}") for i, k in enumerate(keys)], F.col("text").cast("string").alias("text"))
        hashed = texts.select("__k0", "__k1").schema
        gone = spark.createDataFrame([], hashed)
        for block in item_blocks(bench, least, block_bytes):
            shared = spark.sparkContext.broadcast(block)

            def keys_of(batches, shared=shared):
                for batch in batches:
                    for part in batch_slices(batch, "text"):
                        rows = pa.array(sorted({h[0] for h in leaks(part.column(2), shared.value, coverage)}), pa.int64())
                        yield pa.record_batch([part.column(0).take(rows), part.column(1).take(rows)], names=["__k0", "__k1"])

            gone = gone.unionByName(checkpointed(texts.mapInArrow(keys_of, hashed)))
            shared.unpersist()
        gone = gone.distinct()
        if gone.count() <= BROADCAST_ROWS:
            gone = F.broadcast(gone)
        return docs.join(gone, (keys[0] == F.col("__k0")) & (keys[1] == F.col("__k1")), "left_anti")
    for block in item_blocks(bench, least, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                for part in batch_slices(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    keep[[h[0] for h in leaks(part.column(part.schema.get_field_index("text")), shared.value, coverage)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
