"""SimHash near-duplicates, joined exactly through vantage-point trees (operator 3).

Fingerprints are 64 bits: words are runs of non-white-space after lower-casing A-Z, shingles are ``width`` words,
each shingle's XXH64 (seed 42) votes on every bit. Two fingerprints are linked when they differ in at most
``radius`` bits.

The search never compares all pairs. Equal fingerprints are collapsed first. A vantage-point tree is fitted to a
bounded sample; every fingerprint has one home leaf, and a fingerprint whose ball of the radius crosses a split also
visits the leaves beyond it (both triangle bounds are kept, so no pair is lost). The sample bounds the leaves that are
dealt to tasks; a leaf that holds more than ``LOCAL_LEAF`` fingerprints is split by a tree of its own in its task, in
the same way. Inside a leaf the distances to a local vantage point bound which fingerprints can be near each other. A leaf gives a spanning forest of its links and
not the pairs themselves, so a group of thousands of near copies costs its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed
from millrace.llm.components import connected_components

SEED = 42
#: Fingerprints that a leaf of the tree should hold, the sampled ones that one leaf is fitted on, the most leaves that the
#: driver fits, and the fingerprints from which on a leaf is split again in its task.
LEAF_SIZE, LEAF_SAMPLE, MOST_LEAVES, LOCAL_LEAF = 4_000, 48, 16_384, 12_000
_BLOCK = 1 << 21


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """XXH64 of every shingle, repeats included; none for a text that is null or has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(whole, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    return np.array([digest(whole[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The unsigned 64-bit fingerprint of shingles' hashes; 0 if there are none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int.from_bytes(np.packbits(ones).tobytes(), "big")


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit fingerprint; 0 for a text that is null or has no words."""
    return fingerprint_of(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; fp holds the 64 bits as a signed number."""

    def run(batches):
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, len(batch))
            yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def distances(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class VantageTree:
    """A complete binary tree of (vantage point, split distance); leaves are numbered from left to right."""

    def __init__(self, sample: np.ndarray, depth: int, radius: int) -> None:
        self.depth, self.radius = depth, radius
        self.points = np.zeros(max(1, (1 << depth) - 1), np.uint64)
        self.splits = np.zeros(max(1, (1 << depth) - 1), np.int16)
        rows, random = [sample], np.random.default_rng(7)
        for level in range(depth):
            below = []
            for i, part in enumerate(rows):
                at = (1 << level) - 1 + i
                self.points[at], self.splits[at] = self._choose(part, random)
                near = distances(part, self.points[at]) <= self.splits[at]
                below += [part[near], part[~near]]
            rows = below

    def _choose(self, part: np.ndarray, random) -> tuple[np.uint64, int]:
        """Of some candidates the vantage point and split that the fewest balls cross, among even enough splits."""
        if not len(part):
            return np.uint64(0), 32
        best = None
        for v in random.choice(part, min(24, len(part)), replace=False):
            counts = np.bincount(distances(part, v), minlength=65)
            inside = np.cumsum(counts) / len(part)
            for split in range(64):
                if 0.3 <= inside[split] <= 0.7:
                    crossed = counts[max(0, split - self.radius + 1) : split + self.radius + 1].sum() / len(part)
                    cost = crossed + abs(inside[split] - 0.5) / 2
                    if best is None or cost < best[0]:
                        best = (cost, v, split)
        if best is None:  # a dense ball: the most even split there is
            v = part[0]
            inside = np.cumsum(np.bincount(distances(part, v), minlength=65)) / len(part)
            best = (0, v, int(np.argmin(np.abs(inside - 0.5))))
        return best[1], best[2]

    def routes(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, leaf, at home) of every visit: the home leaf, and later leaves that the ball reaches."""
        index, leaf, home = np.arange(len(prints)), np.zeros(len(prints), np.int64), np.ones(len(prints), bool)
        for level in range(self.depth):
            node = (1 << level) - 1 + leaf
            d, split = distances(prints[index], self.points[node]), self.splits[node]
            near = d <= split
            crosses_out, crosses_in = near & (d + self.radius > split), ~near & (d - self.radius <= split)
            own = 2 * leaf + ~near
            visitor_in = crosses_in & ~home  # a home row only visits leaves after its own
            extra = crosses_out | visitor_in
            index = np.concatenate((index, index[extra]))
            leaf = np.concatenate((own, np.where(near, own + 1, own - 1)[extra]))
            home = np.concatenate((home, np.zeros(int(extra.sum()), bool)))
        return index, leaf, home


def leaf_forest(prints: np.ndarray, home: np.ndarray, radius: int, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(print, root) of every print of a leaf that has a link in it; root is a print that links connect it with (the
    least one, unless the leaf is split again)."""
    if len(prints) > LOCAL_LEAF and depth < 8:
        levels = int(np.ceil(np.log2(len(prints) / LEAF_SIZE)))
        sample = np.random.default_rng(depth).choice(prints, min(len(prints), LEAF_SAMPLE << levels), replace=False)
        index, leaf, at_home = VantageTree(sample, levels, radius).routes(prints)
        order = np.argsort(leaf, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1)
        if max(map(len, parts)) <= 0.9 * len(prints):  # else a ball that no vantage point splits: compared as it is
            found = [leaf_forest(prints[index[p]], at_home[p], radius, depth + 1) for p in parts]
            return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.argsort(~home, kind="stable")
    prints, homes = prints[order], int(home.sum())
    label = np.arange(len(prints))
    if not homes or len(prints) < 2:
        return prints[:0], prints[:0]
    d = distances(prints, prints[0])
    inner = np.argsort(d[:homes], kind="stable")
    outer = np.argsort(d, kind="stable")
    d_in, d_out = d[inner], d[outer]
    for value in np.unique(d_in):
        a = inner[np.searchsorted(d_in, value, "left") : np.searchsorted(d_in, value, "right")]
        b = outer[np.searchsorted(d_out, value - radius, "left") : np.searchsorted(d_out, value + radius, "right")]
        step = max(1, _BLOCK // max(1, len(b)))
        for i in range(0, len(a), step):
            part = a[i : i + step]
            x, y = np.nonzero(np.bitwise_count(prints[part][:, None] ^ prints[b][None, :]) <= radius)
            label = _merge(label, part[x], b[y])
    low = np.full(len(prints), np.iinfo(np.int64).max)
    signed = prints.view(np.int64)
    np.minimum.at(low, label, signed)
    linked = np.bincount(label, minlength=len(prints))[label] > 1
    return signed[linked], low[label][linked]


def _merge(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Join the groups of x[i] and y[i]; label is flat: each row has its group's number."""
    a, b = label[x], label[y]
    differ = a != b
    if not differ.any():
        return label
    pairs = np.unique(np.stack((np.minimum(a[differ], b[differ]), np.maximum(a[differ], b[differ])), axis=1), axis=0)
    parent: dict[int, int] = {}

    def find(k: int) -> int:
        while (up := parent.get(k, k)) != k:
            parent[k] = parent.get(up, up)
            k = up
        return k

    for p, q in pairs.tolist():
        p, q = find(p), find(q)
        if p != q:
            parent[max(p, q)] = min(p, q)
    to = np.arange(len(label))
    for k in list(parent):
        to[k] = find(k)
    return to[label]


def links(groups: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) between fingerprints of ``groups`` (fp long, distinct) that connect all links of the radius."""
    spark = groups.sparkSession
    n = groups.count()
    leaves = min(MOST_LEAVES, max(1, n // LEAF_SIZE))
    depth = int(np.ceil(np.log2(leaves))) if leaves > 1 else 0
    sample = groups.orderBy(F.xxhash64(F.lit(11), "fp"), "fp").limit(LEAF_SAMPLE << depth).collect() if depth else []
    tree = VantageTree(np.array([r["fp"] for r in sample], np.int64).view(np.uint64), depth, radius)
    shared = spark.sparkContext.broadcast(tree)

    def route(batches):
        for batch in batches:
            prints = batch.column(0).to_numpy()
            index, leaf, home = shared.value.routes(prints.view(np.uint64))
            yield pa.record_batch([pa.array(leaf), pa.array(prints[index]), pa.array(home)], names=["leaf", "fp", "home"])

    def join(table: pa.Table) -> pa.Table:
        prints = table.column("fp").to_numpy().view(np.uint64)
        u, v = leaf_forest(prints, table.column("home").to_numpy(), radius)
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    visits = groups.select("fp").mapInArrow(route, "leaf long, fp long, home boolean")
    return visits.groupBy("leaf").applyInArrow(join, "u long, v long").where("u <> v")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the least doc_id that can be reached over links, the row's own included. Rows with a null doc_id
    take part in links and get their group's component_id (null if no row of the group has an id). Texts without
    words share fingerprint zero. Repeated rows are returned as often as they come.
    """
    prints = checkpointed(fingerprints(docs, width))
    groups = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = connected_components(links(groups, radius)).withColumnRenamed("node", "fp")
    rooted = checkpointed(groups.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

