"""Near copies by the similarity of their word shingles (the pipeline's near_dedup stage).

Words are runs of non-white-space after lower-casing A-Z, as in ``simhash``; a text's shingles are the distinct runs
of ``WIDTH`` words (a shorter text has itself as its one shingle, a text without words has none). Two texts are linked
if the Jaccard similarity of their shingle sets is ``LEAST`` or more, or if the sets are equal.

Equal sets are collapsed first. Candidates come from operator 3: vantage-point trees over the fingerprints of these shingles
(``simhash.links``) connect all that differ in at most ``RADIUS`` bits. The similar pairs beyond that radius, most of them
at 0.8, share one of ``BANDS`` bands of ``ROWS`` min-hashes: a pair of similarity s is missed by the bands with a probability
of (1 - s**ROWS)**BANDS, 3e-6 at 0.8 and less above. What the trees connect is one more group of candidates beside the
groups that share a band, and all are confirmed in the same way. Each set is first compared exactly with
the least set of one of its bands, in chunks of bounded size; what that connects is a part and needs nothing more. Sets
that share a band and are in different parts are then compared exactly, in blocks of bounded size, each two blocks in one
task, through an index of prefixes that loses no pair; blocks of the largest part aren't compared with each other. Groups
of near copies thus cost their size; many texts that share a band and are not similar cost the square of their blocks.

Vantage-point trees alone can't do this: a similarity of 0.8 is about 10 of 64 bits, a radius at which a ball crosses
nearly every split. The README has the figures.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.common import checkpointed, mix64
from millrace.llm.components import connected_components, gathered

WIDTH, LEAST = 5, 0.8
#: Bytes of text of a chunk or block, and rows whose keys are broadcast (16 bytes each); beyond it they are joined by a shuffle.
CHUNK_BYTES, BROADCAST_ROWS = 4 << 20, 400_000
ROWS, BANDS = 5, 32
#: Bits in which fingerprints that the trees link differ at most, as in operator 3.
RADIUS = 2
SEED = 42
#: Shingles that are min-hashed at once.
_BLOCK = 1024
_random = np.random.default_rng(11)
_XOR = _random.integers(0, 2**63, ROWS * BANDS, dtype=np.int64).view(np.uint64)
_TIMES = _random.integers(0, 2**63, ROWS * BANDS, dtype=np.int64).view(np.uint64) | np.uint64(1)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles' hashes in ascending order."""
    return np.unique(simhash.shingle_hashes(text, width))


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.array(xxhash.xxh3_64_intdigest(shingles.tobytes(), SEED), np.uint64).view(np.int64))


def bands(shingles: np.ndarray) -> np.ndarray:
    """The hash of every band's min-hashes; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), _BLOCK):
            np.minimum(least, ((shingles[i : i + _BLOCK, None] ^ _XOR) * _TIMES).min(axis=0), out=least)
        key = np.arange(BANDS, dtype=np.uint64)
        for row in least.reshape(ROWS, BANDS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key.view(np.int64)


def _pairs_at(n: int, least: float) -> int:
    """The smallest k with k >= least * n, floats' errors apart."""
    return math.ceil(least * n - 1e-9)


def similar_groups(sets: list[np.ndarray], least: float = LEAST) -> np.ndarray:
    """For every non-empty set the number of the first set that is connected to it by links of similarity ``least``."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    _, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))  # rare shingles first
    flat = rank[ids]
    owner = np.repeat(np.arange(m), sizes)
    flat = flat[np.lexsort((flat, owner))]
    # Sets of similarity s share one of the first n - ceil(s * n) + 1 shingles of each in one order of all.
    lengths = sizes - np.array([_pairs_at(n, least) for n in sizes.tolist()], np.int64) + 1
    in_prefix = np.arange(len(flat)) - first[owner] < lengths[owner]
    order = np.argsort(flat[in_prefix], kind="stable")
    posted, posted_owner = flat[in_prefix][order], owner[in_prefix][order]
    at = np.searchsorted(posted, np.arange(len(often) + 1))
    label, marked = np.full(m, -1, np.int64), np.zeros(len(often), bool)
    left = np.arange(m)  # the sets that have no group yet
    for seed in range(m):
        if label[seed] >= 0:
            continue
        label[seed], queue = seed, [seed]
        left = left[label[left] < 0]
        while queue and len(left):
            x = queue.pop()
            own = flat[first[x] : first[x + 1]]
            prefix = own[: lengths[x]]
            if int((at[prefix + 1] - at[prefix]).sum()) < len(left):
                near = np.unique(np.concatenate([posted_owner[at[k] : at[k + 1]] for k in prefix.tolist()]))
                near = near[label[near] < 0]
            else:
                near = left
            near = near[(sizes[near] >= least * sizes[x] - 1e-9) & (sizes[x] >= least * sizes[near] - 1e-9)]
            if not len(near):
                continue
            marked[own] = True
            found = []
            for part in _parts(near, sizes):
                spans = np.concatenate([flat[first[k] : first[k + 1]] for k in part.tolist()])
                starts = np.concatenate(([0], np.cumsum(sizes[part])[:-1]))
                both = np.add.reduceat(marked[spans].astype(np.int64), starts)
                found += part[both >= least * (sizes[part] + sizes[x] - both) - 1e-9].tolist()
            marked[own] = False
            if found:
                label[found] = seed
                queue += found
                left = left[label[left] < 0]
    return label


def _parts(near: np.ndarray, sizes: np.ndarray, limit: int = 1 << 20) -> Iterator[np.ndarray]:
    """``near`` in runs of about ``limit`` shingles."""
    block = np.cumsum(sizes[near]) // limit
    yield from np.split(near, np.flatnonzero(np.diff(block)) + 1)


def with_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with two 64-bit hashes of the whole row in front, which rows share only if all their columns are equal."""
    cells = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t or t == "variant" else F.col(f"`{c}`") for c, t in docs.dtypes]
    key = lambda seed: F.xxhash64(F.lit(seed), *[c.isNull() for c in cells], *cells)
    return docs.select(key(1).alias("__millrace_k1"), key(2).alias("__millrace_k2"), *[F.col(f"`{c}`") for c in docs.columns])


KEYS = ["__millrace_k1", "__millrace_k2"]


def _sketches(keyed: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, sid, size, bands, fp) of every row; size: bytes that the set takes."""

    def run(batches):
        for batch in batches:
            sids, sizes, keys, prints = [], [], [], []
            for t in batch.column(3):
                hashes = simhash.shingle_hashes(t.as_py(), WIDTH)
                s = np.unique(hashes)
                prints.append(simhash.fingerprint_of(hashes))
                sids.append(set_id(s))
                keys.append(bands(s))
                sizes.append(8 * len(s) + 64)
            yield pa.record_batch([*batch.columns[:3], pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["k1", "k2", "doc_id", "sid", "size", "bands", "fp"])

    rows = keyed.select(F.col(KEYS[0]).alias("k1"), F.col(KEYS[1]).alias("k2"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "k1 long, k2 long, doc_id long, sid long, size long, bands array<long>, fp long")


def _few(rows: DataFrame) -> DataFrame:
    """``rows`` (of keys), to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _similar_to_leader(rows: pa.Table) -> pa.Table:
    """(u, v) of the sets of a chunk that are similar to the leader v, which is in the chunk as well."""
    v = rows.column("v")[0].as_py()
    sets = {sid: shingle_set(t.as_py()) for sid, t in zip(rows.column("sid").to_pylist(), rows.column("text"), strict=True)}
    leader, found = sets.pop(v), []
    for sid, s in sets.items():
        both = np.intersect1d(s, leader, assume_unique=True).size
        if both >= LEAST * (len(s) + len(leader) - both) - 1e-9:
            found.append(sid)
    return pa.table({"u": pa.array(found, pa.int64()), "v": pa.array([v] * len(found), pa.int64())})


def _joined_parts(rows: pa.Table) -> pa.Table:
    """(u, v): the parts of similar sets of a group of sets that they join."""
    part = dict(zip(rows.column("sid").to_pylist(), rows.column("part").to_pylist(), strict=True))
    sets = {sid: shingle_set(t.as_py()) for sid, t in zip(rows.column("sid").to_pylist(), rows.column("text"), strict=True)}
    names = sorted(sets)
    label = similar_groups([sets[k] for k in names]).tolist()
    pairs = {(part[k], part[names[at]]) for k, at in zip(names, label, strict=True)}
    pairs = sorted(p for p in pairs if p[0] != p[1])
    return pa.table({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})


def _chunks(total: str) -> Column:
    return F.ceil(F.col(total) / CHUNK_BYTES).cast("long")


def _verified(edges: DataFrame, sizes: DataFrame, texts: DataFrame) -> DataFrame:
    """The edges (u, v) whose sets are similar. The members of a leader v are dealt into chunks of bounded size, each with
    the leader's text, so that a leader of a large group takes many tasks."""
    leaders = edges.join(sizes.select(F.col("sid").alias("u"), "size"), "u").groupBy("v").agg(F.sum("size").alias("total"))
    leaders = leaders.select("v", _chunks("total").alias("chunks"))
    members = edges.join(leaders, "v").select("v", F.col("u").alias("sid"), F.pmod(F.xxhash64("u"), F.col("chunks")).alias("chunk"))
    heads = leaders.select("v", F.col("v").alias("sid"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    return members.unionByName(heads).join(texts, "sid").groupBy("v", "chunk").applyInArrow(_similar_to_leader, "u long, v long")


def _cells(edges: DataFrame, own: DataFrame, rows: int) -> DataFrame:
    """(v, i, j, sid, part): the sets that have an edge to v, and v itself, dealt into cells such that each two of them
    that are in different parts meet in one, unless all of them are in one part.

    own: (sid, size, part). The largest part of a star is cut into blocks i, the others into blocks j. Two blocks meet in
    cell (i, j), and two blocks of the others in cell (-1 - j, k), j < k."""
    star = gathered(edges.select("v", F.col("u").alias("sid")).unionByName(edges.select("v", F.col("v").alias("sid")).distinct()).join(own, "sid"), rows)
    parts = star.groupBy("v", "part").agg(F.sum("size").alias("weight"))
    largest = parts.groupBy("v").agg(F.count("*").alias("n"), F.max(F.struct("weight", "part")).alias("largest"), F.sum("weight").alias("all")).where("n > 1")
    largest = largest.withColumn("rest", F.col("all") - F.col("largest.weight")).withColumn("most", F.col("largest.weight"))
    largest = checkpointed(gathered(largest.select("v", F.col("largest.part").alias("center"), _chunks("most").alias("m"), _chunks("rest").alias("r")), rows))
    star = gathered(star.join(largest, "v"), rows).withColumn("inner", F.col("part") == F.col("center"))
    block = F.pmod(F.xxhash64("sid"), F.when(F.col("inner"), F.col("m")).otherwise(F.col("r")))
    zero = F.lit(0).cast("long")
    every = lambda n: F.sequence(zero, F.col(n) - 1)
    cell = lambda i, j: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))
    outer = F.concat(
        F.transform(every("m"), lambda i: cell(i, F.col("block"))),
        F.transform(F.filter(every("r"), lambda k: k != F.col("block")), lambda k: cell(-1 - F.least(k, F.col("block")), F.greatest(k, F.col("block")))),
    )
    cells = F.when(F.col("inner"), F.transform(every("r"), lambda j: cell(F.col("block"), j))).otherwise(outer)
    return star.withColumn("block", block).withColumn("cell", F.explode(cells)).select("v", "cell.i", "cell.j", "sid", "part")


def candidates(sets: DataFrame, prints: DataFrame) -> DataFrame:
    """(sid, band): sets are candidates for each other if they share a band. One is the tree's: the least fingerprint that
    links of the radius reach; the others are those of min-hashes. prints: (sid, fp) of the sets that aren't empty, with
    all fingerprints that a set has (they count repeats)."""
    roots = connected_components(simhash.links(checkpointed(prints.select("fp").distinct()), RADIUS))
    trees = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("sid", F.coalesce("root", "fp").alias("band"))
    return sets.select("sid", F.explode("bands").alias("band")).unionByName(trees)


def set_components(keyed: DataFrame, sets: DataFrame, prints: DataFrame) -> DataFrame:
    """(sid, part) of the sets that are connected to others; part is the least sid of the component.

    keyed: the rows with their keys; sets: (sid, k1, k2, size, bands), where k1, k2 are the key of a row with this set;
    prints: see ``candidates``."""
    banded = candidates(sets, prints)
    least = banded.groupBy("band").agg(F.min("sid").alias("v"), F.count("*").alias("n")).where("n > 1").select("band", "v")
    edges = checkpointed(banded.join(least, "band").where("sid <> v").select(F.col("sid").alias("u"), "v").distinct())
    n = edges.count()
    edges = gathered(edges, n)
    ends = edges.select(F.explode(F.array("u", "v")).alias("sid")).distinct()
    wanted = gathered(checkpointed(gathered(ends, n).join(sets.drop("bands"), "sid")), n)
    texts = keyed.select(F.col(KEYS[0]).alias("k1"), F.col(KEYS[1]).alias("k2"), F.col("text").cast("string").alias("text"))
    texts = texts.join(_few(wanted.select("k1", "k2", "sid")), ["k1", "k2"]).select("sid", "text")
    texts = checkpointed(texts.groupBy("sid").agg(F.min("text").alias("text")))  # repeated rows once

    links = checkpointed(_verified(edges.groupBy("u").agg(F.min("v").alias("v")), wanted, texts))
    parts = checkpointed(connected_components(links).select(F.col("node").alias("sid"), F.col("root").alias("part")))
    own = checkpointed(gathered(wanted.select("sid", "size").join(parts, "sid", "left"), n).select("sid", "size", F.coalesce("part", "sid").alias("part")))
    cells = _cells(edges, own, n)
    found = connected_components(cells.join(texts, "sid").groupBy("v", "i", "j").applyInArrow(_joined_parts, "u long, v long"))
    found = checkpointed(found.select(F.col("node").alias("part"), "root"))
    return own.join(found, "part", "left").select("sid", F.coalesce("root", "part").alias("part"))


def components(keyed: DataFrame) -> DataFrame:
    """(k1, k2, n, doc_id, component_id, stays) for every distinct row of ``keyed`` (with_keys): how often it comes, the
    least doc_id of its component (null if none of it has one), and whether it is the row of the component that stays:
    the least one by doc_id, nulls last, and then by key."""
    rows = checkpointed(_sketches(keyed))
    rows = rows.groupBy("sid", "k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("fp").alias("fp"), F.count("*").alias("n"))
    rows = checkpointed(rows)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    sets = checkpointed(rows.groupBy("sid").agg(F.min(order).alias("first"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    sets = sets.select("sid", "first", F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"), "size", "bands")
    prints = checkpointed(rows.where(F.size("bands") > 0).select("sid", "fp").distinct())
    parts = set_components(keyed, sets, prints)
    rooted = checkpointed(sets.select("sid", "first").join(parts, "sid", "left").select("sid", "first", F.coalesce("part", "sid").alias("part")))
    best = rooted.join(rooted.groupBy("part").agg(F.min("first").alias("best")), "part").select("sid", "best")
    out = rows.select("sid", "k1", "k2", "doc_id", "n").join(best, "sid")
    return out.select("k1", "k2", "n", "doc_id", F.col("best.doc_id").alias("component_id"), ((F.col("k1") == F.col("best.k1")) & (F.col("k2") == F.col("best.k2"))).alias("stays"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``: the least by doc_id (nulls last), then by a hash of the whole row.

    Texts count, not ids: different texts under one doc_id all stay, equal texts without a doc_id are one group, and of
    rows that are equal in all columns one stays. Null and empty texts are one group. Long texts are compared whole."""
    keyed = with_keys(docs)
    found = checkpointed(components(keyed))
    names = lambda rows: rows.select(F.col("k1").alias(KEYS[0]), F.col("k2").alias(KEYS[1]))
    repeated = found.where("stays and n > 1")
    gone = found.where("not stays or n > 1")
    kept = keyed.join(_few(names(gone)), KEYS, "left_anti").drop(*KEYS)
    if repeated.isEmpty():
        return kept
    return kept.unionByName(keyed.join(_few(names(repeated)), KEYS, "left_semi").dropDuplicates(KEYS).drop(*KEYS))
