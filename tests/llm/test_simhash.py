from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import components, simhash


def slow_fingerprint(text, width=3):
    words = [w for w in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    value = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s.encode(), 42) >> bit & 1 for s in shingles) > len(shingles):
            value |= 1 << bit
    return value


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "a b c d", "É b c\x0bd e\x1cf g", "x y x y x y x"])
def test_fingerprint(spark, text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)
    if text and len(text.split()) == 3:
        assert simhash.fingerprint(text) == xxhash.xxh64_intdigest(" ".join(text.split()).lower(), 42)
        got = spark.range(1).select(F.xxhash64(F.lit(" ".join(text.split()).lower())).alias("h")).first()["h"]
        assert got & (2**64 - 1) == simhash.fingerprint(text)


def brute(prints, ids):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 2) + i + 1:
            parent[find(j)] = find(i)
    least = {}
    for i in range(len(prints)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(prints))]


@pytest.mark.parametrize("local", [12_000, 60])
def test_links_are_exact(spark, monkeypatch, local):
    """Over many leaves, and over few leaves that are split again in their tasks."""
    monkeypatch.setattr(simhash, "LEAF_SIZE", 40)
    monkeypatch.setattr(simhash, "LOCAL_LEAF", local)
    if local == 60:
        monkeypatch.setattr(simhash, "MOST_LEAVES", 2)
    random = np.random.default_rng(5)
    base = random.integers(0, 2**63, 600, dtype=np.int64).view(np.uint64)
    near = np.concatenate([base[:300] ^ (np.uint64(1) << random.integers(0, 64, 300).astype(np.uint64)) for _ in range(3)])
    ball = np.repeat(base[:1], 500)
    for _ in range(3):
        ball = ball ^ (np.uint64(1) << random.integers(0, 64, 500).astype(np.uint64))
    prints = np.unique(np.concatenate([base, near, ball]))
    groups = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long").repartition(5)
    roots = {r.node: r.root for r in components.connected_components(simhash.links(groups)).collect()}
    signed = prints.view(np.int64).tolist()
    assert [roots.get(x, x) for x in signed] == brute(prints, signed)


def test_near_duplicates(spark, documents):
    rows = simhash.near_duplicates(documents).collect()
    prints = np.array([int(r.fingerprint, 16) for r in rows], np.uint64)
    assert [r.component_id for r in rows] == brute(prints, [r.doc_id for r in rows])
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert all(int(r.fingerprint, 16) == slow_fingerprint(texts[r.doc_id]) for r in rows[:20])


def test_odd_rows(odd_documents, no_documents):
    rows = simhash.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[1] == by[1] and {c for _, c in by[2]} == {1}
    assert by[3] == by[4] == by[5] == {("0" * 16, 3)}
    assert simhash.near_duplicates(no_documents).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.root for r in components.connected_components(edges).collect()} == {0}
    assert components.connected_components(edges.where("false")).count() == 0
