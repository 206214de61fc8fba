from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

from millrace.llm import decontam

from .conftest import DATA


def slow_tiles(doc, item, least):
    """Greedy string tiling by its definition: the longest common run of unmarked words, again and again."""
    marked_d, marked_i, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in marked_i and d + n not in marked_d:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        if best[0] < least:
            return out
        n, i, d = best
        marked_i.update(range(i, i + n))
        marked_d.update(range(d, d + n))
        out.append((d, i, n))


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


@pytest.mark.parametrize("seed", range(12))
def test_tiling_equals_definition(seed):
    rng = random.Random(seed)
    item = [rng.choice("abcdefgh") + str(rng.randrange(3)) for _ in range(30)]
    pieces = [item[i : i + rng.randrange(3, 12)] for i in (0, 7, 15, 22)]
    rng.shuffle(pieces)
    doc = [w for p in pieces for w in [*p, *(rng.choice("xyz") for _ in range(rng.randrange(3)))]] + item[4:9]
    block = decontam.ItemBlock([7], [" ".join(item)], 3)
    found = decontam.leaks(pa.array([" ".join(doc)]), block, 0.0)
    covered = sum(t[2] for t in slow_tiles(doc, item, 3))
    assert sum(f[3] for f in found) == covered and all(f[4] == 30 for f in found)


def test_reordered_and_noisy(spark):
    a = "alpha beta gamma delta epsilon zeta eta theta"
    b = "iota kappa lambda mu nu xi omicron pi"
    bench = spark.createDataFrame([(1, f"{a}. {b}."), (2, "too short"), (3, None), (None, a)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(10, f"filler words {b.upper()}!! and {a.replace(' ', '*** ')} end"), (11, f"only {a}"), (12, "alpha beta gamma delta"), (13, None), (14, ""), (10, f"{a} {b}")],
        "doc_id long, text string",
    )
    got = sorted((r.doc_id, r.item_id, r.n_tiles, r.coverage) for r in decontam.leaked_pairs(docs, bench).collect())
    assert got == [(10, 1, 1, 1.0), (10, 1, 2, 1.0)]
    assert sorted(r.doc_id for r in decontam.without_leaks(docs, bench).collect()) == [11, 12, 13, 14]


def test_documents(spark, documents):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.leaked_pairs(documents, bench).collect()}
    items = {r.item_id: " ".join(words(r.text)) for r in bench.collect()}
    exact = {(r.doc_id, i) for r in documents.collect() for i, t in items.items() if f" {t} " in f" {' '.join(words(r.text))} "}
    assert exact and got == exact


def test_blocks_and_odd_rows(spark, documents, odd_documents, no_documents):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    whole = sorted(map(tuple, decontam.leaked_pairs(documents, bench).collect()))
    assert len(list(decontam.item_blocks(bench, block_bytes=500))) > 3
    pairs = []
    for block in decontam.item_blocks(bench, block_bytes=500):
        for r in documents.collect():
            pairs += [(r.doc_id, f[1]) for f in decontam.leaks(pa.array([r.text]), block, decontam.LEAST_COVERAGE)]
    assert sorted(pairs) == [w[:2] for w in whole]
    assert sorted(map(tuple, decontam.leaked_pairs(documents, bench, block_bytes=2000).collect())) == whole
    kept = sorted(map(tuple, decontam.without_leaks(documents, bench).collect()))
    assert kept == sorted(map(tuple, decontam.without_leaks(documents, bench, block_bytes=2000).collect()))
    assert {r[0] for r in kept} == {r.doc_id for r in documents.collect()} - {w[0] for w in whole}
    assert decontam.without_leaks(odd_documents, bench).count() == odd_documents.count()
    assert decontam.leaked_pairs(no_documents, bench).count() == 0
    assert decontam.leaked_pairs(odd_documents, bench.where("false")).count() == 0
    assert decontam.without_leaks(odd_documents, bench.where("false")).schema == odd_documents.schema


def test_short_items_and_scripts_without_spaces(spark):
    zh = "今天天气很好，我们去公园散步吧。"
    bench = spark.createDataFrame([(1, "What is 2 + 2?"), (2, "Yes"), (3, zh), (4, "สวัสดีครับ"), (5, "What is 2 + 2?")], "item_id long, text string")
    rows = [(1, "Q: what is 2+2? A: 4"), (2, "yes, it is"), (3, "YES!"), (4, f"前言{zh}后记"), (5, "今天天气 很好"), (6, "ก สวัสดี ครับ"), (7, "2 what is 2"), (8, "我们去公园散步吧，今天天气很好")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontam.leaked_pairs(docs, bench).collect())
    assert got == [(1, 1), (1, 5), (3, 2), (4, 3), (6, 4), (8, 3)]


def test_hot_seeds_in_bounded_parts(monkeypatch):
    """A passage that all items and all documents share, joined in small parts, against the definition."""
    monkeypatch.setattr(decontam, "MOST_PLACES", 7)
    rng = random.Random(9)
    hot = "please choose the best answer of the following four".split()
    items = [hot + [f"i{k}w{j}" for j in range(rng.randrange(2, 16))] for k in range(40)]
    docs = [hot * 2 + items[k][len(hot) :] + ["and"] + hot[:4] for k in range(0, 40, 3)] + [hot * 5]
    block = decontam.ItemBlock(list(range(40)), [" ".join(i) for i in items], 5)
    got = {(r, i): c for r, i, _, c, _ in decontam.leaks(pa.array([" ".join(d) for d in docs]), block, 0.6)}
    expected = {}
    for r, d in enumerate(docs):
        for i, item in enumerate(items):
            covered = sum(t[2] for t in slow_tiles(d, item, 5))
            if covered >= 0.6 * len(item):
                expected[r, i] = covered
    assert got == expected and len(got) > 40
