from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import shingles, simhash


def slow_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def slow_groups(sets, least=0.8):
    """For every set the number of the first one of its component, by all pairs."""
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if (a == sets[j] or both >= least * len(a | sets[j]) - 1e-9) and label[i] != label[j]:
                p, q = sorted((label[i], label[j]))
                label = [p if k == q else k for k in label]
    return label


def test_groups_are_exact():
    random = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = random.choice(5000, random.integers(1, 120), replace=False)
        for _ in range(random.integers(1, 6)):
            part = base[random.random(len(base)) > 0.08]
            sets.append(np.unique(np.concatenate((part, random.choice(5000, random.integers(0, 4)), np.arange(10) if random.random() < 0.3 else part[:0], base[:1]))).astype(np.uint64))
    assert shingles.similar_groups(sets).tolist() == slow_groups([frozenset(s.tolist()) for s in sets])


def test_near_dedup_stage(spark):
    """The stage against all pairs, on documents with near copies."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    expected = {rows[k].doc_id for k in slow_groups([slow_set(r.text) for r in rows])}
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.schema == docs.schema
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(expected)


@pytest.mark.parametrize("changed, kept", [(1, [1]), (8, [1, 2])])
def test_edited_copy(spark, changed, kept):
    words = [f"w{i}" for i in range(100)]
    edited = [*words]
    for i in range(changed):
        edited[5 + 11 * i] = "other"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited).upper())], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == kept


def test_trees_give_candidates(spark):
    """Operator 3's trees connect texts whose fingerprints are near, without any band; texts that are far stay apart."""
    words = [f"w{i}" for i in range(2000)]
    texts = {1: words, 2: [*words[:999], "other", *words[1000:]], 3: [f"v{i}" for i in range(2000)]}
    prints = {k: simhash.fingerprint(" ".join(t), shingles.WIDTH) for k, t in texts.items()}
    assert 0 < (prints[1] ^ prints[2]).bit_count() <= shingles.RADIUS < (prints[1] ^ prints[3]).bit_count()
    rows = [(k, fp - (fp >> 63 << 64)) for k, fp in prints.items()]
    sets = spark.createDataFrame([(k, []) for k in texts], "sid long, bands array<long>")
    band = {r.sid: r.band for r in shingles.candidates(sets, spark.createDataFrame(rows, "sid long, fp long")).collect()}
    assert band[1] == band[2] != band[3]


def test_odd_rows(odd_documents, no_documents):
    kept = shingles.one_of_each_group(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 3, 6, 7, 8]
    assert shingles.one_of_each_group(no_documents).count() == 0


def test_texts_that_share_an_id_stay(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "x"), (None, c, "x"), (None, c, "x"), (None, c, None), (3, b, None), (3, b, None), (4, None, "x"), (5, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = sorted(map(tuple, shingles.one_of_each_group(docs).collect()), key=str)
    assert [r[:2] for r in kept if r[1] != c] == [(1, a), (1, b), (4, None)]
    assert len([r for r in kept if r[1] == c]) == 1


def test_chains_and_large_groups_in_small_chunks(spark, monkeypatch):
    """Groups over many chunks and blocks, chains whose ends aren't similar, and texts with a common passage."""
    monkeypatch.setattr(shingles, "CHUNK_BYTES", 3000)
    random = np.random.default_rng(4)
    common, texts = [f"c{i}" for i in range(60)], []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(80)]
        for _ in range(12):
            edited = [*words]
            edited[random.integers(80)] = f"e{random.integers(999)}"
            texts.append(" ".join(edited))
    chain = [f"h{i}" for i in range(100)]
    for step in range(12):
        texts.append(" ".join(chain))
        chain[8 * step : 8 * step + 4] = [f"new{step}x{i}" for i in range(4)]
    texts += [" ".join(common + [f"own{k}x{i}" for i in range(40)]) for k in range(25)]
    border = [f"b{i}" for i in range(120)]
    for _ in range(80):  # two to five changed places each: some are similar, some share bands only
        edited = [*border]
        for at in random.integers(0, 120, random.integers(2, 6)):
            edited[at] = f"e{random.integers(9)}"
        texts.append(" ".join(edited))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    label = slow_groups([slow_set(t) for t in texts])
    assert 30 < len(set(label)) < 120 < len(texts)
    assert sorted(r.doc_id for r in shingles.one_of_each_group(docs).collect()) == sorted(set(label))
