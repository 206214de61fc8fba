from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import quality

from .conftest import DATA


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(DATA.replace("0.001", "0.01") + "/labels.parquet")


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet")


def slow_model(texts):
    """Interpolated modified Kneser-Ney by its definition, as a function of (context classes, class)."""
    grams = {k: {} for k in range(1, 5)}
    for t in texts:
        s = [0, 0, 0, *quality.CLASSES[np.frombuffer(t.encode(), np.uint8)].tolist()]
        for i in range(3, len(s)):
            g = tuple(s[i - 3 : i + 1])
            grams[4][g] = grams[4].get(g, 0) + 1
    for k in (3, 2, 1):
        for g in grams[k + 1]:
            grams[k][g[1:]] = grams[k].get(g[1:], 0) + 1

    def discounts(k):
        n = [sum(c == j for c in grams[k].values()) for j in range(5)]
        y = n[1] / max(1, n[1] + 2 * n[2])
        return [max(0.1 * j, j - (j + 1) * y * n[j + 1] / n[j]) if n[j] else 0.5 * j for j in (1, 2, 3)]

    d = {k: discounts(k) for k in grams}
    cut = lambda k, c: min(d[k][min(c, 3) - 1], 0.95 * c)

    def p(g):
        k = len(g)
        if not k:
            return 1 / 64
        inside = {x: c for x, c in grams[k].items() if x[:-1] == g[:-1]}
        if not inside:
            return p(g[1:])
        total = sum(inside.values())
        own = inside.get(g, 0)
        return (max(0, own - cut(k, own)) / total if own else 0) + sum(cut(k, c) for c in inside.values()) / total * p(g[1:])

    return p


def test_model_equals_definition(spark):
    texts = ["the cat sat on the mat", "a cat and a hat, the hat", "Was it a cat I saw?"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = quality.train(docs)["en"]
    p = slow_model(texts)
    for text in ("the cat", "zzz", "Hat!"):
        data = np.frombuffer(text.encode(), np.uint8)
        codes = quality.gram_codes(data, np.array([0, len(data)]))
        known, at = np.unique(codes, return_inverse=True)
        got = model.probabilities(known.astype(np.int64))[at]
        expected = [p(tuple((int(c) >> (6 * j)) & 63 for j in (3, 2, 1, 0))) for c in codes]
        assert got == pytest.approx(expected)
        _, nats = quality.score_rows(["en"], pa.array([text]), {"en": model, "*": model})
        assert nats[0] == pytest.approx(-sum(map(math.log, expected)) / len(expected), rel=1e-5)
    everything = np.arange(64) | (5 << 6)
    assert model.probabilities(everything).sum() == pytest.approx(1)


def test_keeps_good_and_rejects_junk(larger, labels):
    rows = {r.doc_id: r.keep for r in quality.classify(larger, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    good = [rows[i] for i, q in truth.items() if q == 1]
    bad = [rows[i] for i, q in truth.items() if q == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.35
    kept = quality.keep_good(larger, labels)
    assert kept.schema == larger.schema
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i, k in rows.items() if k)


def test_odd_rows(spark, odd_documents, no_documents, labels):
    good = spark.createDataFrame([(1, 1, 0), (6, 1, None), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.classify(odd_documents, good).collect()
    assert len(rows) == odd_documents.count()
    assert all(r.perplexity is None and not r.keep for r in rows if r.n_bytes == 0)
    assert quality.keep_good(odd_documents, good).schema == odd_documents.schema
    none = good.where("false")
    assert quality.keep_good(odd_documents, none).count() == odd_documents.count()
    assert quality.classify(odd_documents, none).where("keep").count() == 0
    assert quality.classify(no_documents, good).count() == 0


def test_rare_grams_go_to_lower_orders(spark):
    """A bounded model still has probabilities that sum to one, and its 4-grams are the most frequent ones."""
    docs = spark.createDataFrame([(i, "ab" * 40 + "xyz"[i % 3] * (i + 1), "en") for i in range(9)], "doc_id long, text string, lang string")
    whole, small = (quality.train(docs, most)["en"] for most in (1 << 20, 4))
    assert 0 < len(small.grams[3][0]) <= 4 < len(whole.grams[3][0])
    assert set(small.grams[3][0]) <= set(whole.grams[3][0])
    for ctx in (int(small.grams[3][0][0]) >> 6, int(whole.grams[3][0][-1]) >> 6):
        codes = (ctx << 6) | np.arange(64)
        assert small.probabilities(codes).sum() == pytest.approx(1)
        assert small.nats(codes) == pytest.approx(-np.log(small.probabilities(codes)), rel=1e-4)


def test_rare_grams_are_joined(spark):
    """Whatever number of 4-grams is broadcast, perplexities are those of the whole model and the same rows are kept."""
    docs = spark.createDataFrame([(i % 290, f"text {i * i} of {'abcdefg'[i % 7] * (i % 5)} words, {i % 11}", ("en", "de", None)[i % 3]) for i in range(300)], "doc_id long, text string, lang string")
    docs = docs.unionByName(docs.limit(20))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 290, 2)], "doc_id long, quality int, toxic int")
    key = lambda r: (r.doc_id, r.lang or "", r.n_bytes, r.perplexity)
    whole = sorted(quality.classify(docs, labels).collect(), key=key)
    for most in (0, 40):
        models, rest = quality.fit(quality.rows_of(docs, quality.good_ids(labels).where("trains")), most)
        assert all(len(m.grams[3][0]) <= most for m in models.values()) and rest.count() > 100
        got = sorted(quality.classify(docs, labels, most).collect(), key=key)
        assert [r.perplexity for r in got] == pytest.approx([r.perplexity for r in whole], rel=1e-4) and len(got) == 320
        assert sorted(quality.keep_good(docs, labels, most).select("doc_id").collect()) == sorted((r.doc_id,) for r in got if r.keep)


def test_bounds_are_quantiles(spark):
    random = np.random.default_rng(2)
    rows = [(i, "en" if i % 3 else "xx", int(n), float(x)) for i, (n, x) in enumerate(zip(random.integers(20, 5000, 3000), random.normal(2, 0.2, 3000), strict=True))]
    rows += [(9000 + i, "few", 500, 3.0 + 0.01 * i) for i in range(9)]
    got = quality.thresholds(spark.createDataFrame([*rows, *rows[:50]], "doc_id long, lang string, n_bytes long, nats double"))

    def bounds(z):
        low, mid, high = np.quantile(z, [quality.LOWER, 0.5, quality.UPPER], method="inverted_cdf")
        return low - quality.MARGIN * (mid - low), high + quality.MARGIN * (high - mid)

    of = {}
    for lang in ("en", "xx", "few"):
        n, x = np.array([r[2:] for r in rows if r[1] == lang]).T
        of[lang] = quality.excess(n, x, np.quantile(x, 0.5))
    pooled = bounds(np.concatenate(list(of.values())))
    for lang, z in of.items():
        low, high = bounds(z)
        assert got[lang][1:] == pytest.approx((min(low, pooled[0]), max(high, pooled[1])) if lang == "few" else (low, high), abs=0.06)


def test_labels(spark):
    rows = [(1, 1, 0), (1, 0, 0), (2, 1, None), (2, 1, 1), (3, 1, None), (3, 1, 0), (4, None, 0), (None, 1, 0)]
    labels = spark.createDataFrame([*rows, *((i, 1, 0) for i in range(100, 1100))], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.trains, r.held) for r in quality.good_ids(labels).collect()}
    assert set(got) == {2, 3, *range(100, 1100)} and not got[2][0] and all(t != h for i, (t, h) in got.items() if i != 2)
    assert 200 < sum(h for _, h in got.values()) < 300


def test_bounds_without_held_out_texts(spark):
    """Held-out ids of which no document is there: the bounds are those of the training, for both forms."""
    prose = "a plain sentence of words that reads like all the others here, number "
    docs = spark.createDataFrame([(i, prose + str(i), "en") for i in range(400)] + [(9999, "#### $$$$ %%%% ****" * 9, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    held = {r.doc_id for r in quality.good_ids(labels).where("held").collect()}
    docs = docs.where(~docs.doc_id.isin(list(held)))
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {r.doc_id for r in quality.classify(docs, labels).where("keep").collect()}
    assert 9999 not in kept and len(kept) > 0.95 * docs.count()
