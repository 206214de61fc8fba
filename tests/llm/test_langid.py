from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from millrace.llm import langid

from .conftest import DATA


def slow_vector(text):
    """Bind and bundle by definition, one 3-gram at a time."""
    letters, (_, _, base) = langid._letters(), langid._vectors()
    symbols, out = [0], np.zeros(langid.DIMENSIONS)
    for c in text:
        s = int(letters[ord(c)])
        if s or symbols[-1]:
            symbols.append(s)
    if symbols[-1]:
        symbols.append(0)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
        if b:
            out += np.roll(base[a], 2).astype(int) * np.roll(base[b], 1) * base[c]
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def test_vectors():
    texts = ["The cat, the hat!", "", None, "1 2 3", "x", "Éa 日本 ß", "The cat, the hat!"]
    got, has = langid.text_vectors(pa.array(texts))
    assert has.tolist() == [True, False, False, False, True, True, True]
    for t, v in zip(texts, got, strict=True):
        assert np.allclose(v, slow_vector(t or ""), atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_odd_rows(odd_documents, no_documents):
    rows = langid.identify(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (3, 4, 5)} == {("und", 0.0)}
    assert langid.identify(no_documents).count() == 0
    nothing = langid.identify(odd_documents.withColumn("lang", odd_documents.lang.substr(100, 1)).where("doc_id = 1 and lang is null"))
    assert nothing.count() == 0
