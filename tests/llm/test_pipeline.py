from __future__ import annotations

import corpus_pipeline

from .conftest import DATA


def test_stages(spark, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name == "mix_sources":
            assert out.count() == docs.count()
        else:
            assert out.schema == documents.schema
            assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "near_dedup", "decontaminate", "secret_scan", "mix_sources"]


def test_run(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and all(r.taken <= 3 * r.size for r in rows)


def test_odd_documents(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DATA)
        docs.count()


def test_run_equals_brute_force(spark):
    """The whole run against plain Python for each stage: the model's decisions row by row, all pairs of shingle sets,
    items as substrings of normalised texts, patterns by their definition, and the mix by SQL."""
    import re

    import pandas as pd

    from millrace.llm import mixing, quality, secrets

    from ..oracle import connection
    from .test_secrets import slow_base
    from .test_shingles import slow_groups, slow_set

    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, bench = spark.read.parquet(f"{DATA}/labels.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    good = {r.doc_id for r in quality.classify(documents, labels).where("keep").collect()}
    rows = sorted((r for r in documents.collect() if r.doc_id in good), key=lambda r: r.doc_id)
    rows = [rows[k] for k in sorted(set(slow_groups([slow_set(r.text) for r in rows])))]
    plain = lambda t: f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} "
    items = [plain(r.text) for r in bench.collect()]
    rows = [r for r in rows if not any(i in plain(r.text) for i in items)]

    def masked(text):
        out = list(text)
        for a, b, _ in sorted({*slow_base(text), *(s for s in secrets.spans(text) if s[2] == "guess")}):
            out[a:b] = [None] * (b - a)
        return re.sub("\0+", "[SECRET]", "".join("\0" if c is None else c for c in out))

    left = pd.DataFrame([(r.doc_id, masked(r.text), r.source) for r in rows], columns=["doc_id", "text", "source"])
    c = connection()
    c.register("left_over", left)
    expected = c.sql(mixing.MIX_SQL.replace("{docs}", "left_over")).fetchall()
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(expected)
