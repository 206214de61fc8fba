from __future__ import annotations

import pytest

from millrace.llm import mixing

from ..oracle import connection
from .conftest import DATA


def oracle(rows):
    c = connection()
    c.register("documents", rows)
    return sorted(c.sql(mixing.MIX_SQL.replace("{docs}", "documents")).fetchall(), key=str)


def test_equals_sql(documents):
    got = sorted((tuple(r) for r in mixing.mix(documents).collect()), key=str)
    c = connection()
    expected = c.sql(mixing.MIX_SQL.replace("{docs}", f"'{DATA}/documents.parquet'")).fetchall()
    assert got == sorted(expected, key=str)
    assert got == sorted((tuple(r) for r in mixing.mix(documents.repartition(3)).collect()), key=str)


def test_near_targets(documents):
    rows = mixing.mix(documents.select("doc_id", "text", "source")).collect()
    source = {r.doc_id: r.source for r in documents.collect()}
    taken, target = {}, {}
    for r in rows:
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        target[source[r.doc_id]] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS for s in taken)
    assert sum(target.values()) == pytest.approx(sum(r.size for r in rows))


def test_reshared_targets(spark):
    sized = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 0), (None, 5)], "source string, size long")
    got = {r.source: (r.weight, r.target) for r in mixing.source_targets(sized).collect()}
    assert got == {"a": (1, 970.0), "b": (2, 30.0), "c": (3, 0.0), None: (1, 15.0)}


def test_schedule_is_spread(spark):
    sized = spark.createDataFrame([("a", 64_000), ("b", 64_000), ("c", 64_000)], "source string, size long")
    sources = mixing.with_blocks(mixing.source_targets(sized))
    rows = sorted((r.slot, r.key) for r in mixing.schedule(sources, 100).collect())
    need = {r.key: r.need for r in sources.collect()}
    for n in (300, 1000, 2500):
        for key, wanted in need.items():
            assert abs(sum(k == key for _, k in rows[:n]) - n * wanted / sum(need.values())) < 12


def test_odd_rows(odd_documents, no_documents):
    rows = mixing.mix(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert all(r.taken == 0 for r in rows if r.size == 0) and all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(no_documents).count() == 0
    assert mixing.mix(odd_documents.where("doc_id in (3, 4)")).count() == 2
    plain = odd_documents.select("doc_id", "text", "source").toPandas()
    assert sorted((tuple(r) for r in rows), key=str) == oracle(plain)
