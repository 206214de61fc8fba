from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace import sql, tables
from millrace.streaming import buckets


def values(spark, name):
    return sorted((tuple(r) for r in spark.table(name).collect()), key=str)


def test_dml(db):
    tables.create_table(db, "a", "id INT, name STRING, value DOUBLE")
    tables.insert(db.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, name string"), "a", ["id", "name"], {"value": F.lit(1.5)})
    tables.update(db, "a", {"value": "value + id", "name": "upper(name)"}, "id >= 2")
    assert values(db, "a") == [(1, "x", 1.5), (2, "Y", 3.5), (3, None, 4.5)]
    tables.delete(db, "a", "name = 'Y'")
    assert values(db, "a") == [(1, "x", 1.5), (3, None, 4.5)]
    with pytest.raises(ValueError):
        tables.update(db, "a", {"nope": "1"})
    tables.truncate(db, "a")
    assert values(db, "a") == []


def test_alter(db):
    tables.create_table(db, "b", "id INT, v STRING")
    tables.insert(db.createDataFrame([(1, "7")], "id int, v string"), "b")
    tables.add_column(db, "b", "extra", "int", "5")
    tables.alter_type(db, "b", "v", "bigint")
    tables.rename_column(db, "b", "v", "w")
    tables.drop_column(db, "b", "id")
    tables.rename_table(db, "b", "c")
    assert db.table("c").dtypes == [("w", "bigint"), ("extra", "int")] and values(db, "c") == [(7, 5)]
    with pytest.raises(ValueError):
        tables.drop_column(db, "c", "id")


def test_constraints(db):
    tables.create_table(db, "k", "id INT, n INT", tables.Constraints(not_null=["id"], checks={"small": "n < 10"}, unique=[["id"]]))
    frame = lambda *r: db.createDataFrame(list(r), "id int, n int")
    tables.insert(frame((1, 2), (2, None)), "k")
    for bad in ((None, 1), (3, 10), (1, 3)):
        with pytest.raises(tables.ConstraintViolation):
            tables.insert(frame(bad), "k")
    with pytest.raises(tables.ConstraintViolation):
        tables.update(db, "k", {"id": "1"})
    tables.drop_constraint(db, "k", check="small")
    tables.insert(frame((3, 10)), "k")
    assert db.table("k").count() == 3
    tables.drop_table(db, "k")


def test_ctas_and_materialized_view(db):
    tables.create_table_as(db.range(3), "src")
    tables.create_table_as(db.range(3), "empty", with_data=False)
    assert db.table("empty").count() == 0
    tables.create_materialized_view(db, "mv", "SELECT id % 2 AS k, count(*) AS n FROM src WHERE 'x' = 'x' GROUP BY 1")
    db.range(10, 14).write.insertInto("src")
    assert values(db, "mv") == [(0, 2), (1, 1)]
    tables.refresh_materialized_view(db, "mv")
    tables.refresh_materialized_view(db, "t.mv")
    assert values(db, "mv") == [(0, 4), (1, 3)]
    with pytest.raises(ValueError, match="not a materialized view"):
        tables.refresh_materialized_view(db, "src")
    tables.create_temporary_table_as(db.table("src").where("id > 11"), "temporary")
    assert values(db, "temporary") == [(12,), (13,)]


def test_partitions_and_constraints_follow(db):
    """Rewrites keep partitions; constraints and defaults are found by any name of the table and follow its columns."""
    rules = tables.Constraints(not_null=["id"], checks={"positive": "id > 0", "short": "length(name) < 5 OR name = 'id'"}, unique=[["id", "k"]])
    tables.create_table(db, "p", "id INT, name STRING, k INT", rules, ["k"], {"name": "'none'"})
    frame = lambda *r: db.createDataFrame(list(r), "id int, k int")
    tables.insert(frame((1, 1), (2, 1), (3, 2)), "p")
    tables.delete(db, "p", "id = 2")
    tables.rename_column(db, "p", "id", "number")
    assert [c.name for c in db.catalog.listColumns("p") if c.isPartition] == ["k"]
    assert values(db, "p") == [(1, "none", 1), (3, "none", 2)]
    for name in ("p", "t.p", "spark_catalog.t.p"):
        with pytest.raises(tables.ConstraintViolation, match="positive"):
            tables.insert(db.createDataFrame([(-5, 1)], "number int, k int"), name)
    tables.drop_column(db, "t.p", "name")
    assert tables.constraints(db, "p") == tables.Constraints(["number"], {"positive": "`number` > 0"}, [["number", "k"]])
    with pytest.raises(tables.ConstraintViolation):
        tables.insert(db.createDataFrame([(3, 2)], "number int, k int"), "p")
    tables.set_default(db, "p", "k", "7")
    tables.insert(db.createDataFrame([(9,)], "number int"), "p")
    assert values(db, "p")[-1] == (9, 7)


def test_stored_view(db):
    tables.create_stored_view(db, "sv", "SELECT id * 2 AS d FROM range(3)")
    tables.rename_view(db, "sv", "sw")
    assert values(db.newSession(), "t.sw") == [(0,), (2,), (4,)] and tables.drop_view(db, "sw") and not tables.drop_view(db, "sw")


def test_views(spark):
    tables.create_view(spark.range(2), "v1")
    tables.rename_view(spark, "v1", "v2")
    assert spark.table("v2").count() == 2 and tables.drop_view(spark, "v2")


def test_sql_and_prepared(spark):
    people = spark.createDataFrame([(1, "a'b"), (2, "c")], "id int, name string")
    assert [r.id for r in sql.sql(spark, "SELECT r['id'] FROM {people} r WHERE r['name'] = 'a''b'", people=people).collect()] == [1]
    people.createOrReplaceTempView("people")
    p = sql.prepare(spark, "SELECT id, '$1' AS s FROM people WHERE id = $1 OR name = $2", ["int", "string"])
    assert [tuple(r) for r in p.execute(1, "zz").collect()] == [(1, "$1")]
    assert [r.id for r in p.execute(9, "c").collect()] == [2]
    with pytest.raises(ValueError):
        p.execute(1)
    spark.createDataFrame([("1", "a")], "id string, name string").createOrReplaceTempView("people")
    with pytest.raises(ValueError, match="result type"):
        p.execute(1, "a")
    sql.register_functions(spark)
    assert spark.sql("SELECT time_bucket_micros(604800000000L, TIMESTAMP_NTZ'2023-01-15 12:00:00') AS b").first().b == dt.datetime(2023, 1, 9)


def test_stream_matches_batch(spark, tmp_path):
    rows = spark.range(200).select((F.lit(1_700_000_000) + F.col("id") * 97).cast("timestamp").cast("timestamp_ntz").alias("ts"), (F.col("id") % 3).alias("k"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    batch = buckets.bucketed(rows, "ts", "1 hour", "1 hour", ["k"], n=F.count("*"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = buckets.bucketed(stream, "ts", "1 hour", "1 hour", ["k"], n=F.count("*")).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, batch.collect()))
    assert buckets.sessions(rows, "ts", "60 seconds", "1 hour", ["k"], n=F.count("*")).count() == 200
