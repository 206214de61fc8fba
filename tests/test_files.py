from __future__ import annotations

import io
import json
import struct

import pytest
from pyspark.sql import functions as F

from millrace import sinks, sources
from millrace.sources.access import AccessDenied, AccessPolicy
from millrace.sources.avro import read_avro


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "Alice", None), (2, "Bob, Jr", 2.5), (3, 'Q"x', -1.0)], "id int, name string, v double")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("ending", ["csv", "parquet", "jsonl", "csv.gz", "parquet"])
def test_copy_round_trip(spark, people, tmp_path, ending):
    path = str(tmp_path / f"out.{ending}")
    sinks.copy_to(people, path)
    assert (tmp_path / f"out.{ending}").is_file()
    back = {"csv": sources.read_csv, "par": sources.read_parquet, "jso": sources.read_json}[ending[:3]](spark, path)
    assert rows(back.select("id", "name", "v")) == rows(people)
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == [f"out.{ending}"]


def test_copy_array_and_partitions(spark, people, tmp_path):
    path = str(tmp_path / "a.json")
    sinks.copy_to(people, path, array=True)
    assert len(json.loads((tmp_path / "a.json").read_text())) == 3
    assert rows(sources.read_json(spark, path).select("id", "name", "v")) == rows(people)
    sinks.copy_to(people, str(tmp_path / "parts"), format="parquet", partition_by=["id"])
    assert (tmp_path / "parts" / "id=2").is_dir()
    assert rows(sources.read_parquet(spark, str(tmp_path / "parts")).select("id", "name", "v")) == rows(people)
    assert "id" not in sources.read_parquet(spark, str(tmp_path / "parts"), hive_partitioning=False).columns


def test_copy_errors(people):
    with pytest.raises(ValueError, match="relative path"):
        sinks.copy_to(people, "x.csv")
    with pytest.raises(ValueError, match="unknown COPY option"):
        sinks.copy_to(people, "/tmp/x.csv", shape="round")
    assert sinks.copy_to_stdout(people.where("id = 1")) == "1\tAlice\t\\N\n"


def test_copy_from(db, people, tmp_path):
    path = str(tmp_path / "p.csv")
    sinks.copy_to(people, path)
    db.sql("CREATE TABLE people (id INT, name STRING, v DOUBLE) USING parquet")
    assert sinks.copy_from(db, "people", path) == 3
    assert rows(db.table("people")) == rows(people)


def test_csv_sniffing(spark, tmp_path):
    (tmp_path / "w.csv").write_text("1|AA|2001-02-03||x y\n2|BB|2001-02-04|5|z\n")
    df = sources.read_csv(spark, str(tmp_path / "w.csv"))
    assert df.dtypes == [("column00", "bigint"), ("column01", "string"), ("column02", "date"), ("column03", "bigint"), ("column04", "string")]
    (tmp_path / "i.csv").write_text('"sepal.length","variety"\n5.1,"Se,tosa"\n.2,Virginica\n')
    df = sources.read_csv(spark, str(tmp_path / "i.csv"), normalize_names=True, filename=True)
    assert [(r.sepal_length, r.variety) for r in df.collect()] == [(5.1, "Se,tosa"), (0.2, "Virginica")]
    assert df.first().filename.endswith("i.csv")
    (tmp_path / "s.csv").write_text("# note\n# more\na;b\n1,5;NA\n2,5;x\n")
    df = sources.read_csv(spark, str(tmp_path / "s.csv"), skip=2, header=True, nullstr=["NA", ""], decimal_separator=",")
    assert sorted(map(tuple, df.collect())) == [(1.5, None), (2.5, "x")]
    df = sources.read_csv(spark, str(tmp_path / "w.csv"), names=["k"], types={"k": "integer"}, all_varchar=False)
    assert df.columns[:2] == ["k", "column01"] and df.dtypes[0][1] == "int"


def test_csv_samples_and_faults(spark, tmp_path):
    read = lambda name, **k: sources.read_csv(spark, str(tmp_path / name), **k)
    (tmp_path / "late.csv").write_text("a,b\n" + "".join(f"{i},x\n" for i in range(400)) + "word,y\n")
    assert dict(read("late.csv").dtypes)["a"] == "string" and read("late.csv").count() == 401
    assert dict(read("late.csv", sample_size=50).dtypes)["a"] == "bigint"
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read("late.csv", sample_size=50).collect()
    assert read("late.csv", sample_size=50, ignore_errors=True).count() == 400
    (tmp_path / "quoted.csv").write_text('a,b\n1,"two\nlines, ""here"""\n2,"x"\n')
    assert rows(read("quoted.csv")) == [(1, 'two\nlines, "here"'), (2, "x")]
    (tmp_path / "ragged.csv").write_text("a,b,c\n1,2,3\n4,5\n")
    with pytest.raises(Exception, match="MALFORMED"):
        read("ragged.csv").collect()
    assert rows(read("ragged.csv", null_padding=True)) == [(1, 2, 3), (4, 5, None)]
    assert rows(read("ragged.csv", ignore_errors=True)) == [(1, 2, 3)]
    assert read("ragged.csv", auto_type_candidates=["double", "varchar"], null_padding=True).dtypes[0][1] == "double"


def test_store_settings_reach_the_file_systems(spark):
    from millrace.sources.access import configure_store

    configure_store(spark, "s3", key_id="k", url_style="path")
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    assert (conf.get("fs.s3a.access.key"), conf.get("fs.s3a.path.style.access")) == ("k", "true")


def test_parquet_options(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    spark.range(2).select("id", F.lit("x").alias("extra")).write.parquet(str(tmp_path / "b"))
    both = sources.read_parquet(spark, [str(tmp_path / "a"), str(tmp_path / "b")], union_by_name=True, filename=True, file_row_number=True)
    assert both.count() == 5 and set(both.columns) == {"id", "extra", "filename", "file_row_number"}
    spark.createDataFrame([(bytearray(b"hi"),)], "b binary").write.parquet(str(tmp_path / "c"))
    assert sources.read_parquet(spark, str(tmp_path / "c"), binary_as_string=True).first()["b"] == "hi"


def test_text_and_blob(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"one\ntwo")
    text, blob = sources.read_text(spark, str(tmp_path / "x.txt")).first(), sources.read_blob(spark, str(tmp_path / "x.txt")).first()
    assert (text["content"], text["size"]) == ("one\ntwo", 7)
    assert (bytes(blob["content"]), blob["size"]) == (b"one\ntwo", 7)


def test_json_lines(spark, tmp_path):
    (tmp_path / "t.json").write_text("".join(json.dumps({"a": i, "b": f"json_{i}", "c": i + 0.5}) + "\n" for i in range(100)))
    df = sources.read_json(spark, str(tmp_path / "t.json"))
    assert df.count() == 100 and dict(df.dtypes) == {"a": "bigint", "b": "string", "c": "double"}


def test_access_policy(spark, tmp_path):
    policy = AccessPolicy(allowed_directories=["", str(tmp_path)])
    assert policy.check(f"{tmp_path}/a/b.csv")
    for bad in (f"{tmp_path}x/a.csv", f"{tmp_path}/../etc/passwd", "s3://bucket/x"):
        with pytest.raises(AccessDenied):
            policy.check(bad)
    with pytest.raises(AccessDenied):
        sources.read_csv(spark, "/x.csv", policy=AccessPolicy(external=False))
    with pytest.raises(AccessDenied):
        AccessPolicy(disabled=["file"]).check("/x")


def test_delta(spark, tmp_path):
    table, log = tmp_path / "d", tmp_path / "d" / "_delta_log"
    log.mkdir(parents=True)
    for i, folder in enumerate(("p=1", "p=2", "p=2")):
        sinks.copy_to(spark.range(i * 10, i * 10 + 2).select(F.col("id").cast("int").alias("a")), str(table / folder / ("f1.parquet" if i < 2 else "f2.parquet")))
    schema = {"type": "struct", "fields": [{"name": "a", "type": "integer", "nullable": True, "metadata": {}}, {"name": "p", "type": "integer", "nullable": True, "metadata": {}}]}
    add = lambda f, p: json.dumps({"add": {"path": f, "partitionValues": {"p": p}, "size": 1, "modificationTime": 0, "dataChange": True}})
    meta = json.dumps({"metaData": {"id": "x", "schemaString": json.dumps(schema), "partitionColumns": ["p"]}})
    (log / f"{0:020d}.json").write_text("\n".join([meta, add("p=1/f1.parquet", "1"), add("p=2/f1.parquet", "2")]))
    (log / f"{1:020d}.json").write_text("\n".join([json.dumps({"remove": {"path": "p=2/f1.parquet"}}), add("p=2/f2.parquet", "2")]))
    assert rows(sources.delta_scan(spark, str(table))) == [(0, 1), (1, 1), (20, 2), (21, 2)]
    assert rows(sources.delta_scan(spark, str(table), version=0)) == [(0, 1), (1, 1), (10, 2), (11, 2)]


def test_delta_mapped_columns_and_pruning(spark, tmp_path):
    table, log = tmp_path / "m", tmp_path / "m" / "_delta_log"
    log.mkdir(parents=True)
    for p in ("1", "2"):
        inner = F.struct(F.col("id").alias("col-y")).alias("col-s")
        sinks.copy_to(spark.range(int(p) * 10, int(p) * 10 + 2).select(F.col("id").cast("int").alias("col-a"), inner), str(table / f"f{p}.parquet"))
    mapped = lambda name, kind, physical: {"name": name, "type": kind, "nullable": True, "metadata": {"delta.columnMapping.physicalName": physical}}
    schema = {"type": "struct", "fields": [mapped("a", "integer", "col-a"), mapped("s", {"type": "struct", "fields": [mapped("y", "long", "col-y")]}, "col-s"), mapped("p", "integer", "col-p")]}
    add = lambda p: json.dumps({"add": {"path": f"f{p}.parquet", "partitionValues": {"col-p": p}, "size": 1, "modificationTime": 0, "dataChange": True}})
    meta = json.dumps({"metaData": {"id": "x", "schemaString": json.dumps(schema), "partitionColumns": ["p"], "configuration": {"delta.columnMapping.mode": "name"}}})
    (log / f"{0:020d}.json").write_text("\n".join([meta, add("1"), add("2")]))
    assert [(r.a, r.s.y, r.p) for r in sorted(sources.delta_scan(spark, str(table)).collect())] == [(10, 10, 1), (11, 11, 1), (20, 20, 2), (21, 21, 2)]
    (table / "f1.parquet").unlink()
    assert rows(sources.delta_scan(spark, str(table), partition_filter="p > 1").select("a")) == [(20,), (21,)]
    assert sources.delta_scan(spark, str(table), partition_filter="p > 2").count() == 0


def avro(schema: dict, records: list[dict]) -> bytes:
    """A container file with the types that manifests use."""

    def long(n: int) -> bytes:
        n = (n << 1) ^ (n >> 63)
        out = bytearray()
        while n & ~0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes([*out, n])

    def value(kind, v) -> bytes:
        if isinstance(kind, list):
            return long(kind.index("null")) if v is None else long(1) + value(kind[1], v)
        if isinstance(kind, dict):
            return b"".join(value(f["type"], v[f["name"]]) for f in kind["fields"])
        if kind in ("int", "long"):
            return long(v)
        if kind == "double":
            return struct.pack("<d", v)
        return long(len(v.encode())) + v.encode()

    body = b"".join(value(schema, r) for r in records)
    out = io.BytesIO()
    header = json.dumps(schema).encode()
    out.write(b"Obj\x01" + long(1) + long(11) + b"avro.schema" + long(len(header)) + header + long(0) + b"s" * 16)
    out.write(long(len(records)) + long(len(body)) + body + b"s" * 16)
    return out.getvalue()


def test_iceberg(spark, tmp_path):
    table = tmp_path / "ice"
    (table / "metadata").mkdir(parents=True)
    sinks.copy_to(spark.range(3).select("id", F.col("id").cast("string").alias("s")), str(table / "data" / "f.parquet"))
    entry = {"type": "record", "name": "e", "fields": [{"name": "status", "type": "int"}, {"name": "data_file", "type": {"type": "record", "name": "f", "fields": [{"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}, {"name": "size", "type": ["null", "long"]}]}}]}
    listed = {"type": "record", "name": "m", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "sequence_number", "type": "long"}, {"name": "content", "type": "int"}]}
    old = "file:/moved/ice"
    (table / "metadata" / "m.avro").write_bytes(avro(entry, [{"status": 1, "data_file": {"content": 0, "file_path": f"{old}/data/f.parquet", "size": None}}, {"status": 2, "data_file": {"content": 0, "file_path": f"{old}/data/gone.parquet", "size": 4}}]))
    (table / "metadata" / "l.avro").write_bytes(avro(listed, [{"manifest_path": f"{old}/metadata/m.avro", "sequence_number": 1, "content": 0}]))
    meta = {"location": old, "current-snapshot-id": 7, "current-schema-id": 0, "schemas": [{"schema-id": 0, "fields": [{"id": 1, "name": "id", "required": True, "type": "long"}, {"id": 2, "name": "s", "required": False, "type": "string"}]}], "snapshots": [{"sequence-number": 1, "snapshot-id": 7, "timestamp-ms": 1000, "manifest-list": f"{old}/metadata/l.avro"}]}
    (table / "metadata" / "v1.metadata.json").write_text(json.dumps(meta))
    (table / "metadata" / "version-hint.text").write_text("1")
    assert rows(sources.iceberg_scan(spark, str(table), allow_moved_paths=True)) == [(0, "0"), (1, "1"), (2, "2")]
    assert [(r.status, r.content) for r in sources.iceberg_metadata(spark, str(table), allow_moved_paths=True).collect()] == [("ADDED", "EXISTING"), ("DELETED", "EXISTING")]
    assert sources.iceberg_snapshots(spark, str(table)).first()["snapshot_id"] == 7
    assert read_avro((table / "metadata" / "l.avro").read_bytes())[0]["sequence_number"] == 1


def test_copy_file_names(spark, people, tmp_path):
    path = str(tmp_path / "named")
    for _ in range(2):
        sinks.copy_to(people.repartition(2), path, format="parquet", per_thread_output=True, append=True, filename_pattern="rows_{i}", file_extension="pq")
    names = sorted(p.name for p in (tmp_path / "named").glob("*.pq"))
    assert len(names) >= 2 and all(n.startswith("rows_") for n in names)
    assert sources.read_parquet(spark, path).count() == 6
    with pytest.raises(ValueError, match="without a counterpart"):
        sinks.copy_to(people, str(tmp_path / "x.parquet"), field_ids="auto")
