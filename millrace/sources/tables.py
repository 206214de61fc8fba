"""Delta and Iceberg tables, read from their own metadata. Metadata is read through Spark, data by its Parquet reader."""

from __future__ import annotations

import json
import re
from posixpath import basename, join
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.access import OPEN, AccessPolicy
from millrace.sources.avro import read_avro


def _files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Names in a folder, through the file system that Spark has for it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    return sorted(n for s in fs.listStatus(path) if re.fullmatch(pattern, n := s.getPath().getName()))


def _bytes(spark: SparkSession, path: str) -> bytes:
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    if not rows:
        raise FileNotFoundError(path)
    return bytes(rows[0][0])


# ----------------------------------------------------------------------------------------------------- Delta

#: Type names of Delta's and Iceberg's schemas that differ from the session's.
_ICEBERG = {"boolean": "boolean", "int": "int", "long": "bigint", "float": "float", "double": "double", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "string": "string", "uuid": "string", "binary": "binary"}


def _physical(kind: T.DataType) -> T.DataType:
    """A type with the names that mapped columns have in the files."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.metadata.get("delta.columnMapping.physicalName", f.name), _physical(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_physical(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(_physical(kind.keyType), _physical(kind.valueType))
    return kind


def delta_scan(spark: SparkSession, path: str, version: int | None = None, partition_filter: str | None = None, policy: AccessPolicy = OPEN) -> DataFrame:
    """A Delta table at its latest or a given version: checkpoint, then the log's adds and removes in order. Mapped columns
    are read by their names in the files. partition_filter: a condition on partition columns, as SQL, by which files are
    left out before they are opened."""
    log = join(policy.check(path), "_delta_log")
    versions = [int(n[:20]) for n in _files(spark, log, r"\d{20}\.json") if version is None or int(n[:20]) <= version]
    checkpoints = [n for n in _files(spark, log, r"\d{20}\.checkpoint(\.\d+\.\d+)?\.parquet") if version is None or int(n[:20]) <= version]
    if not versions and not checkpoints:
        raise FileNotFoundError(f"no Delta log at {path}")
    active: dict[str, dict] = {}
    schema, partitions, start = None, [], -1
    if checkpoints:
        start = max(int(n[:20]) for n in checkpoints)
        parts = [join(log, n) for n in checkpoints if int(n[:20]) == start]
        for row in spark.read.parquet(*parts).toLocalIterator():
            r = row.asDict(recursive=True)
            if r.get("metaData"):
                schema, partitions = json.loads(r["metaData"]["schemaString"]), list(r["metaData"].get("partitionColumns") or [])
            if r.get("add"):
                active[r["add"]["path"]] = {"partitionValues": dict(r["add"].get("partitionValues") or {}), "deletionVector": r["add"].get("deletionVector")}
    for v in versions:
        if v <= start:
            continue
        for line in _bytes(spark, join(log, f"{v:020d}.json")).decode().splitlines():
            action = json.loads(line) if line.strip() else {}
            if "metaData" in action:
                schema, partitions = json.loads(action["metaData"]["schemaString"]), action["metaData"].get("partitionColumns", [])
            if "add" in action:
                active[action["add"]["path"]] = action["add"]
            if "remove" in action:
                active.pop(action["remove"]["path"], None)
    if schema is None:
        raise ValueError(f"the Delta log at {path} has no schema")
    if any(a.get("deletionVector") for a in active.values()):
        raise ValueError("Delta tables with deletion vectors are not read")
    full = T.StructType.fromJson(schema)
    plain = [f for f in full.fields if f.name not in partitions]
    stored = {f.name: f.metadata.get("delta.columnMapping.physicalName", f.name) for f in full.fields}
    value_of = lambda p, c: (active[p].get("partitionValues") or {}).get(stored[c])
    if partition_filter and active:
        texts = spark.createDataFrame([(p, *[value_of(p, c) for c in partitions]) for p in active], "`__path` string" + "".join(f", `{c}` string" for c in partitions))
        typed = texts.select("__path", *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in full.fields if f.name in partitions])
        chosen = {r[0] for r in typed.where(partition_filter).select("__path").collect()}  # one row for each file
        active = {p: a for p, a in active.items() if p in chosen}
    if not active:
        return spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in full.fields]))
    names = {p: p if urlsplit(p).scheme else join(path, unquote(p)) for p in active}
    df = spark.read.schema(_physical(T.StructType(plain))).parquet(*names.values())
    if any(stored[f.name] != f.name for f in plain) or _physical(T.StructType(plain)) != T.StructType([T.StructField(f.name, f.dataType) for f in plain]):
        df = df.select(*[F.col(f"`{stored[f.name]}`").cast(f.dataType).alias(f.name) for f in plain], F.col("_metadata"))
    if partitions:  # values are in the log, one row for each file; the join is on the file's path below the table
        parts = 1 + max(unquote(p).count("/") for p in active if not urlsplit(p).scheme) if any(not urlsplit(p).scheme for p in active) else 1 + len(partitions)
        rows = [("/".join(n.split("/")[-parts:]), *[value_of(p, c) for c in partitions]) for p, n in names.items()]
        values = spark.createDataFrame(rows, "`__file` string, " + ", ".join(f"`{c}` string" for c in partitions))
        tagged = df.withColumn("__file", F.substring_index(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "/", -parts))
        df = tagged.join(values, "__file").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in full.fields])
    return df.select(*[f.name for f in full.fields])


# --------------------------------------------------------------------------------------------------- Iceberg


def _iceberg_metadata(spark: SparkSession, path: str, version: str | None, version_name_format: str) -> dict:
    """The table's metadata file: the path itself, a given version, the hinted one, or the newest."""
    if path.endswith(".metadata.json"):
        return json.loads(_bytes(spark, path))
    folder = join(path, "metadata")
    if version is None:
        hint = _files(spark, folder, r"version-hint\.text")
        version = _bytes(spark, join(folder, hint[0])).decode().strip() if hint else None
    tries = [join(folder, f.replace("%s", version, 1).replace("%s", "")) for f in version_name_format.split(",")] if version is not None else []
    names = _files(spark, folder, r".*\.metadata\.json")
    for t in tries:
        if basename(t) in names:
            return json.loads(_bytes(spark, t))
    if not names:
        raise FileNotFoundError(f"no Iceberg metadata at {path}")
    number = lambda n: int(m[0]) if (m := re.search(r"\d+", n)) else -1
    return json.loads(_bytes(spark, join(folder, max(names, key=number))))


def _moved(location: str, old: str, new: str, allow: bool) -> str:
    """A file's place if the table was moved as a whole."""
    if not allow:
        return location
    if location.startswith(old.rstrip("/") + "/"):
        return join(new, location[len(old.rstrip("/")) + 1 :])
    for part in ("/metadata/", "/data/"):
        if part in location:
            return new.rstrip("/") + part + location.split(part, 1)[1]
    return location


def _root(path: str) -> str:
    return path.rsplit("/metadata/", 1)[0] if path.endswith(".metadata.json") else path


def _manifests(spark: SparkSession, path: str, meta: dict, snapshot_id: int | None, allow_moved_paths: bool) -> list[tuple[dict, list[dict]]]:
    chosen = meta.get("current-snapshot-id") if snapshot_id is None else snapshot_id
    snapshot = next((s for s in meta.get("snapshots", []) if s["snapshot-id"] == chosen), None)
    if snapshot is None:
        return []
    place = lambda x: _moved(x, meta.get("location", ""), _root(path), allow_moved_paths)
    listed = read_avro(_bytes(spark, place(snapshot["manifest-list"])))
    return [(m, read_avro(_bytes(spark, place(m["manifest_path"])))) for m in listed]


_CONTENT = {0: "EXISTING", 1: "POSITION_DELETES", 2: "EQUALITY_DELETES"}
_STATUS = {0: "EXISTING", 1: "ADDED", 2: "DELETED"}


def iceberg_scan(spark: SparkSession, path: str, allow_moved_paths: bool = False, version: str | None = None, version_name_format: str = "v%s%s.metadata.json,%s%s.metadata.json", snapshot_id: int | None = None, policy: AccessPolicy = OPEN) -> DataFrame:
    """An Iceberg table at a snapshot: the live data files of its manifests. Tables with delete files are rejected."""
    meta = _iceberg_metadata(spark, policy.check(path), version, version_name_format)
    schemas = meta.get("schemas") or [meta["schema"]]
    schema = next((s for s in schemas if s.get("schema-id") == meta.get("current-schema-id")), schemas[-1])
    full = T.StructType([T.StructField(f["name"], _iceberg_type(f["type"]), not f.get("required", False)) for f in schema["fields"]])
    files = []
    for manifest, entries in _manifests(spark, path, meta, snapshot_id, allow_moved_paths):
        for e in entries:
            if e["status"] == 2:
                continue
            if manifest.get("content", 0) or e["data_file"].get("content", 0):
                raise ValueError("Iceberg tables with delete files are not read")
            files.append(_moved(e["data_file"]["file_path"], meta.get("location", ""), _root(path), allow_moved_paths))
    if not files:
        return spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in full.fields]))
    return spark.read.schema(full).parquet(*files)


def _iceberg_type(kind) -> T.DataType:
    if isinstance(kind, dict):
        if kind["type"] == "list":
            return T.ArrayType(_iceberg_type(kind["element"]))
        if kind["type"] == "map":
            return T.MapType(_iceberg_type(kind["key"]), _iceberg_type(kind["value"]))
        return T.StructType([T.StructField(f["name"], _iceberg_type(f["type"])) for f in kind["fields"]])
    if m := re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", kind):
        return T.DecimalType(int(m[1]), int(m[2]))
    if kind.startswith("fixed"):
        return T.BinaryType()
    return T._parse_datatype_string(_ICEBERG[kind])


def iceberg_metadata(spark: SparkSession, path: str, allow_moved_paths: bool = False, version: str | None = None, version_name_format: str = "v%s%s.metadata.json,%s%s.metadata.json", policy: AccessPolicy = OPEN) -> DataFrame:
    """(manifest_path, manifest_sequence_number, manifest_content, status, content, file_path) of the current snapshot."""
    meta = _iceberg_metadata(spark, policy.check(path), version, version_name_format)
    rows = []
    for m, entries in _manifests(spark, path, meta, None, allow_moved_paths):
        kind = "DELETE" if m.get("content", 0) else "DATA"
        rows += [(m["manifest_path"], m.get("sequence_number", 0), kind, _STATUS[e["status"]], _CONTENT[e["data_file"].get("content", 0)], e["data_file"]["file_path"]) for e in entries]
    return spark.createDataFrame(rows, "manifest_path string, manifest_sequence_number long, manifest_content string, status string, content string, file_path string")


def iceberg_snapshots(spark: SparkSession, path: str, version: str | None = None, version_name_format: str = "v%s%s.metadata.json,%s%s.metadata.json", policy: AccessPolicy = OPEN) -> DataFrame:
    """(sequence_number, snapshot_id, timestamp_ms, manifest_list) of all snapshots."""
    meta = _iceberg_metadata(spark, policy.check(path), version, version_name_format)
    rows = [(s.get("sequence-number", 0), s["snapshot-id"], s["timestamp-ms"], s.get("manifest-list")) for s in meta.get("snapshots", [])]
    df = spark.createDataFrame(rows, "sequence_number long, snapshot_id long, timestamp_ms long, manifest_list string")
    return df.withColumn("timestamp_ms", F.timestamp_millis("timestamp_ms").cast("timestamp_ntz"))
