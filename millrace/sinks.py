"""COPY: writing query results to files, and loading files into tables."""

from __future__ import annotations

import uuid
from posixpath import dirname, join

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.functions.time import date_pattern
from millrace.operators.checkpoints import checkpointed
from millrace.sources.access import OPEN, AccessPolicy
from millrace.sources.files import read_csv, read_json, read_parquet

_SUFFIXES = {".parquet": "parquet", ".json": "json", ".ndjson": "json", ".jsonl": "json", ".csv": "csv"}
_CODECS = {".gz": "gzip", ".zst": "zstd"}
OPTIONS = frozenset("format partition_by use_tmp_file overwrite_or_ignore overwrite append filename_pattern file_extension per_thread_output file_size_bytes write_partition_columns array compression dateformat timestampformat nullstr prefix suffix compression_level field_ids row_group_size_bytes row_group_size row_groups_per_file header delimiter delim sep quote escape max_records_per_file".split())

#: Options of the host that no writer here can honour; they are refused rather than passed over.
_REFUSED = frozenset(("field_ids", "row_groups_per_file", "prefix", "suffix"))


def file_format(path: str, given: str | None = None) -> tuple[str, str | None]:
    """(format, compression) from the option or the path's endings."""
    name, codec = path.rsplit("/", 1)[-1].lower(), None
    for suffix, c in _CODECS.items():
        if name.endswith(suffix):
            name, codec = name.removesuffix(suffix), c
    found = given or next((f for s, f in _SUFFIXES.items() if name.endswith(s)), None)
    if found is None:
        raise ValueError(f"can't tell the format of {path}; give the format option")
    return found.lower(), codec


def _require_absolute(path: str) -> None:
    if not path.startswith("/") and "://" not in path:
        raise ValueError("relative path not allowed for COPY to file")


def copy_to(df: DataFrame, path: str, policy: AccessPolicy = OPEN, **options) -> None:
    """Write rows to ``path``.

    By default the path is one file, as COPY makes it: one writer, put in place by a rename, so a failure leaves no
    half-written file. With ``partition_by`` or ``per_thread_output`` it is a folder that all tasks write to; that is
    the form for large results.
    """
    unknown = set(options) - OPTIONS
    if unknown:
        raise ValueError(f"unknown COPY option: {', '.join(sorted(unknown))}")
    refused = sorted(set(options) & _REFUSED)
    if refused:
        raise ValueError(f"COPY option without a counterpart: {', '.join(refused)}")
    _require_absolute(path)
    policy.check(path)
    kind, codec = file_format(path, options.get("format"))
    partition_by = options.get("partition_by") or []
    partition_by = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    folder = bool(partition_by or options.get("per_thread_output"))
    if partition_by and options.get("write_partition_columns"):
        df = df.withColumns({f"__{c}": F.col(c) for c in partition_by})
        df = df.withColumnsRenamed({**{c: f"_p_{c}" for c in partition_by}, **{f"__{c}": c for c in partition_by}})
        partition_by = [f"_p_{c}" for c in partition_by]
    if kind == "json" and options.get("array"):
        df, kind = _array_lines(df), "text"
    mode = "append" if options.get("append") else "overwrite" if options.get("overwrite") or options.get("overwrite_or_ignore") or not folder else "errorifexists"
    writer_options = _writer_options(kind, codec, options)
    if folder:
        writer = df.write.mode(mode).options(**writer_options)
        (writer.partitionBy(*partition_by) if partition_by else writer).format(kind).save(path)
        if options.get("filename_pattern") or options.get("file_extension"):
            _rename_parts(df.sparkSession, path, options.get("filename_pattern") or "data_{i}", options.get("file_extension") or kind)
        return
    spark = df.sparkSession
    work = join(dirname(path), f".{uuid.uuid4().hex}.tmp")
    df.coalesce(1).write.mode("errorifexists").options(**writer_options).format(kind).save(work)
    _put_in_place(spark, work, path)


def _array_lines(df: DataFrame) -> DataFrame:
    """The lines of a JSON array, one element a line, so that no row holds more than one element. The brackets and commas
    follow from each line's number and the number of lines, which is counted first."""
    rows = checkpointed(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")))
    n = rows.count()
    if not n:
        return df.sparkSession.createDataFrame([("[]",)], "value string")
    numbered = rows.coalesce(1).select("value", F.monotonically_increasing_id().alias("i"))  # one file has one writer
    return numbered.select(F.concat(F.when(F.col("i") == 0, "[").otherwise("\t"), F.col("value"), F.when(F.col("i") == n - 1, "]").otherwise(",")).alias("value"))


def _writer_options(kind: str, codec: str | None, options: dict) -> dict[str, str]:
    out: dict[str, str] = {}
    compression = options.get("compression") or codec
    if compression:
        out["compression"] = {"uncompressed": "none", "auto": "none"}.get(compression, compression)
    elif kind == "parquet":
        out["compression"] = "snappy"
    if kind == "csv":
        out |= {"header": str(options.get("header", True)).lower(), "sep": options.get("delimiter") or options.get("delim") or options.get("sep") or ",", "quote": options.get("quote", '"'), "escape": options.get("escape", '"'), "nullValue": options.get("nullstr", ""), "emptyValue": '""'}
    if kind == "json":
        out["ignoreNullFields"] = "false"
    for option, key in (("dateformat", "dateFormat"), ("timestampformat", "timestampFormat")):
        if options.get(option):
            out[key] = date_pattern(options[option])
            if key == "timestampFormat":
                out["timestampNTZFormat"] = out[key]
    for option, key in (("row_group_size_bytes", "parquet.block.size"), ("row_group_size", "parquet.block.row.count.limit"), ("max_records_per_file", "maxRecordsPerFile"), ("compression_level", "parquet.compression.codec.zstd.level")):
        if options.get(option):
            out[key] = str(options[option])
    return out


def _put_in_place(spark: SparkSession, work: str, path: str) -> None:
    """Move the only part of a written folder to ``path``, by the file system that Spark has for it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new = jvm.org.apache.hadoop.fs.Path
    fs = new(work).getFileSystem(conf)
    parts = [s.getPath() for s in fs.listStatus(new(work)) if s.getPath().getName().startswith("part-")]
    target = new(path)
    if fs.exists(target):
        fs.delete(target, True)
    if parts:
        if not fs.rename(parts[0], target):
            raise OSError(f"can't write {path}")
        check = new(f"{dirname(path)}/.{parts[0].getName()}.crc")
        if fs.exists(check):
            fs.delete(check, False)
    fs.delete(new(work), True)


def _rename_parts(spark: SparkSession, folder: str, pattern: str, extension: str) -> None:
    """Give the written part files names by a pattern with {i} or {uuid}; files from before keep theirs."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new = jvm.org.apache.hadoop.fs.Path
    fs = new(folder).getFileSystem(conf)
    listing, number = fs.listFiles(new(folder), True), 0
    parts = []
    while listing.hasNext():
        p = listing.next().getPath()
        if p.getName().startswith("part-"):
            parts.append(p)
    for p in sorted(parts, key=lambda p: p.toString()):
        while True:
            name = pattern.replace("{i}", str(number)).replace("{uuid}", uuid.uuid4().hex)
            name = name if "{" in pattern else f"{name}{number}"
            number += 1
            target = new(p.getParent(), f"{name}.{extension.lstrip('.')}")
            if not fs.exists(target):
                break
        fs.rename(p, target)


def copy_from(spark: SparkSession, table: str, path: str, policy: AccessPolicy = OPEN, **options) -> int:
    """Append a file's rows to a table, by position and with the table's types; gives the number of rows."""
    _require_absolute(path)
    kind, _ = file_format(path, options.pop("format", None))
    target = spark.table(table).schema
    if kind == "csv":
        rows = read_csv(spark, path, all_varchar=True, header=options.pop("header", True), policy=policy, **options)
    elif kind == "json":
        rows = read_json(spark, path, policy=policy, **options).select(*target.names)
    else:
        rows = read_parquet(spark, path, policy=policy, **options)
    if len(rows.columns) != len(target):
        raise ValueError(f"{path} has {len(rows.columns)} columns, {table} has {len(target)}")
    typed = rows.select(*[F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(rows.columns, target.fields, strict=True)])
    seen = Observation()
    typed.observe(seen, F.count(F.lit(1)).alias("n")).write.insertInto(table)
    return seen.get["n"]


def copy_to_stdout(df: DataFrame, delimiter: str = "\t", null: str = "\\N") -> str:
    """The rows as COPY prints them. For small results: they come to the driver."""
    lines = []
    for row in df.toLocalIterator():
        lines.append(delimiter.join(null if v is None else ("t" if v else "f") if isinstance(v, bool) else str(v).replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n") for v in row))
    return "".join(f"{x}\n" for x in lines)
