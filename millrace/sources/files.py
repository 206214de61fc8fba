"""Readers for Parquet, CSV, JSON, text and binary files."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.time import date_pattern
from millrace.sources.access import OPEN, AccessPolicy
from millrace.types import spark_type

Paths = str | list[str]


def _checked(paths: Paths, policy: AccessPolicy) -> list[str]:
    found = [paths] if isinstance(paths, str) else list(paths)
    if not found:
        raise ValueError("no path is given")
    return [policy.check(p) for p in found]


def _extras(df: DataFrame, filename: bool, row_number: bool = False) -> DataFrame:
    extra = {}
    if filename:
        extra["filename"] = F.col("_metadata.file_path")
    if row_number:
        extra["file_row_number"] = F.col("_metadata.row_index")
    return df.select("*", *[c.alias(n) for n, c in extra.items()]) if extra else df


def read_parquet(spark: SparkSession, paths: Paths, binary_as_string: bool = False, filename: bool = False, file_row_number: bool = False, hive_partitioning: bool = True, union_by_name: bool = False, policy: AccessPolicy = OPEN) -> DataFrame:
    """Parquet files. union_by_name: columns that some files lack are null there. Without hive_partitioning folder
    names such as k=1 give no columns."""
    reader = spark.read.option("mergeSchema", str(union_by_name).lower())
    if not hive_partitioning:
        reader = reader.option("recursiveFileLookup", "true")
    if binary_as_string:  # of the session, while the schema is read
        before = spark.conf.get("spark.sql.parquet.binaryAsString", "false")
        spark.conf.set("spark.sql.parquet.binaryAsString", "true")
        try:
            df = reader.parquet(*_checked(paths, policy))
        finally:
            spark.conf.set("spark.sql.parquet.binaryAsString", before)
        if any(t == "binary" for _, t in df.dtypes):
            df = df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t == "binary"})
    else:
        df = reader.parquet(*_checked(paths, policy))
    return _extras(df, filename, file_row_number)


def sniff_delimiter(lines: list[str], quote: str = '"') -> str:
    """Of , | ; and tab the one that splits all lines into the same number of fields, the most of them."""
    best = (0, ",")
    for candidate in (",", "|", ";", "\t"):
        counts = Counter(len(re.sub(rf"{re.escape(quote)}[^{re.escape(quote)}]*{re.escape(quote)}", "", x).split(candidate)) for x in lines if x)
        if counts:
            fields, lines_with = counts.most_common(1)[0]
            if fields > 1 and lines_with >= 0.9 * sum(counts.values()) and fields > best[0]:
                best = (fields, candidate)
    return best[1]


def _looks_typed(value: str) -> bool:
    return bool(re.fullmatch(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|\d{4}-\d{2}-\d{2}.*|true|false", value.strip(), re.IGNORECASE))


def has_header(lines: list[list[str]]) -> bool:
    """Is the first line a header? If its fields are all text and distinct, and a later line has a typed field there."""
    if len(lines) < 2:
        return False
    first = lines[0]
    if any(_looks_typed(v) or not v.strip() for v in first) or len(set(first)) < len(first):
        return False
    return any(_looks_typed(v) for row in lines[1:] for v in row)


def _normalized(name: str) -> str:
    out = re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_")
    return f"_{out}" if not out or out[0].isdigit() else out


def read_csv(
    spark: SparkSession,
    paths: Paths,
    *,
    delim: str | None = None,
    sep: str | None = None,
    quote: str = '"',
    escape: str = '"',
    header: bool | None = None,
    skip: int = 0,
    names: list[str] | None = None,
    types: list[str] | dict[str, str] | None = None,
    nullstr: str | list[str] = "",
    all_varchar: bool = False,
    auto_detect: bool = True,
    sample_size: int = 20_480,
    dateformat: str | None = None,
    timestampformat: str | None = None,
    decimal_separator: str = ".",
    ignore_errors: bool = False,
    null_padding: bool = False,
    normalize_names: bool = False,
    compression: str | None = None,
    filename: bool = False,
    union_by_name: bool = False,
    hive_partitioning: bool = True,
    force_not_null: list[str] | None = None,
    auto_type_candidates: list[str] | None = None,
    new_line: str | None = None,
    max_line_size: int = 2_097_152,
    quoted_newlines: bool | None = None,
    policy: AccessPolicy = OPEN,
) -> DataFrame:
    """CSV files. Delimiter, header and types are found from the first ``sample_size`` lines where they aren't given;
    columns without names are column00, column01, ... (a digit more than the last needs at least one). Quoted values may
    hold line ends: files in whose sample they do are read whole, each by one task (``quoted_newlines`` says it).

    A line with another number of fields than the sample's fails the read; with null_padding a shorter one is filled up
    with nulls, and with ignore_errors such lines, and lines whose fields don't fit their types, are dropped."""
    found = _checked(paths, policy)
    if union_by_name and len(found) > 1:
        frames = [read_csv(spark, p, delim=delim, sep=sep, quote=quote, escape=escape, header=header, skip=skip, names=names, types=types, nullstr=nullstr, all_varchar=all_varchar, auto_detect=auto_detect, sample_size=sample_size, dateformat=dateformat, timestampformat=timestampformat, decimal_separator=decimal_separator, ignore_errors=ignore_errors, null_padding=null_padding, normalize_names=normalize_names, filename=filename, force_not_null=force_not_null, auto_type_candidates=auto_type_candidates, new_line=new_line, max_line_size=max_line_size, quoted_newlines=quoted_newlines, compression=compression, policy=policy) for p in found]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out
    lines = [r[0] for r in spark.read.option("recursiveFileLookup", str(not hive_partitioning).lower()).text(found[0]).select("value").limit(skip + max(1, sample_size)).collect()][skip:]
    multiline = quoted_newlines if quoted_newlines is not None else auto_detect and any(x.count(quote) % 2 for x in lines)
    delimiter = delim or sep or (sniff_delimiter(lines, quote) if auto_detect else ",")
    cut = _split_lines(lines, delimiter, quote)
    header = has_header(cut) if header is None and auto_detect and not names else bool(header)
    width = max(map(len, cut), default=0)
    if names is None:
        digits = max(2, len(str(max(0, width - 1))))
        default = [f"column{i:0{digits}d}" for i in range(width)]
        names = [*cut[0], *default[len(cut[0]) :]] if header and cut else default
    else:
        names = [*names, *[f"column{i:02d}" for i in range(len(names), width)]]
    if normalize_names:
        names = [_normalized(n) for n in names]
    nulls = [nullstr] if isinstance(nullstr, str) else list(nullstr)
    options = {"sep": delimiter, "quote": quote, "escape": escape, "header": str(header and skip == 0).lower(), "nullValue": nulls[0], "mode": "DROPMALFORMED" if ignore_errors else "PERMISSIVE" if null_padding else "FAILFAST", "enforceSchema": "true", "comment": "\x00", "multiLine": str(multiline).lower(), "maxCharsPerColumn": str(max_line_size)}
    if new_line:
        options["lineSep"] = {"\\n": "\n", "\\r\\n": "\r\n", "\\r": "\r"}.get(new_line, new_line)
    if compression and compression not in ("auto", "none"):
        options["compression"] = compression
    schema = ", ".join(f"`{n}` STRING" for n in names)
    if skip:  # the first lines of each file have the lowest numbers in a read of that file alone
        frames = []
        parse = {k: v for k, v in options.items() if k not in ("header", "enforceSchema", "comment", "compression", "multiLine", "lineSep")}
        if multiline:
            raise ValueError("skip and line ends in quoted values don't go together")
        parse["mode"] = "PERMISSIVE" if ignore_errors else parse["mode"]
        for path in found:
            rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("filename"), F.monotonically_increasing_id().alias("_i"))
            rows = rows.where(F.col("_i") >= skip + int(header)).select(F.from_csv("value", schema, parse).alias("_x"), "filename")
            frames.append(rows.select("_x.*", *(["filename"] if filename else [])))
        df = frames[0]
        for f in frames[1:]:
            df = df.unionByName(f)
    else:
        df = _extras(spark.read.options(**options).schema(schema).csv(found), filename)
    own = set(force_not_null or ())
    text = {n: F.when(~F.col(f"`{n}`").isin(*nulls), F.col(f"`{n}`")) if n not in own else F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names}
    df = df.select(*[text[n].alias(n) for n in names], *(["filename"] if filename else []))
    if all_varchar:
        return df
    given = dict(zip(names, types, strict=False)) if isinstance(types, list) else dict(types or {})
    kinds = {n: spark_type(given[n]).simpleString() for n in names if n in given}
    if auto_detect:
        sample = cut[1 if header else 0 :]
        wanted = {spark_type(t).simpleString() for t in auto_type_candidates} if auto_type_candidates else None
        for i, n in enumerate(names):
            if n not in kinds:
                kinds[n] = _sniffed([r[i] for r in sample if i < len(r) and r[i] not in nulls], dateformat, decimal_separator, wanted)
    out, fits = [], F.lit(True)
    for n in names:
        c, kind = F.col(f"`{n}`"), kinds.get(n, "string")
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = F.replace(c, F.lit(decimal_separator), F.lit(".")) if decimal_separator != "." else c
        if kind == "date" and dateformat:
            c = F.to_date(c, date_pattern(dateformat))
        elif kind.startswith("timestamp") and timestampformat:
            c = F.to_timestamp(c, date_pattern(timestampformat)).cast(kind)
        elif kind != "string":
            if ignore_errors:
                fits = fits & (c.isNull() | c.try_cast(kind).isNotNull())
            c = c.try_cast(kind) if ignore_errors else c.cast(kind)
        out.append(c.alias(n))
    return (df.where(fits) if ignore_errors else df).select(*out, *(["filename"] if filename else []))


def _split_lines(lines: list[str], delimiter: str, quote: str) -> list[list[str]]:
    import csv

    rows = [r for r in csv.reader((f"{x}\n" for x in lines), delimiter=delimiter, quotechar=quote) if r]
    # A sample may end inside a quoted value, and its last line then looks longer or shorter than it is.
    return rows[:-1] if len(rows) > 2 and "".join(lines).count(quote) % 2 else rows


def _sniffed(values: list[str], dateformat: str | None, decimal_separator: str, wanted: set[str] | None = None) -> str:
    """The narrowest of bigint, double, boolean, date, timestamp and text that fits all values."""
    if not values:
        return "string"
    number = re.escape(decimal_separator)
    checks = (
        ("boolean", r"(?i)true|false"),
        ("bigint", r"[-+]?\d{1,18}"),
        ("double", rf"[-+]?(?:\d+(?:{number}\d*)?|{number}\d+)(?:[eE][-+]?\d+)?"),
        ("date", r"\d{4}-\d{1,2}-\d{1,2}"),
        ("timestamp_ntz", r"\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?"),
    )
    for kind, pattern in checks:
        if (wanted is None or kind in wanted) and all(re.fullmatch(pattern, v.strip()) for v in values):
            return kind
    if dateformat and all(re.search(r"\d", v) for v in values):
        return "date"
    return "string"


def read_json(spark: SparkSession, paths: Paths, format: str = "auto", records: bool = True, ignore_errors: bool = False, union_by_name: bool = True, compression: str | None = None, dateformat: str | None = None, timestampformat: str | None = None, sample_size: int = 20_480, schema: str | None = None, filename: bool = False, policy: AccessPolicy = OPEN) -> DataFrame:
    """JSON files: one document a line, or an array ("array"; found from the first byte with "auto")."""
    found = _checked(paths, policy)
    if format == "auto":
        head = spark.read.text(found[0]).where("trim(value) <> ''").limit(1).collect()
        first = head[0][0].lstrip() if head else "{"
        # A line that is an object by itself is one of many; else the file is one document.
        format = "newline_delimited" if first.startswith("{") and first.rstrip().endswith("}") else "array"
    reader = spark.read.option("multiLine", str(format in ("array", "unstructured")).lower()).option("mode", "DROPMALFORMED" if ignore_errors else "FAILFAST")
    for key, value in (("dateFormat", dateformat), ("timestampFormat", timestampformat)):
        if value:
            reader = reader.option(key, date_pattern(value))
    if compression and compression not in ("auto", "none", "uncompressed"):
        reader = reader.option("compression", compression)
    if schema:
        reader = reader.schema(schema)
    df = _extras(reader.json(found), filename)
    return df if records else df.select(F.struct("*").alias("json"))


def read_text(spark: SparkSession, paths: Paths, policy: AccessPolicy = OPEN) -> DataFrame:
    """(filename, content, size, last_modified): a row for each file."""
    df = spark.read.text(_checked(paths, policy), wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("filename"), F.col("value").alias("content"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("last_modified"))


def read_blob(spark: SparkSession, paths: Paths, policy: AccessPolicy = OPEN) -> DataFrame:
    """(filename, content, size, last_modified): a row with the bytes of each file."""
    df = spark.read.format("binaryFile").load(_checked(paths, policy))
    return df.select(F.col("path").alias("filename"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))
