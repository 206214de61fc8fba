"""SQL text: row subscripts, prepared statements, and functions that SQL can call."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_STRING = re.compile(r"'(?:[^']|'')*'")
_SUBSCRIPT = re.compile(r"\b([A-Za-z_]\w*)\s*\[\s*'([^']+)'\s*\]")
_PLACEHOLDER = re.compile(r"\$(\d+)")


def row_subscripts(text: str, aliases: set[str] | None = None) -> str:
    """r['col'] as r.`col` for row aliases (all names, or the given ones). Strings elsewhere stay as they are."""
    return _SUBSCRIPT.sub(lambda m: f"{m[1]}.`{m[2]}`" if aliases is None or m[1] in aliases else m[0], text)


def outside_strings(text: str, change, strings: str | None = None) -> str:
    """``change`` of all but the strings in a text; strings: what to write in their place."""
    out, at = [], 0
    for m in _STRING.finditer(text):
        out += [change(text[at : m.start()]), m[0] if strings is None else strings]
        at = m.end()
    return "".join([*out, change(text[at:])])


def sql(spark: SparkSession, text: str, args: dict | list | None = None, rows: set[str] | None = None, **frames: DataFrame) -> DataFrame:
    """Run SQL in which r['col'] names a column of a row alias, with the functions of SQL_FUNCTIONS and RENAMED; ``frames``
    are DataFrames named as {name}."""
    register_functions(spark)
    text = renamed_calls(row_subscripts(text, rows))
    return spark.sql(text, args=args, **frames) if args is not None else spark.sql(text, **frames)


@dataclass
class Prepared:
    """A statement with $1, $2, ...; planned anew at each execution, with the columns that it had at first."""

    spark: SparkSession
    text: str
    types: list[str] = field(default_factory=list)
    schema: T.StructType | None = None

    def execute(self, *values) -> DataFrame:
        names = sorted({int(n) for n in _PLACEHOLDER.findall(_STRING.sub("''", self.text))})
        if names and (names[-1] > len(values) or len(values) > max(names[-1], len(self.types))):
            raise ValueError(f"wrong number of parameters: {names[-1]} needed, {len(values)} given")
        typed = lambda m: f"CAST(:p{m[1]} AS {self.types[int(m[1]) - 1]})" if len(self.types) >= int(m[1]) else f":p{m[1]}"
        text = outside_strings(row_subscripts(self.text), lambda part: _PLACEHOLDER.sub(typed, part))
        df = self.spark.sql(text, args={f"p{i}": v for i, v in enumerate(values, 1)} if names else None)
        shape = [(f.name, f.dataType) for f in df.schema.fields]
        if self.schema is not None and shape != [(f.name, f.dataType) for f in self.schema.fields]:
            raise ValueError("cached plan must not change result type")
        self.schema = df.schema
        return df


def prepare(spark: SparkSession, text: str, types: list[str] | None = None) -> Prepared:
    return Prepared(spark, text, list(types or []))


_MICROS = "unix_micros(CAST(ts AS TIMESTAMP))"
_WIDTH = "CAST(extract(DAY FROM width) * 86400000000L + extract(HOUR FROM width) * 3600000000L + extract(MINUTE FROM width) * 60000000L + extract(SECOND FROM width) * 1000000 AS BIGINT)"
_MONTHS = "(year(ts) - 2000) * 12 + month(ts) - 1"
#: SQL functions with native bodies: name, parameters, result, body. A name has one signature, as the session has it: time
#: stamps (dates are taken as such), JSON text, maps from text to text.
SQL_FUNCTIONS: tuple[tuple[str, str, str, str], ...] = (
    ("time_bucket", "width INTERVAL DAY TO SECOND, ts TIMESTAMP_NTZ", "TIMESTAMP_NTZ", f"CAST(timestamp_micros({_MICROS} - pmod({_MICROS} - 946857600000000L, {_WIDTH})) AS TIMESTAMP_NTZ)"),
    ("time_bucket_micros", "width BIGINT, ts TIMESTAMP_NTZ", "TIMESTAMP_NTZ", f"CAST(timestamp_micros({_MICROS} - pmod({_MICROS} - 946857600000000L, width)) AS TIMESTAMP_NTZ)"),
    ("time_bucket_months", "width INT, ts TIMESTAMP_NTZ", "TIMESTAMP_NTZ", f"CAST(add_months(DATE'2000-01-01', {_MONTHS} - pmod({_MONTHS}, width)) AS TIMESTAMP_NTZ)"),
    ("epoch", "ts TIMESTAMP_NTZ", "DOUBLE", f"{_MICROS} / 1000000D"),
    ("epoch_ms", "ts TIMESTAMP_NTZ", "BIGINT", f"CAST(round({_MICROS} / 1000D) AS BIGINT)"),
    ("epoch_us", "ts TIMESTAMP_NTZ", "BIGINT", _MICROS),
    ("epoch_ns", "ts TIMESTAMP_NTZ", "BIGINT", f"{_MICROS} * 1000"),
    ("make_timestamp_us", "n BIGINT", "TIMESTAMP_NTZ", "CAST(timestamp_micros(n) AS TIMESTAMP_NTZ)"),
    ("isodow", "ts TIMESTAMP_NTZ", "INT", "weekday(ts) + 1"),
    ("json_valid", "j STRING", "BOOLEAN", "CASE WHEN j IS NOT NULL THEN try_parse_json(j) IS NOT NULL END"),
    ("json_exists", "j STRING, p STRING", "BOOLEAN", "CASE WHEN j IS NOT NULL THEN try_variant_get(try_parse_json(j), p, 'variant') IS NOT NULL END"),
    ("json_extract_string", "j STRING, p STRING", "STRING", "get_json_object(j, p)"),
    ("json_keys", "j STRING", "ARRAY<STRING>", "CASE WHEN j IS NOT NULL THEN coalesce(json_object_keys(j), CAST(array() AS ARRAY<STRING>)) END"),
    (
        "json_type",
        "j STRING",
        "STRING",
        "CASE substr(to_json(try_parse_json(j)), 1, 1) WHEN '{' THEN 'OBJECT' WHEN '[' THEN 'ARRAY' WHEN '\"' THEN 'VARCHAR' WHEN 't' THEN 'BOOLEAN' WHEN 'f' THEN 'BOOLEAN' WHEN 'n' THEN 'NULL' "
        "ELSE CASE WHEN to_json(try_parse_json(j)) RLIKE '^[0-9]+$' THEN 'UBIGINT' WHEN to_json(try_parse_json(j)) RLIKE '^-[0-9]+$' THEN 'BIGINT' WHEN try_parse_json(j) IS NOT NULL THEN 'DOUBLE' END END",
    ),
    ("map_extract", "m MAP<STRING, STRING>, k STRING", "ARRAY<STRING>", "CASE WHEN map_contains_key(m, k) THEN array(try_element_at(m, k)) ELSE CAST(array() AS ARRAY<STRING>) END"),
    ("map_extract_value", "m MAP<STRING, STRING>, k STRING", "STRING", "try_element_at(m, k)"),
    ("map_contains_value", "m MAP<STRING, STRING>, v STRING", "BOOLEAN", "array_contains(map_values(m), v)"),
    ("prefix", "a STRING, b STRING", "BOOLEAN", "startswith(a, b)"),
    ("starts_with", "a STRING, b STRING", "BOOLEAN", "startswith(a, b)"),
    ("suffix", "a STRING, b STRING", "BOOLEAN", "endswith(a, b)"),
    ("regexp_matches", "a STRING, p STRING", "BOOLEAN", "a RLIKE p"),
    ("string_split", "a STRING, d STRING", "ARRAY<STRING>", "split(a, concat('\\\\Q', d, '\\\\E'))"),
    ("strpos", "a STRING, b STRING", "INT", "locate(b, a)"),
    ("escape_uri", "a STRING", "STRING", "replace(replace(replace(url_encode(a), '+', '%20'), '*', '%2A'), '%7E', '~')"),
    ("rounded_int", "x DOUBLE", "INT", "CAST(rint(x) AS INT)"),
)
#: Aggregates and functions that the session has under another name with the same results.
RENAMED = {
    "arg_max_null": "max_by", "arg_min_null": "min_by", "arbitrary": "any_value", "quantile_cont": "percentile", "list_contains": "array_contains", "list_distinct": "array_distinct",
    "list_sort": "array_sort", "array_length": "size", "list_concat": "concat", "variance": "var_samp", "stddev": "stddev_samp", "to_timestamp_ms": "timestamp_millis",
}
_CALL = re.compile(rf"(?<![\w.`])({'|'.join(RENAMED)})(?=\s*\()", re.IGNORECASE)


def register_functions(spark: SparkSession) -> None:
    """Make SQL_FUNCTIONS known to the session, for any SQL text that it runs."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    for name, parameters, result, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")


def renamed_calls(text: str) -> str:
    """Calls of RENAMED functions under the session's names; strings stay."""
    return outside_strings(text, lambda part: _CALL.sub(lambda m: RENAMED[m[1].lower()], part))
