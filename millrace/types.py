"""Host types and the session's types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Host type names and the session's types. Bit strings are strings of 0 and 1, JSON and UUIDs are text,
#: times of day are intervals from midnight.
SCALARS: dict[str, T.DataType] = {
    "boolean": T.BooleanType(),
    '"char"': T.ByteType(),
    "smallint": T.ShortType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "real": T.FloatType(),
    "double precision": T.DoubleType(),
    "text": T.StringType(),
    "varchar": T.StringType(),
    "bpchar": T.StringType(),
    "bytea": T.BinaryType(),
    "blob": T.BinaryType(),
    "bit": T.StringType(),
    "varbit": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(),
    "time": T.DayTimeIntervalType(),
    "timetz": T.StructType([T.StructField("time", T.DayTimeIntervalType()), T.StructField("offset_seconds", T.IntegerType())]),
    "uuid": T.StringType(),
    "json": T.StringType(),
    "jsonb": T.StringType(),
    "interval": T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("micros", T.LongType())]),
    "utinyint": T.ShortType(),
    "usmallint": T.IntegerType(),
    "uinteger": T.LongType(),
    "ubigint": T.DecimalType(20, 0),
    "hugeint": T.DecimalType(38, 0),
}
_ALIASES = {"bool": "boolean", "int2": "smallint", "int4": "integer", "int": "integer", "int8": "bigint", "float4": "real", "float8": "double precision", "double": "double precision", "string": "text", "char": "bpchar", "time without time zone": "time", "time with time zone": "timetz", "timestamp without time zone": "timestamp", "timestamp with time zone": "timestamptz", "character varying": "varchar"}
_NUMERIC = re.compile(r"(?:numeric|decimal)\s*(?:\(\s*(\d+)\s*(?:,\s*(-?\d+)\s*)?\))?")


class UnsupportedType(ValueError):
    """A type that the engine has no counterpart for."""


def numeric_type(precision: int | None, scale: int | None, to_double: bool = False) -> T.DataType:
    """numeric(p, s) with 1 <= p <= 38 and 0 <= s <= p; else an error, or double if that is asked for."""
    scale = 0 if scale is None and precision is not None else scale
    if precision is not None and 1 <= precision <= 38 and 0 <= scale <= precision:
        return T.DecimalType(precision, scale)
    if to_double:
        return T.DoubleType()
    raise UnsupportedType(f"numeric({precision}, {scale}) has no counterpart; precision goes up to 38")


def spark_type(name: str, numeric_to_double: bool = False) -> T.DataType:
    """The session's type of a host type such as "numeric(8,3)", "integer[]", "varchar(20)"."""
    text = " ".join(name.lower().split())
    if text.endswith("[]"):
        return T.ArrayType(spark_type(text[:-2], numeric_to_double))
    if m := _NUMERIC.fullmatch(text):
        return numeric_type(int(m[1]) if m[1] else None, int(m[2]) if m[2] else None, numeric_to_double)
    text = re.sub(r"\s*\(\s*\d+\s*\)$", "", text)
    text = _ALIASES.get(text, text)
    if text in SCALARS:
        return SCALARS[text]
    raise UnsupportedType(f"no counterpart for the type {name}")


def check_supported(schema: T.StructType, used: list[str] | None = None) -> None:
    """Raise for columns of types that can't be computed with; columns that aren't used don't count."""
    for field in schema.fields:
        if (used is None or field.name in used) and isinstance(field.dataType, T.NullType):
            raise UnsupportedType(f"column {field.name} has an unsupported type")
