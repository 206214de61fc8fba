"""JSON functions over JSON text.

Paths are "$.a.b[0]", bare keys ("a"), pointers ("/a/b/0"), or positions in an array (0-based integers). Positions from
the end are [-1] or [#-1]. A path with [*] or .* gives a list. Documents may repeat a key; the first one is found.
What built-in functions express stays in the JVM; containment and structure are Arrow-batched Python.
"""

from __future__ import annotations

import json as _json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from millrace.session import ship_package

Path = str | int
_STEP = re.compile(r"""\.?\*|\[\*\]|\[(?:#?-)(\d+)\]|\.[^.\[]+|\['(?:[^'\\]|\\.)*'\]|\[\d+\]""")


def json_path(path: Path) -> str:
    if isinstance(path, int):
        return f"$[{path}]"
    if path.startswith("/"):
        return "$" + "".join(f"[{x}]" if x.isdigit() else f"['{x}']" for x in path[1:].replace("~1", "/").replace("~0", "~").split("/"))
    if path.startswith("$"):
        return path
    return "$['" + path.replace("'", "\\'") + "']"


def _is_list(path: Path) -> bool:
    return isinstance(path, str) and "*" in path and path.startswith("$")


def _parsed_variant(j: Column) -> Column:
    if (spark := SparkSession.getActiveSession()) is not None:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return F.try_parse_json(j)


def _steps(path: Path) -> list[str]:
    text, at, out = json_path(path)[1:], 0, []
    while at < len(text):
        m = _STEP.match(text, at)
        if m is None or text.startswith("..", at):
            raise ValueError(f"unsupported JSON path: {path}")
        out.append(m[0])
        at = m.end()
    return out


def _found(j: Column, path: str) -> Column:
    """JSON text at a plain path, if the whole document is valid; null for a member that is null. Within an array strings
    keep their quotes, and all of the document is read."""
    return F.get_json_object(F.concat(F.lit('[{"j":'), j, F.lit("}]")), "$[*].j" + path[1:])


def _raw(j: Column, path: str) -> Column:
    """JSON text at a plain path, keys in the document's order. Only where no text is found is the document parsed, which
    tells null from what is missing."""
    return F.coalesce(_found(j, path), F.when(F.is_variant_null(F.try_variant_get(_parsed_variant(j), path, "variant")), "null"))


def _unquoted(text: Column) -> Column:
    return F.when(text != "null", F.get_json_object(F.concat(F.lit("["), text, F.lit("]")), "$[0]"))


def _elements(text: Column, step: str) -> Column:
    """JSON texts of an array's elements, or of an object's values in its order; empty for other values."""
    kind, opens = ("array<{}>", "[") if step == "[*]" else ("map<string,{}>", "{")

    def split(text: Column) -> Column:
        texts, values = F.from_json(text, kind.format("string")), F.from_json(text, kind.format("variant"))
        if opens == "{":
            texts, values = F.map_values(texts), F.map_values(values)
        # Texts of strings have no quotes; if there are strings, the values tell them from what only looks like another value.
        element = lambda t, v: F.when(t.isNull(), "null").when(F.schema_of_variant(v) == "STRING", F.to_json(v)).otherwise(t)
        every = F.when(F.contains(text, F.lit('"')), F.zip_with(texts, values, element)).otherwise(F.transform(texts, lambda t: F.coalesce(t, F.lit("null"))))
        return F.coalesce(F.when(F.substring(text, 1, 1) == opens, every), F.array().cast("array<string>"))

    return F.transform(F.array(text), split)[0]


def _at(j: Column, path: Path) -> Column:
    """JSON text of the place that a path names; for a path with wildcards the list of what is there, in the document's
    order. The parts of the path are constant, so that the session parses them once and not for every row."""

    def walk(text: Column, steps: list[str]) -> Column:
        plain = next((i for i, step in enumerate(steps) if not _plain(step)), len(steps))
        at = "$" + "".join(steps[:plain])
        if plain == len(steps):
            return _raw(text, at) if plain else text
        here = _found(text, at)
        step, rest = steps[plain], steps[plain + 1 :]
        if m := re.fullmatch(r"\[#?-(\d+)\]", step):
            return walk(F.try_element_at(_elements(here, "[*]"), F.lit(-int(m[1]))), rest) if int(m[1]) else F.lit(None).cast("string")
        if not rest:
            return _elements(here, step)
        inner = F.transform(_elements(here, step), lambda x: walk(x, rest))  # a wildcard takes the rest of the path into its list
        return F.flatten(inner) if any("*" in x for x in rest) else F.filter(inner, lambda x: x.isNotNull())

    return walk(j, _steps(path))


def _variant(j: Column, path: Path | Column) -> Column:
    if isinstance(path, Column):
        return F.call_function("try_variant_get", _parsed_variant(j), path, F.lit("variant"))
    return F.try_variant_get(_parsed_variant(j), json_path(path), "variant")


def _plain(path: Path) -> bool:
    return isinstance(path, int) or not re.search(r"\*|\[#?-", path)


def _for_paths(one: Callable[[Path], Column], path) -> Column:
    return F.array(*[one(p) for p in path]) if isinstance(path, list | tuple) else one(path)


def json_valid(j: Column) -> Column:
    return F.when(j.isNotNull(), _parsed_variant(j).isNotNull())


def json_exists(j: Column, path: Path) -> Column:
    if _plain(path):
        return F.when(j.isNotNull(), _variant(j, path).isNotNull())
    found = json_extract(j, path)
    return F.when(j.isNotNull(), F.size(found) > 0 if _is_list(path) else found.isNotNull())


def json_extract(j: Column, path: Path | list[Path]) -> Column:
    """JSON text at a path (strings keep their quotes), a list of texts for a path with wildcards or for a list of paths."""
    return _for_paths(lambda p: _raw(j, json_path(p)) if _plain(p) else _at(j, p), path)


def json_extract_string(j: Column, path: Path | list[Path]) -> Column:
    """The text at a path: strings without quotes, all else as JSON."""

    def one(p: Path) -> Column:
        if _plain(p):
            return F.get_json_object(j, json_path(p))
        return F.transform(_at(j, p), _unquoted) if _is_list(p) else _unquoted(_at(j, p))

    return _for_paths(one, path)


def json_value(j: Column, path: Path | list[Path]) -> Column:
    """JSON text of a scalar at a path; null for objects, arrays and what is missing."""

    def one(p: Path) -> Column:
        text = json_extract(j, p)
        return F.when(~F.substring(text, 1, 1).isin("{", "["), text)

    return _for_paths(one, path)


def json_array_length(j: Column, path: Path | list[Path] = "$") -> Column:
    """Elements of the array at a path; 0 for other values, null for a missing one."""

    def one(p: Path) -> Column:
        text = F.to_json(_variant(j, p))
        return F.when(text.isNotNull(), F.coalesce(F.json_array_length(text), F.lit(0))).cast("bigint")

    return _for_paths(one, path)


def json_keys(j: Column, path: Path | list[Path] = "$") -> Column:
    """Keys of the object at a path in the document's order; an empty list for other values."""

    def one(p: Path) -> Column:
        text = j if p == "$" else F.get_json_object(j, json_path(p))
        return F.when(text.isNotNull(), F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")))

    return _for_paths(one, path)


def json_type(j: Column, path: Path | list[Path] = "$") -> Column:
    """The type of the value at a path. Named branches share the parsed value, which the session computes once for a row."""

    def one(p: Path) -> Column:
        value = _variant(j, p)
        kind = F.schema_of_variant(value)
        whole = (kind == "BIGINT") | kind.endswith(",0)")
        return (
            F.when(kind.isNull(), F.lit(None).cast("string"))
            .when(whole, F.when(F.try_variant_get(value, "$", "decimal(38,0)") < 0, "BIGINT").otherwise("UBIGINT"))
            .when(kind == "STRING", "VARCHAR")
            .when(kind.startswith("OBJECT"), "OBJECT")
            .when(kind.startswith("ARRAY"), "ARRAY")
            .when(kind == "BOOLEAN", "BOOLEAN")
            .when(kind == "VOID", "NULL")
            .otherwise("DOUBLE")
        )

    return _for_paths(one, path)


# ---------------------------------------------------------------------------------- containment and structure


def _contains(hay, needle) -> bool:
    if _covers(hay, needle):
        return True
    inner = hay.values() if isinstance(hay, dict) else hay if isinstance(hay, list) else ()
    return any(_contains(x, needle) for x in inner)


def _covers(value, needle) -> bool:
    """Equality, but an object needs the needle's fields only, and an array its elements only."""
    if isinstance(value, dict) and isinstance(needle, dict):
        return all(k in value and _covers(value[k], v) for k, v in needle.items())
    if isinstance(value, list) and isinstance(needle, list):
        return all(any(_covers(x, y) for x in value) for y in needle)
    return type(value) is type(needle) and value == needle or _is_number(value) and _is_number(needle) and value == needle


def _is_number(x) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def _parsed(text):
    try:
        return True, _json.loads(text)
    except (TypeError, ValueError):
        return False, None


def json_contains(j: Column, needle: Column) -> Column:
    """Is the needle anywhere in the document?"""

    ship_package()

    @F.pandas_udf("boolean")
    def run(hays: pd.Series, needles: pd.Series) -> pd.Series:
        out = []
        for h, n in zip(hays, needles, strict=True):
            (ok, hay), (also, wanted) = _parsed(h), _parsed(n)
            out.append(_contains(hay, wanted) if ok and also else None)
        return pd.Series(out, dtype="object")

    return run(j, needle)


def structure_of(value):
    """The structure of a parsed document: types for scalars, one merged type for an array's elements."""
    if isinstance(value, dict):
        return {k: structure_of(v) for k, v in value.items()}
    if isinstance(value, list):
        merged = "NULL"
        for x in value:
            merged = merge_structures(merged, structure_of(x))
        return [merged]
    if isinstance(value, bool):
        return "BOOLEAN"
    if value is None:
        return "NULL"
    if isinstance(value, int):
        return "UBIGINT" if value >= 0 else "BIGINT"
    return "DOUBLE" if isinstance(value, float) else "VARCHAR"


def merge_structures(a, b):
    """The least structure that holds both: numbers widen, objects take both's fields, other mixes are JSON."""
    if a == b or b == "NULL":
        return a
    if a == "NULL":
        return b
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: merge_structures(a[k], b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in [*a, *(k for k in b if k not in a)]}
    if isinstance(a, list) and isinstance(b, list):
        return [merge_structures(a[0], b[0])]
    numbers = ("UBIGINT", "BIGINT", "DOUBLE")
    if a in numbers and b in numbers:
        return numbers[max(numbers.index(a), numbers.index(b))]
    return "JSON"


def _compact(value) -> str:
    return _json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def json_structure(j: Column) -> Column:
    ship_package()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_compact(structure_of(v)) if ok else None for ok, v in map(_parsed, texts)], dtype="object")

    return run(j)


def json_group_structure(j: Column) -> Column:
    """The merged structure of a group's documents, keys in the order of the sorted distinct structures.

    Distinct structures are few whatever the group's size; they are what comes together."""

    @F.pandas_udf("string")
    def merge(lists: pd.Series) -> pd.Series:
        out = []
        for texts in lists:
            merged = "NULL"
            for text in sorted(texts):
                merged = merge_structures(merged, _json.loads(text))
            out.append(_compact(merged) if len(texts) else None)
        return pd.Series(out, dtype="object")

    return merge(F.collect_set(json_structure(j)))


def json_minify(j: Column) -> Column:
    """The document without white space, keys in its own order; null if it isn't JSON."""
    return _raw(j, "$")


# ---------------------------------------------------------------------------------- transformation

#: Type names of structures and the session's types.
_TYPES = {
    "BOOLEAN": "boolean", "TINYINT": "tinyint", "SMALLINT": "smallint", "INTEGER": "int", "INT": "int", "BIGINT": "bigint", "UTINYINT": "smallint",
    "USMALLINT": "int", "UINTEGER": "bigint", "UBIGINT": "decimal(20,0)", "HUGEINT": "decimal(38,0)", "FLOAT": "float", "REAL": "float",
    "DOUBLE": "double", "VARCHAR": "string", "TEXT": "string", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "JSON": "string",
}


def _transform(j: Column, structure, path: str, strict: bool) -> Column:
    if isinstance(structure, dict):
        fields = [_transform(j, s, f"{path}['{k}']", strict).alias(k) for k, s in structure.items()]
        return F.when(F.get_json_object(j, path).isNotNull(), F.struct(*fields))
    if isinstance(structure, list):
        text = F.get_json_object(j, path)
        elements = F.from_json(text, "array<string>")
        if isinstance(structure[0], dict | list):
            return F.transform(elements, lambda x: _transform(x, structure[0], "$", strict))
        kind = _spark_type(structure[0])
        return F.transform(elements, lambda x: x.cast(kind) if strict else x.try_cast(kind))
    kind, text = _spark_type(structure), F.get_json_object(j, path)
    return text.cast(kind) if strict else text.try_cast(kind)


def _spark_type(name: str) -> str:
    upper = name.upper().strip()
    return upper.lower() if upper.startswith("DECIMAL") else _TYPES[upper]


def json_transform(j: Column, structure: str) -> Column:
    """A struct of the structure's fields; what doesn't fit a type is null."""
    return _transform(j, _json.loads(structure), "$", strict=False)


def json_transform_strict(j: Column, structure: str) -> Column:
    """As json_transform, but what doesn't fit is an error."""
    return _transform(j, _json.loads(structure), "$", strict=True)


from_json, from_json_strict = json_transform, json_transform_strict


# ---------------------------------------------------------------------------------- aggregates


def json_group_array(x: Column, order: Column | None = None) -> Column:
    """A JSON array of a group's values, nulls kept; in the order of ``order`` if given."""
    rows = F.collect_list(F.struct((F.lit(0) if order is None else order).alias("o"), x.alias("x")))
    rows = rows if order is None else F.array_sort(rows)
    return F.to_json(F.transform(rows, lambda e: e["x"]), {"ignoreNullFields": "false"})


def json_group_object(k: Column, v: Column) -> Column:
    """A JSON object of a group's keys and values, by key and value; null values and repeated keys are kept."""
    entries = F.array_sort(F.collect_list(F.struct(k.cast("string").alias("k"), v.alias("v"))))
    inner = lambda x: F.regexp_replace(F.to_json(F.array(x), {"ignoreNullFields": "false"}), r"(?s)^\[(.*)\]$", "$1")
    pairs = F.transform(entries, lambda e: F.concat(inner(e["k"]), F.lit(":"), inner(e["v"])))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
