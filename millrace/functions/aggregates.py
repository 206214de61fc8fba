"""Aggregates that the session doesn't have under the same name or with the same semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def arg_max(value: Column, key: Column) -> Column:
    """The value at the largest key; rows in which either is null don't count."""
    return F.max_by(value, F.when(value.isNotNull(), key))


def arg_min(value: Column, key: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), key))


def arg_max_null(value: Column, key: Column) -> Column:
    """The value at the largest key, which may be null."""
    return F.max_by(value, key)


def arg_min_null(value: Column, key: Column) -> Column:
    return F.min_by(value, key)


def _top(value: Column, key: Column, n: int, descending: bool) -> Column:
    kept = F.collect_list(F.when(value.isNotNull() & key.isNotNull(), F.struct(key.alias("k"), value.alias("v"))))
    return F.transform(F.slice(F.sort_array(kept, asc=not descending), 1, n), lambda e: e["v"])


def arg_max_n(value: Column, key: Column, n: int) -> Column:
    """The values at the n largest keys, largest first.

    Collects the group; ``grouped_top_n`` doesn't."""
    return _top(value, key, n, True)


def arg_min_n(value: Column, key: Column, n: int) -> Column:
    return _top(value, key, n, False)


max_by, min_by = arg_max, arg_min


def max_n(x: Column, n: int) -> Column:
    return F.slice(F.sort_array(F.collect_list(x), asc=False), 1, n)


def min_n(x: Column, n: int) -> Column:
    return F.slice(F.sort_array(F.collect_list(x)), 1, n)


def grouped_top_n(df: DataFrame, keys: list[str], value: Column, key: Column, n: int, name: str, descending: bool = True) -> DataFrame:
    """(keys, list of the values at the n largest keys), as arg_max_n gives them: ranks are limited before the shuffle and
    after it, so at most n rows of a group come together. Groups without such rows have no list."""
    rows = df.where(value.isNotNull() & key.isNotNull()).select(*keys, key.alias("__k"), value.alias("__v"))
    order = [F.col("__k").desc(), F.col("__v").desc()] if descending else [F.col("__k").asc(), F.col("__v").asc()]
    top = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "__v"))), lambda e: e["__v"]).alias(name))


def array_agg(x: Column, order: Column | None = None) -> Column:
    """A list of a group's values, nulls kept; in the order of ``order`` if given."""
    if order is None:
        return F.transform(F.collect_list(F.struct(x.alias("x"))), lambda e: e["x"])
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), x.alias("x")))), lambda e: e["x"])


def string_agg(x: Column, separator: str, order: Column | None = None) -> Column:
    return F.array_join(array_agg(x, x if order is None else order), separator)


def arbitrary(x: Column) -> Column:
    return F.any_value(x)


def first(x: Column, order: Column) -> Column:
    """The value at the least ``order``, so that the result doesn't depend on the rows' place."""
    return F.min_by(x, order)


def last(x: Column, order: Column) -> Column:
    return F.max_by(x, order)


def wide_sum(x: Column) -> Column:
    """A sum of integers that doesn't overflow at 64 bits."""
    return F.sum(x.cast("decimal(38,0)"))


#: Bits of a piece of a double, and the powers of 2**24 at which doubles are cut for exact sums.
_PIECE, _LOWEST, _HIGHEST = 24, -6, 6


def _exact_sum(x: Column) -> Column:
    """A sum with the error of a few last roundings, in whatever order the rows come: doubles are cut into pieces at fixed
    powers of two, each piece's integers are summed as integers, and carries are moved up. For magnitudes below 2**200,
    to 2**-144, and 2**39 rows of a group; a plain sum where larger ones, infinities or NaN occur."""
    x = x.cast("double")
    safe = F.when(F.abs(x) < 2.0**200, x)
    whole = lambda k: F.rint(safe * 2.0 ** (-_PIECE * k))
    sums = [F.sum((whole(k) - whole(k + 1) * 2.0**_PIECE).cast("bigint")) for k in range(_LOWEST, _HIGHEST)]
    sums.append(F.sum(whole(_HIGHEST).cast("bigint")))
    # Carries go up from the lowest piece, and the pieces are added from the highest: struct(carry, pieces so far).
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("pieces"))

    def step(state: Column, s: Column) -> Column:
        full = state["carry"] + s
        carry = F.shiftright(full, _PIECE)
        return F.struct(carry.alias("carry"), F.array_append(state["pieces"], full - F.shiftleft(carry, _PIECE)).alias("pieces"))

    scales = F.array(*[F.lit(2.0 ** (_PIECE * k)) for k in range(_LOWEST, _HIGHEST + 2)])

    def joined(state: Column) -> Column:
        terms = F.zip_with(F.array_append(state["pieces"], state["carry"]), scales, lambda n, scale: n.cast("double") * scale)
        return F.aggregate(F.reverse(terms), F.lit(0.0), lambda a, b: a + b)

    return F.when(F.max(F.abs(x)) < 2.0**200, F.aggregate(F.array(*sums), start, step, joined)).otherwise(F.sum(x))


def fsum(x: Column) -> Column:
    """A compensated sum."""
    return _exact_sum(x)


def favg(x: Column) -> Column:
    """The mean by a compensated sum."""
    return _exact_sum(x) / F.count(x)


def product(x: Column) -> Column:
    return F.product(x.cast("double"))


def geomean(x: Column) -> Column:
    return F.exp(F.avg(F.ln(x.cast("double"))))


def histogram(x: Column) -> Column:
    """A map of each value and its count, by value; nulls don't count.

    Collects the group, sorts it and counts its runs; ``grouped_histogram`` counts before it collects."""
    entry = lambda v, n: F.struct(v.alias("key"), F.lit(n).cast("bigint").alias("value"))

    def step(runs: Column, v: Column) -> Column:
        last = F.element_at(runs, -1)
        longer = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(v.alias("key"), (last["value"] + 1).alias("value"))))
        return F.when(F.size(runs) == 0, F.array(entry(v, 1))).when(last["key"] == v, longer).otherwise(F.array_append(runs, entry(v, 1)))

    values = F.array_sort(F.collect_list(x))
    none = F.filter(F.transform(F.slice(values, 1, 1), lambda v: entry(v, 0)), lambda _: F.lit(False))
    return F.map_from_entries(F.aggregate(values, none, step))


def grouped_histogram(df: DataFrame, keys: list[str], x: Column, name: str = "histogram") -> DataFrame:
    """(keys, map of each value and its count): counted by value before and after a shuffle, so that what comes together
    is one entry for each distinct value of a group, in whatever way rows are dealt."""
    counts = df.where(x.isNotNull()).groupBy(*keys, x.alias("__value")).agg(F.count("*").alias("__n"))
    maps = counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__value", "__n")))).alias(name))
    empty = F.map_from_arrays(F.array().cast(f"array<{df.select(x.alias('v')).dtypes[0][1]}>"), F.array().cast("array<bigint>"))
    if not keys:
        return maps
    all_keys = df.select(*keys).distinct()
    same = [all_keys[k].eqNullSafe(maps[k]) for k in keys]
    return all_keys.join(maps, same, "left").select(*[all_keys[k] for k in keys], F.coalesce(maps[name], empty).alias(name))


def _over(x_type: str) -> Column:
    """The key of what no bin holds: the largest value of a type, infinity for floating point, an empty text."""
    largest = {"tinyint": 2**7 - 1, "smallint": 2**15 - 1, "int": 2**31 - 1, "bigint": 2**63 - 1}
    if x_type in largest:
        return F.lit(largest[x_type]).cast(x_type)
    return F.lit("inf").cast(x_type) if x_type in ("float", "double") else F.lit("")


def _binned(edges: list, counts: list[Column], rest: Column, x_type: str) -> Column:
    keys = F.array(*[F.lit(e).cast(x_type) for e in edges])
    some = F.map_from_arrays(keys, F.array(*counts))
    return F.when(rest > 0, F.map_concat(some, F.map_from_arrays(F.array(_over(x_type)), F.array(rest)))).otherwise(some)


def histogram_bins(x: Column, bins: list, x_type: str = "double") -> Column:
    """A map of each bin's upper edge and the count of x in (edge before, edge]; what is above the last edge has the
    largest value of the type (infinity for doubles) as its key, if there is any. The state is one number for each bin."""
    edges = sorted(set(bins))
    counts = [F.count_if(x <= F.lit(e) if i == 0 else (x > F.lit(edges[i - 1])) & (x <= F.lit(e))) for i, e in enumerate(edges)]
    return _binned(edges, counts, F.count_if(x > F.lit(edges[-1])), x_type)


def histogram_exact(x: Column, bins: list, x_type: str = "double") -> Column:
    """A map of each bin and the count of the rows that equal it; other rows have the key that histogram_bins gives."""
    edges = sorted(set(bins))
    return _binned(edges, [F.count_if(x == F.lit(e)) for e in edges], F.count_if(~x.isin(*edges)), x_type)


def bitstring_agg(x: Column, low: int, high: int) -> Column:
    """A string of 0 and 1 with a place for each integer from low to high."""
    seen = F.collect_set(x)
    bits = F.transform(F.sequence(F.lit(low), F.lit(high)), lambda i: F.when(F.array_contains(seen, i), "1").otherwise("0"))
    return F.array_join(bits, "")


def approx_count_distinct(x: Column, error: float = 0.05) -> Column:
    return F.approx_count_distinct(x, error)


def count_distinct_over(x: Column, window) -> Column:
    """count(DISTINCT x) over any window, by the set of a frame's values; operators.relational.count_distinct_over does it
    for whole partitions without sets."""
    return F.size(F.collect_set(x).over(window)).cast("bigint")
