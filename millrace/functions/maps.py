"""Map, struct, list and tagged-union functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cardinality(m: Column) -> Column:
    return F.size(m)


def map_extract(m: Column, key: Column) -> Column:
    """A list with the key's value, or an empty list. Also known as element_at."""
    value = F.try_element_at(m, key)
    return F.when(m.isNull(), F.lit(None)).when(F.map_contains_key(m, key), F.array(value)).otherwise(F.slice(F.array(value), 1, 0))


element_at = map_extract


def map_extract_value(m: Column, key: Column) -> Column:
    return F.try_element_at(m, key)


def map_concat(*maps: Column) -> Column:
    """All entries; of equal keys the last map's value. Doesn't depend on the session's policy for equal keys."""
    if len(maps) == 1:
        return maps[0]
    later = maps[-1]
    kept = F.map_filter(map_concat(*maps[:-1]), lambda k, _: ~F.map_contains_key(later, k))
    return F.map_concat(kept, later)


def map_contains(m: Column, key: Column) -> Column:
    return F.map_contains_key(m, key)


def map_contains_entry(m: Column, key: Column, value: Column) -> Column:
    return F.coalesce(F.try_element_at(m, key) == value, F.lit(False))


def map_contains_value(m: Column, value: Column) -> Column:
    return F.array_contains(F.map_values(m), value)


def map_entries(m: Column) -> Column:
    return F.map_entries(m)


def map_from_entries(entries: Column) -> Column:
    return F.map_from_entries(entries)


def map_keys(m: Column) -> Column:
    return F.map_keys(m)


def map_values(m: Column) -> Column:
    return F.map_values(m)


# A union is a struct of its tag and a field for each member, of which one is set.


def union_value(members: dict[str, str], tag: str, value: Column) -> Column:
    """A union with the given members (name: type) that holds ``value`` under ``tag``."""
    if tag not in members:
        raise ValueError(f"the union has no member {tag}")
    fields = [(value if name == tag else F.lit(None)).cast(kind).alias(name) for name, kind in members.items()]
    return F.struct(F.lit(tag).alias("tag"), *fields)


def union_tag(u: Column) -> Column:
    return u.getField("tag")


def union_extract(u: Column, tag: str) -> Column:
    """The member's value, or null if another one is set."""
    return F.when(u.getField("tag") == tag, u.getField(tag))


# Lists: positions begin at 1, slices include both ends.


def list_slice(items: Column, first: int, last: int) -> Column:
    """Elements from first to last; negative positions count from the end, and what is beyond an end is cut off."""
    n = F.size(items)
    place = lambda k: F.lit(k) if k >= 0 else n + 1 + k
    start = F.greatest(F.lit(1), place(first))
    return F.when(items.isNotNull(), F.slice(items, start, F.greatest(F.lit(0), F.least(n, place(last)) - start + 1)))


def list_element(items: Column, position: int) -> Column:
    return F.try_element_at(items, F.lit(position))


def contains_all(items: Column, wanted: Column) -> Column:
    """The operator @>: does the list have every element of the other? Nulls equal nothing."""
    return F.forall(wanted, lambda x: F.coalesce(F.array_contains(items, x), F.lit(False)))
