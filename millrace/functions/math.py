"""Math, array and date functions that go by other names or don't exist in the session."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm; 64-bit numbers need at most 91 steps, and steps at 0 change nothing."""
    start = F.struct(F.abs(a.cast("bigint")).alias("a"), F.abs(b.cast("bigint")).alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("bigint")).otherwise(F.try_mod(s["a"], s["b"])).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def lcm(a: Column, b: Column) -> Column:
    """The least common multiple; 0 if either is 0."""
    step = F.floor(a.cast("bigint") / F.when(gcd(a, b) != 0, gcd(a, b)))
    return F.when((a == 0) | (b == 0), F.lit(0).cast("bigint")).otherwise(F.abs(step * b).cast("bigint"))


def trunc(x: Column) -> Column:
    """Cut off what is behind the point."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def log(x: Column) -> Column:
    """The host's log(x): to base 10."""
    return F.log10(x)


def div(a: Column, b: Column) -> Column:
    """Whole-number division, towards zero."""
    return trunc(a / b).cast("bigint")


def age(later: Column, earlier: Column) -> Column:
    """The calendar span between two timestamps as (months, days, micros): fields are subtracted, a missing day is
    borrowed from the earlier time's month. Negative if the first is the earlier one."""
    a, b = later.cast("timestamp_ntz"), earlier.cast("timestamp_ntz")
    high, low = F.greatest(a, b), F.least(a, b)
    sign = F.when(a < b, -1).otherwise(1)
    of_day = lambda t: F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(86_400_000_000))
    micros = of_day(high) - of_day(low)
    days = F.day(high) - F.day(low) - F.when(micros < 0, 1).otherwise(0)
    months = (F.year(high) - F.year(low)) * 12 + F.month(high) - F.month(low) - F.when(days < 0, 1).otherwise(0)
    return F.struct(
        (sign * months).cast("int").alias("months"),
        (sign * F.when(days < 0, days + F.day(F.last_day(low))).otherwise(days)).cast("int").alias("days"),
        (sign * F.pmod(micros, F.lit(86_400_000_000))).alias("micros"),
    )


#: to_char's templates and the session's patterns.
_TO_CHAR = (("YYYY", "yyyy"), ("Month", "MMMM"), ("Mon", "MMM"), ("MM", "MM"), ("DDD", "DDD"), ("DD", "dd"), ("Day", "EEEE"), ("Dy", "EEE"), ("HH24", "HH"), ("HH12", "hh"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("AM", "a"), ("PM", "a"), ("YY", "yy"))


def to_char(ts: Column, template: str) -> Column:
    """A timestamp by a host template such as 'YYYY-MM-DD HH24:MI:SS'. Names come without padding."""
    names, out, at = dict(_TO_CHAR), [], 0
    for m in re.finditer("|".join(a for a, _ in _TO_CHAR), template):
        text = template[at : m.start()]
        out += [f"'{text}'" if re.search("[A-Za-z]", text) else text, names[m[0]]]
        at = m.end()
    return F.date_format(ts.cast("timestamp"), "".join(out) + template[at:])


def array_prepend(items: Column, x: Column) -> Column:
    return F.concat(F.array(x), items)


def any_equal(x: Column, items: Column) -> Column:
    """x = ANY (items): true, or null if there is a null and no match."""
    return F.exists(items, lambda y: y == x)


def all_true(items: Column, test) -> Column:
    """test(x) for ALL items."""
    return F.forall(items, test)


def regexp_split_to_array(text: Column, pattern: str) -> Column:
    return F.split(text, pattern, -1)


def regexp_matches_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)
