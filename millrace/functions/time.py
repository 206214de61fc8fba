"""Date and time functions: buckets, C-style formats, epochs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
MONTHS = {"month": 1, "quarter": 3, "year": 12, "decade": 120, "century": 1200}
#: Where buckets begin. Monday 2000-01-03 for days and less, 2000-01-01 for months.
ORIGIN = 946_857_600_000_000

_PART = re.compile(r"\s*(-?\d+)\s*([a-z]+?)s?\b", re.IGNORECASE)


def parse_interval(text: str) -> tuple[int, int]:
    """(months, microseconds) of an interval such as "1 month", "2 days 6 hours"."""
    months = micros = at = 0
    for m in _PART.finditer(text):
        if text[at : m.start()].strip():
            break
        number, unit, at = int(m[1]), m[2].lower(), m.end()
        unit = {"centurie": "century", "min": "minute", "sec": "second"}.get(unit, unit)
        if unit in MONTHS:
            months += number * MONTHS[unit]
        elif unit in MICROS:
            micros += number * MICROS[unit]
        else:
            raise ValueError(f"unknown unit in interval: {text}")
    if text[at:].strip() or not at:
        raise ValueError(f"not an interval: {text}")
    return months, micros


def micros_of(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def timestamp_of(micros: Column) -> Column:
    return F.timestamp_micros(micros.cast("bigint")).cast("timestamp_ntz")


def _bucket_micros(x: Column, width: int, origin: int | Column) -> Column:
    return x - F.pmod(x - (F.lit(origin) if isinstance(origin, int) else origin), F.lit(width).cast("bigint"))


def _month_index(ts: Column) -> Column:
    return (F.year(ts) - 2000) * 12 + F.month(ts) - 1


def _month_start(index: Column) -> Column:
    return F.make_date((2000 + F.floor(index / 12)).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")


def time_bucket(width: str, ts: Column, offset: str | None = None, origin: str | None = None, timezone: str | None = None) -> Column:
    """The beginning of the bucket of ``width`` that ``ts`` is in, as a timestamp without time zone.

    Widths are days and less, or months and more, not both. ``offset`` moves the buckets; ``origin`` (a timestamp) is
    where one of them begins; ``timezone`` makes buckets begin at local times of that zone and returns instants.
    """
    months, micros = parse_interval(width)
    if (months > 0) == (micros > 0):
        raise ValueError("a width has either months or a time, and is positive")
    if sum(x is not None for x in (offset, origin, timezone)) > 1:
        raise ValueError("give one of offset, origin and timezone")
    if timezone is not None:
        local = F.from_utc_timestamp(ts.cast("timestamp"), timezone)
        return F.to_utc_timestamp(time_bucket(width, local).cast("timestamp"), timezone).cast("timestamp_ntz")
    start = F.lit(origin).cast("timestamp_ntz") if origin is not None else None
    if months:
        base = _month_index(start) if start is not None else F.lit(0)
        shifted = ts
        if offset is not None:
            over, rest = parse_interval(offset)
            if over:
                return F.add_months(_month_start(_bucketed(_month_index(ts) - over, months, base)), over).cast("timestamp_ntz")
            shifted = timestamp_of(micros_of(ts) - rest)
            return timestamp_of(micros_of(_month_start(_bucketed(_month_index(shifted), months, base))) + rest)
        return _month_start(_bucketed(_month_index(shifted), months, base))
    x = micros_of(ts)
    if offset is not None:
        over, rest = parse_interval(offset)
        if over:
            raise ValueError("a time width takes an offset without months")
        return timestamp_of(_bucket_micros(x - rest, micros, ORIGIN) + rest)
    return timestamp_of(_bucket_micros(x, micros, micros_of(start) if start is not None else ORIGIN))


def _bucketed(index: Column, months: int, base: Column) -> Column:
    return F.floor((index - base) / months) * months + base


#: C-style tokens and the session's patterns.
_STRFTIME = {
    "Y": "yyyy", "m": "MM", "-m": "M", "d": "dd", "-d": "d", "H": "HH", "-H": "H", "I": "hh", "-I": "h", "M": "mm", "-M": "m", "S": "ss", "-S": "s",
    "p": "a", "a": "EEE", "A": "EEEE", "b": "MMM", "B": "MMMM", "j": "DDD", "-j": "D", "f": "SSSSSS", "g": "SSS", "y": "yy", "z": "xx", "Z": "z",
    "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy",
}
_TOKEN = re.compile(r"%(-?[A-Za-z%])")


def date_pattern(fmt: str) -> str:
    """A C-style format as the session's pattern, literal text quoted."""
    out, at = [], 0

    def literal(text: str) -> None:
        if text:
            out.append("'" + text.replace("'", "''") + "'" if re.search(r"[A-Za-z'\[\]{}#]", text) else text)

    for m in _TOKEN.finditer(fmt):
        literal(fmt[at : m.start()])
        at = m.end()
        if m[1] == "%":
            out.append("%")
        elif m[1] in _STRFTIME:
            out.append(_STRFTIME[m[1]])
        else:
            raise ValueError(f"unknown format token %{m[1]}")
    literal(fmt[at:])
    return "".join(out)


def strftime(ts: Column, fmt: str) -> Column:
    return F.date_format(ts.cast("timestamp"), date_pattern(fmt))


def strptime(text: Column, fmt: str | list[str]) -> Column:
    """The timestamp of the first format that fits; an error if none does. Week days are read over."""
    tries = []
    for one in [fmt] if isinstance(fmt, str) else fmt:
        names = re.findall(r"%[aA],?\s*", one)
        value = text
        for name in names:  # the parser takes no week days
            one = one.replace(name, "", 1)
            value = F.regexp_replace(value, r"(?i)\b(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\b,?\s*", "")
        tries.append(F.try_to_timestamp(value, F.lit(date_pattern(one))))
    wrong = F.raise_error(F.concat(F.lit("could not parse timestamp: "), text)).cast("timestamp")
    return F.when(text.isNull(), F.lit(None).cast("timestamp")).otherwise(F.coalesce(*tries, wrong)).cast("timestamp_ntz")


def epoch(ts: Column) -> Column:
    """Seconds since 1970 as a double."""
    return micros_of(ts) / F.lit(1_000_000.0)


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970, rounded."""
    return F.round(micros_of(ts) / F.lit(1000.0)).cast("bigint")


def from_epoch_ms(n: Column) -> Column:
    """The other overload of epoch_ms: the timestamp of a number of milliseconds."""
    return F.timestamp_millis(n.cast("bigint")).cast("timestamp_ntz")


def epoch_us(ts: Column) -> Column:
    return micros_of(ts)


def epoch_ns(ts: Column) -> Column:
    return micros_of(ts) * 1000


def interval_epoch(months: Column, days: Column, micros: Column) -> Column:
    """Seconds of an interval kept as (months, days, microseconds): a month has 30 days."""
    return (months.cast("double") * 30 + days) * 86400.0 + micros / 1_000_000.0


def make_timestamp(micros: Column) -> Column:
    return timestamp_of(micros)


def make_timestamp_of(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, zone: Column | None = None) -> Column:
    """The timestamp of its parts; with a time zone the moment that its clocks show them at."""
    if zone is None:
        return F.make_timestamp_ntz(year, month, day, hour, minute, second.cast("decimal(16,6)"))
    return F.make_timestamp(year, month, day, hour, minute, second.cast("decimal(16,6)"), zone)


def time_of(ts: Column) -> Column:
    """The time of day, kept as an interval from midnight: the session has no type for it."""
    micros = F.pmod(micros_of(ts), F.lit(86_400_000_000))
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / F.lit(1_000_000)).cast("decimal(18,6)"))


def time_text(time: Column) -> Column:
    """A time of day as text, with as many digits of a second as it needs."""
    stamp = F.lit("1970-01-01").cast("timestamp_ntz") + time
    return F.regexp_replace(F.date_format(stamp, "HH:mm:ss.SSSSSS"), r"(?:\.0+|(\.\d*[1-9])0+)$", "$1")


def date_trunc(unit: str, ts: Column) -> Column:
    return F.date_trunc(unit, ts.cast("timestamp")).cast("timestamp_ntz")


def add_interval(ts: Column, text: str) -> Column:
    """ts plus an interval, as a timestamp without time zone (also for dates)."""
    months, micros = parse_interval(text)
    moved = ts.cast("timestamp_ntz") + F.make_ym_interval(F.lit(0), F.lit(months)) if months else ts.cast("timestamp_ntz")
    return timestamp_of(micros_of(moved) + micros) if micros else moved


def isodow(ts: Column) -> Column:
    return F.weekday(ts) + 1
