"""String functions with PostgreSQL's semantics."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _replacement(text: str, shift: int) -> str:
    """A replacement with \\1 as the session's $1, groups moved by ``shift``; \\& is the whole match."""
    out = re.sub(r"([$])", r"\\\1", text)
    out = re.sub(r"\\\\(\d)", lambda m: f"${int(m[1]) + shift}" if int(m[1]) else f"${shift}", out.replace("\\", "\\\\"))
    return out.replace("\\\\&", f"${shift}").replace("\\\\$", "\\$")


def regexp_replace(text: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    """Replace the first match; flag "g": all matches, "i": letters in either case."""
    inline = "(?i)" if "i" in flags else ""
    if "g" in flags:
        return F.regexp_replace(text, inline + pattern, _replacement(replacement, 0))
    # All up to the first match is kept in group 1, so groups of the pattern move by two (the match itself is group 2).
    return F.regexp_replace(text, rf"{inline}(?s)\A(.*?)((?-s){pattern})", "$1" + _replacement(replacement, 2))


def regexp_matches(text: Column, pattern: str) -> Column:
    """Does the pattern match anywhere? (the operator ~)"""
    return F.regexp_like(text, F.lit(pattern))


def similar_to(text: Column, pattern: str, escape: str = "\\") -> Column:
    """SQL's SIMILAR TO: % and _ as in LIKE, | * + ? () [] as in regular expressions, the whole text must match."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append({"%": ".*", "_": ".", ".": r"\.", "^": r"\^", "$": r"\$"}.get(c, c))
        i += 1
    return F.regexp_like(text, F.lit("(?s)^(?:" + "".join(out) + ")$"))


def _like_pattern(pattern: str, escape: str) -> str:
    """A LIKE pattern whose escape character is a backslash and stands only before % and _ and itself."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape:
            i += 1
            if i == len(pattern):
                raise ValueError("LIKE pattern must not end with escape character")
            c = pattern[i]
            out.append("\\" + c if c in "%_\\" else c)
        else:
            out.append("\\\\" if c == "\\" else c)
        i += 1
    return "".join(out)


def like(text: Column, pattern: str, escape: str = "\\") -> Column:
    """LIKE; an empty escape means that there is none."""
    return F.like(text, F.lit(_like_pattern(pattern, escape)))


def ilike(text: Column, pattern: str, escape: str = "\\") -> Column:
    return F.ilike(text, F.lit(_like_pattern(pattern, escape)))


def split_part(text: Column, delimiter: str, part: int) -> Column:
    return F.split_part(text, F.lit(delimiter), F.lit(part))


def string_to_array(text: Column, delimiter: str) -> Column:
    """Split at a delimiter that is taken as it stands."""
    return F.split(text, re.escape(delimiter), -1)


def escape_uri(text: Column) -> Column:
    """Percent-encoding of all but unreserved characters."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(out, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def rounded_int(number: Column) -> Column:
    """A cast to integer that rounds, as hosts do, where the session's cast cuts off: halves of doubles to the even side."""
    return F.rint(number).cast("int")
