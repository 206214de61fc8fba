"""Secret scans: fixed patterns, and guess costs of values in a credential's context (operator 7).

Spans are in code points, the end exclusive. Kinds, in this order: ``assign`` (a credential name, a separator and a
value of 12 or more characters; the whole match), ``access`` (an AKIA access key of 18 or more characters), ``hex``
(16 or more lower-case hex digits) and ``guess``: the value after a wider set of credential names, if the cheapest
way to guess it costs at least ``10**LEAST_COST`` tries. That cost is the minimum over all segmentations of the value
into common words, pronounceable words, dates, repeats, keyboard walks and brute-force spans, found by dynamic
programming over the value's prefixes.

A null text is an empty text. Long texts are scanned whole, and values have no greatest length. Repeated rows are answered
once each. Spans of different kinds may overlap; of one kind they don't.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import batch_slices

KINDS = ("assign", "access", "hex", "guess")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX, LEAST_GUESS_CHARS, LEAST_COST = 12, 18, 16, 8, 10.0

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST_HEX)
_CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|credentials?|bearer|login)"""
    r"""["']?[\x20\t]*(?::=|=>|[:=]|\bis\b|(?<=bearer))[\x20\t]*["']?([^\s"'<>,;|()\[\]{}]{%d,})""" % LEAST_GUESS_CHARS,
    re.IGNORECASE | re.ASCII,
)
_NAMES = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "login")
_BASE_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_HEX_CLASS = bytes(ord("h") if chr(c) in "0123456789abcdef" else 0 for c in range(256))

#: Passwords and words that guessers try first, most frequent first. A longer list can be given to ``scan``
#: and ``redact``; this one is kept short, of words that lists of common passwords and of function words begin with.
COMMON = (
    "password 123456 qwerty abc123 letmein monkey dragon master admin welcome login princess solo starwars passw0rd hello freedom whatever "
    "trustno1 shadow ashley football jesus michael ninja mustang access flower secret love summer winter spring autumn test guest root user "
    "changeme default example sample token key pass word the and for you that with this from have are not one all out day man new old big"
).split()
_LEET = str.maketrans("4@301$57!", "aaeoissti")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (y, x + y * 0.5) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
_CLASSES = ((re.compile(r"[0-9]+"), 10), (re.compile(r"[a-z]+"), 26), (re.compile(r"[A-Z]+"), 26))
#: Tries for each letter of a pronounceable word, as a power of ten: about 1.5 bits.
_SPOKEN = 0.45


def _adjacent(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return bool(p and q) and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _brute(c: str) -> float:
    return math.log10(next((n for pattern, n in _CLASSES if pattern.fullmatch(c)), 33 if c < "\x80" else 1000))


class Words:
    """Common words, most frequent first, by their rank."""

    def __init__(self, words: Iterable[str] = COMMON) -> None:
        self.rank: dict[str, int] = {}
        for i, w in enumerate(words):
            self.rank.setdefault(w.lower(), i + 1)
        self.longest = max(map(len, self.rank), default=0)
        self.costly = lru_cache(maxsize=4096)(self._costly)

    def __reduce__(self):
        return Words, (list(self.rank),)

    def _costly(self, value: str) -> bool:
        return guess_cost(value, LEAST_COST, self) >= LEAST_COST

    def is_costly(self, value: str) -> bool:
        return self.costly(value) if len(value) <= 256 else self._costly(value)


def guess_cost(value: str, enough: float = math.inf, words: Words | None = None) -> float:
    """log10 of the tries that the cheapest segmentation of ``value`` needs. Empty: 0.

    Costs from ``enough`` on aren't told apart: the search ends where no cheaper segmentation goes on, so that the time
    grows with the value's length at most. Below ``enough`` the cost is exact."""
    words = words or WORDS
    rank_of = words.rank.get
    n, lower = len(value), value.lower()
    if len(lower) != n:  # a letter whose lower case is longer
        lower = value
    plain = lower.translate(_LEET)
    best = [0.0] + [math.inf] * n
    reach, until = 0, [0] * 9  # the furthest prefix that costs less than enough; where the characters stop repeating after each unit
    for i in range(n):
        if i > reach:
            return enough
        at = best[i]
        if at == math.inf:
            continue

        def offer(j: int, cost: float, at: float = at) -> None:
            nonlocal reach
            if at + cost < best[j] and at + cost < enough:
                best[j] = at + cost
                reach = max(reach, j)

        offer(i + 1, _brute(value[i]))
        for j in range(i + 2, min(n, i + words.longest) + 1):  # common words, also with look-alike characters and in capitals
            rank = rank_of(lower[i:j]) or rank_of(plain[i:j])
            if rank:
                offer(j, math.log10(rank * (1 if value[i:j] == lower[i:j] else 2) * (1 if rank_of(lower[i:j]) else 4) + 1))
        dates = []
        if value[i].isdigit():
            dates = [m.end() for m in [_DATE.match(value, i)] if m]
            if value[i : i + 2] in ("19", "20") and value[i : i + 4].isdigit() and len(value[i : i + 4]) == 4:
                dates.append(i + 4)
        for j in dates:
            offer(j, math.log10(365 * 120) if j - i > 4 else math.log10(120))
        for unit in range(1, min(8, (n - i) // 2) + 1):  # a unit that repeats: its own characters and a count
            if until[unit] <= i:
                k = i
                while k + unit < n and value[k] == value[k + unit]:
                    k += 1
                until[unit] = k
            j = i + unit + (until[unit] - i) // unit * unit
            if j - i >= max(3, 2 * unit):
                offer(j, sum(map(_brute, value[i : i + unit])) + math.log10((j - i) // unit))
        j, turns, way = i + 1, 0, None
        while j < n and _adjacent(lower[j - 1], lower[j]):  # a walk: its first key, its length and its turns
            a, b = _PLACE[lower[j - 1]], _PLACE[lower[j]]
            step = (b[0] - a[0], b[1] - a[1])
            turns, way = turns + (way is not None and step != way), step
            j += 1
            if at + turns * math.log10(6) >= enough:
                break
            if j - i >= 4:
                offer(j, math.log10(47) + math.log10(j - i) + turns * math.log10(6))
        vowels = consonants = 0
        for j in range(i, n):  # a pronounceable word
            c = lower[j]
            if not ("a" <= c <= "z") or (j > i and value[j].isupper() != value[i + 1 if j > i else i].isupper()):
                break
            vowels, consonants = (vowels + 1, 0) if c in "aeiouy" else (0, consonants + 1)
            if vowels > 3 or consonants > 3 or at + _SPOKEN * (j - i) >= enough:
                break
            if j - i >= 3:
                offer(j + 1, 1 + _SPOKEN * (j - i))
    return min(best[n], enough)


WORDS = Words()


def spans(text: str | None, words: Words = WORDS) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span of a whole text, by start and then by kind."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    if any(name.encode() in low for name in _BASE_NAMES):
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if b"AKIA" in raw:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if b"h" * LEAST_HEX in raw.translate(_HEX_CLASS):
        found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    if any(name.encode() in low for name in _NAMES):
        found += [(*m.span(1), "guess") for m in _CONTEXT.finditer(text) if words.is_costly(m[1].rstrip(".:!?"))]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def scan(docs: DataFrame, words: Iterable[str] = COMMON) -> DataFrame:
    """A row for every row of ``docs`` (doc_id, text): counts of the fixed kinds, the SHA-256 of their joined spans,
    and all spans joined as ``kind:start:end``. words: common words, most frequent first; every task gets them. No spans: counts of 0, the hash of the empty string, an empty string."""

    known = Words(words)

    def run(batches):
        for batch in batches:
            rows = [spans(t.as_py(), known) for t in batch.column(1)]
            base = [[s for s in r if s[2] != "guess"] for r in rows]
            counts = [pa.array([sum(s[2] == kind for s in r) for r in base], pa.int64()) for kind in KINDS[:3]]
            digests = pa.array([hashlib.sha256(_joined(r).encode()).hexdigest() for r in base], pa.string())
            yield pa.record_batch([batch.column(0), *counts, digests, pa.array([_joined(r) for r in rows], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str | None, mask: str = "[SECRET]", words: Words = WORDS) -> str | None:
    """The text with every span (overlapping ones as one) replaced by ``mask``."""
    found = spans(text, words)
    if not found:
        return text
    merged: list[list[int]] = []
    for a, b, _ in found:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in merged:
        out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, words: Iterable[str] = COMMON) -> DataFrame:
    """``docs`` with the secrets in ``text`` masked; n_chars, where there is such a column, follows a changed text.
    All other columns and all rows stay."""
    names, schema = docs.columns, docs.schema
    known = Words(words)
    at, counted = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in (part for whole in batches for part in batch_slices(whole, "text")):
            columns, before = list(batch.columns), batch.column(at).to_pylist()
            after = [redacted(t, words=known) for t in before]
            columns[at] = pa.array(after, batch.schema.field(at).type)
            if counted is not None:
                n = [len(b) if b is not a else old for a, b, old in zip(before, after, batch.column(counted).to_pylist(), strict=True)]
                columns[counted] = pa.array(n, batch.schema.field(counted).type)
            yield pa.record_batch(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)

