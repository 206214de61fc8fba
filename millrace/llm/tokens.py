"""Token counts by prefix dynamic programming over byte-pair encodings (operator 9).

Within a pre-token, the encoding of a prefix ends with exactly one token: the one whose bytes end the prefix and which
is compatible with the last token of what is left (two tokens are compatible if encoding their bytes gives just the
two). So one pass over the prefixes gives every prefix's last token and its count, without merging each prefix anew.
A text's counts are its pieces' counts, moved by the count of what comes before; pieces are kept by their text in a
bounded memo.

``Counter`` reads the vocabulary of a byte-level BPE file (.json) given by its path; its tables are small and are
broadcast. Special strings in a text are special tokens, as the file's library has it by default; nothing is added,
cut or padded. A null text is an empty text with 0 tokens; repeated rows are answered once each; a text of any length is
counted whole. Where a budget ends follows from the stored counts (``within``, ``prefix_index``), without encoding anew.
"""

from __future__ import annotations

import bisect
import itertools
import json
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import batch_slices

#: Fixed value: how byte-level vocabularies split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Pieces and pre-tokens that a worker's memo keeps from one slice of texts to the next.
MEMO_PIECES = 800_000
#: Bytes of text whose new pieces are sorted and learned together.
_SLICE = 4 << 20
_REFUSED = -(1 << 40)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Counter:
    """Token counts under one vocabulary."""

    def __init__(self, content: str) -> None:
        model = json.loads(content)
        letter = _byte_letters()
        as_bytes = lambda s: bytes(letter[c] for c in s)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self.merges = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        special = {x["content"] for x in model["added_tokens"]}
        self.special = sorted(special, key=len, reverse=True)
        self.ids = {as_bytes(t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self._reset()

    def _reset(self) -> None:
        self._fits: dict[int, bool] = {}
        self._whole: dict[bytes, bool] = {}
        self._memo: dict[str, int] = {}
        self._words: dict[str, int] = {}
        self._split = regex.compile(PATTERN)
        self._white = regex.compile(r"\p{White_Space}+")
        self._on_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    # -- one pre-token

    def merged(self, word: bytes) -> list[bytes]:
        """The encoding by merging, for the short strings that compatibility asks about."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.merges.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in self.merges:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _compatible(self, a: bytes, b: bytes, key: int) -> bool:
        fits = self._fits[key] = self.merged(a + b) == [a, b]
        if len(self._fits) > 2_000_000:
            self._fits.clear()
        return fits

    def _alone(self, token: bytes) -> bool:
        ok = self._whole.get(token)
        if ok is None:
            ok = self._whole[token] = self.merged(token) == [token]
        return ok

    def prefixes(self, word: bytes) -> list[int]:
        """The token count of every byte prefix of a pre-token, the empty one included."""
        n = len(word)
        state = [b""] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        self._extend(word, 1, *state)
        return state[2]

    def _extend(self, word: bytes, since: int, last: list[bytes], last_id: list[int], count: list[int]) -> None:
        """Fill the states of the prefixes from length ``since`` on. A prefix has one last token, so the order in
        which candidates are tried doesn't matter; short ones are tried first."""
        ids, fits = self.ids, self._fits
        for i in range(since, len(word) + 1):
            for j in range(i - 1, -1, -1):
                token = word[j:i]
                t = ids.get(token)
                if t is None:
                    continue
                if j:
                    key = last_id[j] << 20 | t
                    ok = fits.get(key)
                    if ok is None:
                        ok = self._compatible(last[j], token, key)
                else:
                    ok = self._alone(token)
                if ok:
                    last[i], last_id[i], count[i] = token, t, count[j] + 1
                    break

    def _learn(self, words: set[str]) -> None:
        """Put pre-tokens into the memo. Sorted, neighbours share prefixes, whose states are taken over."""
        known = self._words
        coded = sorted([(w.encode("utf-8", "surrogatepass"), w) for w in words])
        room = max((len(b) for b, _ in coded), default=0) + 1
        state = [b""] * room, [0] * room, [0] * room
        before, count = b"", state[2]
        for word, text in coded:
            low, high = 0, min(len(before), len(word))
            while low < high:
                mid = (low + high + 1) >> 1
                low, high = (mid, high) if word.startswith(before[:mid]) else (low, mid - 1)
            self._extend(word, low + 1, *state)
            known[text] = count[len(word)]
            before = word

    # -- texts

    def pretokens(self, text: str) -> list[str]:
        return self._split.findall(text)

    def _slow(self, text: str) -> int:
        total, known = 0, self._words
        for p in self._split.findall(text):
            n = known.get(p)
            if n is None:
                n = known[p] = self.prefixes(p.encode("utf-8", "surrogatepass"))[-1]
            total += n
        return total

    def _resolve(self, pieces: set[str]) -> None:
        """Put pieces into the memo: the count of a space and the piece, or a refusal if white space is at its ends."""
        memo, known, parts, wanted = self._memo, self._words, {}, set()
        for piece in pieces:
            if not piece or piece[0].isspace() or piece[-1].isspace():
                memo[piece] = _REFUSED
                continue
            if piece.isalpha():
                split = [" " + piece]
            elif piece[-1] in ".," and piece[:-1].isalpha():
                split = [" " + piece[:-1], piece[-1]]
            else:
                split = self._split.findall(" " + piece)
            parts[piece] = split
            wanted.update(w for w in split if w not in known)
        self._learn(wanted)
        for piece, split in parts.items():
            memo[piece] = sum(map(known.__getitem__, split))

    def counts(self, texts: list[str | None]) -> list[int]:
        """Token counts of texts.

        A single space between two other characters that aren't white space always begins a pre-token, so pieces
        between such spaces are counted by themselves; a text with other spaces is split by the pattern as a whole.
        """
        if len(self._memo) + len(self._words) > MEMO_PIECES:
            self._memo.clear()
            self._words.clear()
        totals, plain, unknown = [0] * len(texts), [], set()
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = [text]
            if self._on_special is not None and any(x in text for x in self.special):
                totals[i] += len(self._on_special.findall(text))
                parts = self._on_special.split(text)
            for part in parts:
                first, *rest = part.split(" ")
                if not rest or not first or first[-1].isspace() or rest[-1][-1:].isspace():
                    totals[i] += self._slow(part) if part else 0
                    continue
                unknown.update(set(rest).difference(self._memo))
                plain.append((i, part, first, rest))
        self._resolve(unknown)
        get = self._memo.__getitem__
        for i, part, first, rest in plain:
            n = sum(map(get, rest))
            totals[i] += self._slow(part) if n < 0 else n + self._slow(first)
        return totals

    def count(self, text: str | None) -> int:
        return self.counts([text])[0]

    def within(self, text: str, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens. What comes before a piece has its stored count,
        so only the piece in which the budget ends is looked into, by the counts of its own prefixes."""
        first, *rest = text.split(" ")
        special = self._on_special is not None and any(x in text for x in self.special)
        if rest and first and not special and not first[-1].isspace() and not rest[-1][-1:].isspace():
            unknown = {x for x in rest if x not in self._memo}
            if unknown:
                self._resolve(unknown)
            counts = [self._memo[x] for x in rest]
            if min(counts) >= 0 and self._slow(first) <= budget:
                sums = [self._slow(first), *itertools.accumulate(counts, initial=0)]
                sums = [sums[0] + x for x in sums[1:]]  # tokens before each piece, and of all
                k = bisect.bisect_right(sums, budget) - 1
                at = len(first) + sum(map(len, rest[:k])) + k
                if k == len(rest):
                    return len(text)
                inside = self.prefix_counts(" " + rest[k])
                return at + int(np.flatnonzero(sums[k] + inside <= budget)[-1])
        size = 8 * budget + 64
        while True:  # some prefix of the text: no longer one has fewer tokens than what comes before its last pre-token
            head = text[:size]
            table = self.prefix_counts(head)
            last = len(head) - len(self._split.findall(head)[-1]) - 1 if head else 0
            if len(head) == len(text) or (2 * last >= len(head) and table[last:].min() > budget):
                return int(np.flatnonzero(table <= budget)[-1])
            size *= 2

    def prefix_counts(self, text: str) -> np.ndarray:
        """The token count of every prefix, by code points (length + 1 values).

        Where a prefix ends within white space or after an apostrophe, it splits otherwise than the whole text does;
        such prefixes of a pre-token are split by themselves.
        """
        out, base, at = [0], 0, 0
        marks = [(m.start(), m.end()) for m in self._on_special.finditer(text)] if self._on_special else []
        for start, end in [*marks, (len(text), len(text))]:
            part = text[at:start]
            tokens, k = self._split.findall(part), 0
            while k < len(tokens):
                token = tokens[k]
                if token.isspace():
                    group, whole = token, self._slow(token)
                    while k + 1 < len(tokens) and tokens[k + 1].isspace():
                        k += 1
                        group, whole = group + tokens[k], whole + self._slow(tokens[k])
                    if self._white.fullmatch(group):  # at a text's end a run of white space is one pre-token
                        out += self._by_points(group, base)
                    else:
                        out += [base + self._slow(group[:i]) for i in range(1, len(group) + 1)]
                    if k + 1 < len(tokens):
                        k += 1
                        if tokens[k][0] == " ":  # a prefix that ends after this space has it in the white space
                            out.append(base + self._slow(group + " "))
                            out += self._by_points(tokens[k], base + whole)[1:]
                        else:
                            out += self._inside(tokens[k], base + whole)
                else:
                    out += self._inside(token, base)
                base = out[-1]
                k += 1
            if end > start:  # a special string: its prefixes are ordinary text
                before, whole = "".join(tokens[-3:]), text[start:end]  # further back the split stays as it is
                fixed = out[-1] - self._slow(before) if before else out[-1]
                out += [fixed + self._slow(before + whole[:i]) for i in range(1, len(whole))] + [out[-1] + 1]
                base = out[-1]
            at = end
        return np.array(out, np.int32)

    def _inside(self, token: str, base: int) -> list[int]:
        if token[0] == "'" and len(token) > 1:
            return [base + self._slow(token[:i]) for i in range(1, len(token) + 1)]
        return self._by_points(token, base)

    def _by_points(self, token: str, base: int) -> list[int]:
        counts = self.prefixes(token.encode("utf-8", "surrogatepass"))
        ends, n = [], 0
        for c in token:
            n += len(c.encode("utf-8", "surrogatepass"))
            ends.append(base + counts[n])
        return ends


def load(path: str) -> Counter:
    return Counter(Path(path).read_text(encoding="utf-8"))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, chars_within) of every row of ``docs`` (doc_id, text); chars_within is the
    number of code points of the longest prefix of at most ``limit`` tokens: where the text is cut to keep to it."""
    shared = docs.sparkSession.sparkContext.broadcast(load(tokenizer_path))

    def run(batches):
        counter = shared.value
        for batch in batches:
            n, chars = [], []
            for part in batch_slices(batch, "text", _SLICE):
                texts = part.column(2).to_pylist()
                found = counter.counts(texts)
                n += found
                chars += [len(t or "") if k <= limit else counter.within(t, limit) for t, k in zip(texts, found, strict=True)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(chars, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within"],
            )

    return _rows(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chars_within long")


def _rows(docs: DataFrame) -> DataFrame:
    text: Column = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))


def prefix_index(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, counts): counts holds the token count at every code point's prefix, as little-endian int32."""
    shared = docs.sparkSession.sparkContext.broadcast(load(tokenizer_path))

    def run(batches):
        for batch in batches:
            tables = [shared.value.prefix_counts(t.as_py() or "").astype("<i4") for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), pa.array([int(t[-1]) for t in tables], pa.int64()), pa.array([t.tobytes() for t in tables], pa.binary())], names=["doc_id", "n_tokens", "counts"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, counts binary")


def longest_within(counts: bytes | np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens, from a stored index."""
    table = np.frombuffer(counts, "<i4") if isinstance(counts, bytes) else counts
    return int(np.flatnonzero(table <= budget)[-1])
