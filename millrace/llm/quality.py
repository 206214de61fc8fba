"""Quality classifier: an interpolated modified Kneser-Ney model of characters (operator 2).

Text is read as UTF-8 bytes in 64 classes (letters, capitals, digits, white space, punctuation, parts of longer
characters), and the model has 4-grams of them. It is trained for each language on trusted text: all rows whose doc_id
is labelled good and not toxic (labels that disagree count as bad), but for one id in ``HELD`` by a hash, which is held
out. Counting, continuation counts, context totals and the interpolation of the orders are joins and aggregations of
count tables that are sharded by language and n-gram. All n-grams are in the model. At most ``MOST_GRAMS`` 4-grams of a
language, the most frequent ones, are broadcast with all shorter n-grams, and documents join them where they are read.
The rarer 4-grams of a language that has more stay in a sharded table: documents' 4-grams that weren't broadcast are
shuffled and joined with it, and what they gain is added. Languages without trusted text, and null, use the model of all
trusted text.

A document's excess is z = (nats - the median) * sqrt(1 / (1 / bytes + 1 / EVEN)), which takes the chance of short
texts out. Its bounds are quantiles of z over the language's held-out documents that are labelled good (equal texts
once): LOWER and UPPER, each moved out by ``MARGIN`` of the way from the median. Languages with fewer than
``LEAST_HELD`` such documents have no such quantiles: theirs are the bounds of all languages together, or their own
where those are wider. Too high: not the language, noise, capitals, tables. Too low: worn-out repetition.

An empty or null text has no perplexity and isn't kept. Repeated rows are answered once each; ties of quantiles don't
matter, as both bounds are kept. Long texts are scored whole, alone in their slice. Without any trusted text there is
no model: ``classify`` keeps nothing and ``keep_good`` everything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import batch_slices, checkpointed, text_buffer

ORDER, BITS = 4, 6
#: 4-grams of a language, and ids of trusted documents (or keys of rows) up to which they are broadcast; beyond it documents
#: are joined with the others by a shuffle.
MOST_GRAMS, BROADCAST_IDS = 1 << 20, 1 << 20
EVEN = 2_000.0
#: The quantiles that are the bounds, how far beyond them the bounds are, of how many ids one is held out for them, and
#: held-out documents of a language from which on these quantiles can be told.
LOWER, UPPER, MARGIN, HELD, LEAST_HELD = 0.0025, 0.9975, 0.25, 4, 400
#: How far from the median the bounds are at least: texts that are nearly alike have quantiles that tell nothing.
LEAST_SPREAD = 0.5
#: Bytes of text that are scored at once.
_SLICE = 1 << 19
#: Steps in which quantiles are counted.
_NATS_STEP, _Z_STEP = 0.001, 0.02
#: The key of the model of all trusted text.
ANY = "*"
#: Gains of rarer 4-grams are summed as whole numbers of these parts of a nat, so that sums don't depend on the order.
_PARTS = 1 << 20
_KEYS, _GAIN = ["__millrace_k1", "__millrace_k2"], "__millrace_gain"


def _byte_classes() -> np.ndarray:
    """The class of each byte."""
    table = np.full(256, 33, np.int32)
    for c in range(26):
        table[ord("a") + c] = 1 + c
        table[ord("A") + c] = 27
    table[ord("0") : ord("9") + 1] = 28
    table[[ord(" "), ord("\t")]] = 0
    table[[ord("\n"), ord("\r")]] = 29
    for k, c in enumerate(".,|"):
        table[ord(c)] = 30 + k
    for k, c in enumerate("!?*#$%&-'\""):
        table[ord(c)] = 34 + k
    for b in range(0x80, 0xC0):
        table[b] = 45 + (b & 15)
    table[0xC0:0xC4], table[0xC4:0xE0], table[0xE0:] = 61, 62, 63
    return table


CLASSES = _byte_classes()


def gram_codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The code of the 4-gram that ends at each byte: 6 bits a class, the latest lowest. Before a text are spaces."""
    symbols = CLASSES[data]
    codes = symbols.copy()
    n = len(symbols)
    for k in range(1, ORDER):
        before = np.zeros(n, np.int32)
        before[k:] = symbols[: n - k] if k < n else 0
        for j in range(k):
            at = offsets[:-1] + j
            before[at[at < n]] = 0
        codes |= before << (BITS * k)
    return codes


@dataclass
class KneserNey:
    """A language's model: at each order the seen codes with their probability, and seen contexts with their weight
    of the order below. All arrays are sorted by code."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    _at: tuple[np.ndarray, ...] | None = None

    def probabilities(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """P(last class | those before) of distinct codes of an order, by joins with the sorted shards."""
        if order == 0:
            return np.full(len(codes), 1.0 / (1 << BITS))
        known, p = self.grams[order - 1]
        out, found = _lookup(known, p, codes)
        rest = np.flatnonzero(~found)
        if len(rest):
            weight, has = _lookup(*self.contexts[order - 1], codes[rest] >> BITS)
            lower, inverse = np.unique(codes[rest] & ((1 << (BITS * (order - 1))) - 1), return_inverse=True)
            out[rest] = np.where(has, weight, 1.0) * self.probabilities(lower, order - 1)[inverse]
        return out

    def knows(self, codes: np.ndarray) -> np.ndarray:
        """Is the 4-gram at each place among those of the model?"""
        self.nats(codes[:0])
        return (self._at[0][codes >> 6] >> (codes & 63).astype(np.uint64)) & np.uint64(1) == 1

    def nats(self, codes: np.ndarray) -> np.ndarray:
        """-log P of the 4-gram at each place. The model's shards lie at their codes: a bit for each 4-gram that is
        known, with the number of those before each word of bits, the weight of each context, and all 3-grams."""
        if self._at is None:
            known, p = self.grams[ORDER - 1]
            bits = np.zeros(1 << (BITS * ORDER - 6), np.uint64)
            np.bitwise_or.at(bits, known >> 6, np.uint64(1) << (known & 63).astype(np.uint64))
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)[:-1])).astype(np.int32)
            weights = np.zeros(1 << (BITS * (ORDER - 1)), np.float32)
            ctx, weight = self.contexts[ORDER - 1]
            weights[ctx] = -np.log(weight)
            lower = -np.log(self.probabilities(np.arange(1 << (BITS * (ORDER - 1))), ORDER - 1))
            self._at = bits, before, -np.log(p).astype(np.float32), weights, lower.astype(np.float32)
        bits, before, known, weights, lower = self._at
        word, bit = bits[codes >> 6], (codes & 63).astype(np.uint64)
        out = weights[codes >> BITS] + lower[codes & ((1 << (BITS * (ORDER - 1))) - 1)]
        seen = np.flatnonzero((word >> bit) & np.uint64(1))
        word, bit = word[seen], bit[seen]
        out[seen] = known[before[codes[seen] >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))]
        return out


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return np.where(found, values[at], 0.0), found


def good_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, trains, held), once each, of the documents that all their labels call good: held is true for one id in
    ``HELD``, trains for the others that no label calls toxic."""
    by_id = labels.where("doc_id is not null").groupBy("doc_id")
    good = by_id.agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1")
    held = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(HELD)) == 0
    return good.select("doc_id", (~held & (F.col("t") == 0)).alias("trains"), held.alias("held"))


def rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """All rows of ``docs`` (doc_id, ...) with one of these ids, which are broadcast if they are few."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def gram_counts(texts: DataFrame) -> DataFrame:
    """(lang, code, n): 4-grams of each language and of all texts, summed before and after the shuffle."""

    def run(batches):
        for batch in batches:
            for part in batch_slices(batch, "text", _SLICE):
                data, offsets = text_buffer(part.column(1))
                codes = gram_codes(data, offsets)
                langs = part.column(0).dictionary_encode(null_encoding="encode")
                lang_at = np.repeat(langs.indices.to_numpy().astype(np.int64), np.diff(offsets))
                both, n = np.unique((lang_at << (BITS * ORDER)) | codes, return_counts=True)
                at, code = both >> (BITS * ORDER), both & ((1 << (BITS * ORDER)) - 1)
                yield pa.record_batch([langs.dictionary.take(pa.array(at)).cast(pa.string()), pa.array(code), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    counts = texts.select("lang", "text").mapInArrow(run, "lang string, code long, n long")
    own = checkpointed(counts.groupBy("lang", "code").agg(F.sum("n").alias("n")))
    return own.where("lang is not null").unionByName(own.groupBy("code").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(ANY)))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """``counts`` with ``kept``: false for the rarest n-grams, such that a language has ``most`` others at most. The
    border lies between eighths of powers of two, of which a language has a few hundred at most."""
    step = F.floor(F.log2("n") * 8)
    bins = counts.groupBy("lang", step.alias("step")).agg(F.count("*").alias("of"))
    above = Window.partitionBy("lang").orderBy(F.col("step").desc())
    border = bins.withColumn("upto", F.sum("of").over(above)).where(F.col("upto") <= most).groupBy("lang").agg(F.min("step").alias("border"))
    return counts.join(F.broadcast(border), "lang", "left").withColumn("kept", F.coalesce(step >= F.col("border"), F.lit(False))).drop("border")


def model_tables(counts: DataFrame, most: int | None = None) -> Iterator[tuple[DataFrame, DataFrame]]:
    """For each order from 1 on: (lang, code, n, p, backed) and (lang, ctx, weight) of the interpolated model; backed is what
    the lower orders give to p.

    The counts below the highest order are continuation counts: the distinct classes that come before. Each order's
    discounts follow from how many n-grams it has once, twice, three and four times; with ``most``, 4-grams that aren't
    among the ``most`` frequent are discounted whole. Every table is kept, so that the next order joins rows and not a plan that
    grows.
    """
    levels = {ORDER: counts}
    for level in range(ORDER - 1, 0, -1):
        levels[level] = checkpointed(levels[level + 1].groupBy("lang", (F.col("code") % (1 << (BITS * level))).alias("code")).agg(F.count("*").alias("n")))
    below = None
    for level in range(1, ORDER + 1):
        rows = levels[level]
        of = rows.groupBy("lang").agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)])
        y = F.col("n1") / F.greatest(F.lit(1), F.col("n1") + 2 * F.col("n2"))
        discounts = of.select("lang", *[F.when(F.col(f"n{k}") > 0, F.greatest(F.lit(0.1 * k), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))).otherwise(0.5 * k).alias(f"d{k}") for k in (1, 2, 3)])
        discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = frequent(rows, most) if level == ORDER and most is not None else rows.withColumn("kept", F.lit(True))
        taken = F.when(F.col("kept"), F.least(discount, F.col("n") * 0.95)).otherwise(F.col("n"))
        rows = rows.join(F.broadcast(discounts), "lang").select("lang", "code", "n", "kept", taken.alias("d"), F.shiftright("code", BITS).alias("ctx"))
        per = rows.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.sum("d").alias("cut"))
        per = checkpointed(per.select("lang", "ctx", "total", (F.col("cut") / F.col("total")).alias("weight")))
        rows = rows.where("kept").join(per, ["lang", "ctx"]).withColumn("low", F.col("code") % (1 << (BITS * (level - 1))))
        rows = rows.withColumn("p_low", F.lit(1.0 / (1 << BITS))) if below is None else rows.join(below, ["lang", "low"])
        rows = rows.withColumn("backed", F.col("weight") * F.col("p_low"))
        seen = checkpointed(rows.select("lang", "code", "n", ((F.col("n") - F.col("d")) / F.col("total") + F.col("backed")).alias("p"), "backed"))
        below = seen.select("lang", F.col("code").alias("low"), F.col("p").alias("p_low"))
        yield seen, per.select("lang", "ctx", "weight")


def _by_language(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The sorted (code, value) arrays of each language of a table (lang, code, value)."""
    table = rows.toArrow()
    out = {}
    for lang in table.column(0).unique().to_pylist():
        part = table.filter(pc.equal(table.column(0), lang))
        keys, values = part.column(1).to_numpy(), part.column(2).to_numpy()
        order = np.argsort(keys, kind="stable")
        out[lang] = keys[order], values[order]
    return out


def _trained(texts: DataFrame) -> DataFrame:
    texts = texts.where("text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return checkpointed(gram_counts(texts))


def _collected(tables: list[tuple[DataFrame, DataFrame]]) -> dict[str, KneserNey]:
    out: dict[str, KneserNey] = {}
    for grams, contexts in tables:
        weights = _by_language(contexts)
        for lang, codes in _by_language(grams.select("lang", "code", "p")).items():
            model = out.setdefault(lang, KneserNey([], []))
            model.grams.append(codes)
            model.contexts.append(weights[lang])
    for lang, model in out.items():  # a language of which no 4-gram is broadcast
        if len(model.grams) < ORDER:
            model.grams.append((np.zeros(0, np.int64), np.zeros(0)))
            model.contexts.append(weights[lang])
    return out


def train(trusted: DataFrame, most: int | None = None) -> dict[str, KneserNey]:
    """Models by language of the trusted rows (lang, text); empty if there is no such text. With ``most``, a model that
    stands alone with that many 4-grams: the mass of the others goes to the lower orders. The queries use ``fit``."""
    return _collected(list(model_tables(_trained(trusted), most)))


def fit(trusted: DataFrame, most: int = MOST_GRAMS) -> tuple[dict[str, KneserNey], DataFrame | None]:
    """The whole model of the trusted rows (lang, text): models by language with the ``most`` most frequent 4-grams of
    each, and (lang, code, gain) of the other 4-grams, if there are any. gain: nats (in ``_PARTS``) that a 4-gram has less
    than the lower orders give it, which is what the models without it say."""
    *lower, (grams, contexts) = model_tables(_trained(trusted))
    split = frequent(grams, most)
    models = _collected([*lower, (split.where("kept"), contexts)])
    rest = checkpointed(split.where("not kept").select("lang", "code", F.round(F.log(F.col("p") / F.col("backed")) * _PARTS).cast("long").alias("gain")))
    return models, None if rest.isEmpty() else rest


def with_gains(docs: DataFrame, models: dict[str, KneserNey], rest: DataFrame | None) -> DataFrame:
    """``docs`` (lang, text, ...) with a column of the nats that the 4-grams of ``rest`` take off each text."""
    if rest is None:
        return docs.withColumn(_GAIN, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            for part in batch_slices(batch, "text", _SLICE):
                data, offsets = text_buffer(part.column(3))
                codes, rows = gram_codes(data, offsets), np.repeat(np.arange(part.num_rows), np.diff(offsets))
                keys = np.array([x if x in shared.value else ANY for x in part.column(2).to_pylist()], object)
                for key in sorted(set(keys.tolist()) & set(shared.value)):
                    mine = np.flatnonzero((keys == key)[rows])
                    mine = mine[~shared.value[key].knows(codes[mine])]
                    both, n = np.unique((rows[mine].astype(np.int64) << (BITS * ORDER)) | codes[mine], return_counts=True)
                    at = pa.array(both >> (BITS * ORDER))
                    lang, code = pa.array([key] * len(both), pa.string()), pa.array(both & ((1 << (BITS * ORDER)) - 1))
                    yield pa.record_batch([part.column(0).take(at), part.column(1).take(at), lang, code, pa.array(n.astype(np.int64))], names=["k1", "k2", "lang", "code", "n"])

    lang, text = F.col("lang").cast("string"), F.col("text").cast("string")
    keyed = docs.select(*[F.xxhash64(F.lit(seed), lang.isNull(), lang, text).alias(k) for seed, k in enumerate(_KEYS)], "*")
    grams = keyed.select(*_KEYS, lang.alias("lang"), text.alias("text")).mapInArrow(run, "k1 long, k2 long, lang string, code long, n long")
    gains = grams.join(rest, ["lang", "code"]).dropDuplicates(["k1", "k2", "code"])  # equal texts once
    gains = checkpointed(gains.groupBy("k1", "k2").agg((F.sum(F.col("n") * F.col("gain")) / _PARTS).alias(_GAIN)))
    gains = gains.select(F.col("k1").alias(_KEYS[0]), F.col("k2").alias(_KEYS[1]), _GAIN)
    joined = keyed.join(F.broadcast(gains) if gains.count() <= BROADCAST_IDS else gains, _KEYS, "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(_GAIN, F.lit(0.0)).alias(_GAIN))


def score_rows(langs: list[str | None], column: pa.Array, models: dict[str, KneserNey]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, nats for a byte) of each row; an empty text or a missing model gives NaN."""
    data, offsets = text_buffer(column)
    sizes = np.diff(offsets)
    nats = np.full(len(sizes), np.nan)
    if not len(data) or not models:
        return sizes, nats
    codes = gram_codes(data, offsets)
    keys = np.array([x if x in models else ANY for x in langs], object)
    for key in set(keys.tolist()):
        rows = np.flatnonzero((keys == key) & (sizes > 0))
        if not len(rows):
            continue
        mine = codes if len(rows) == len(sizes) else codes[np.repeat(np.isin(np.arange(len(sizes)), rows), sizes)]
        starts = np.concatenate(([0], np.cumsum(sizes[rows])[:-1]))
        nats[rows] = np.add.reduceat(models[key].nats(mine), starts, dtype=np.float64) / sizes[rows]
    return sizes, nats


def scores(docs: DataFrame, models: dict[str, KneserNey], rest: DataFrame | None = None) -> DataFrame:
    """(doc_id, lang, n_bytes, nats) of every row of ``docs`` (doc_id, text, lang), kept in the checkpoint folder."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            for part in batch_slices(batch, "text", _SLICE):
                sizes, nats = score_rows(part.column(1).to_pylist(), part.column(2), shared.value)
                nats -= part.column(3).to_numpy() / np.maximum(sizes, 1)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(sizes), pa.array(nats, mask=np.isnan(nats))], names=["doc_id", "lang", "n_bytes", "nats"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    out = checkpointed(with_gains(rows, models, rest).mapInArrow(run, "doc_id long, lang string, n_bytes long, nats double"))
    shared.unpersist()
    return out


def _quantiles(rows: DataFrame, value: str, step: float, wanted: dict[str, float]) -> DataFrame:
    """Quantiles of a value for each language, to a step: counts of steps, and a running sum over those."""
    counts = rows.groupBy("lang", F.floor(F.col(value) / step).alias("bin")).agg(F.count("*").alias("n"))
    run = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("lang").orderBy("bin"))).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    return run.groupBy("lang").agg(*[F.min(F.when(F.col("upto") >= q * F.col("all"), (F.col("bin") + 0.5) * step)).alias(name) for name, q in wanted.items()], F.max("all").alias("n"))


def _shrink() -> Column:
    return F.sqrt(1 / (1 / F.col("n_bytes") + 1 / F.lit(EVEN)))


def excess(sizes: np.ndarray, nats: np.ndarray, median: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return (nats - median) * np.sqrt(1 / (1 / sizes + 1 / EVEN))


def thresholds(held: DataFrame) -> dict[str, tuple[float, float, float]]:
    """(median nats, least z, most z) by language, and for all together, of the scores of held-out documents; equal
    texts of a language count once. One row for each language is collected."""
    rows = held.where("nats is not null").select("lang", "n_bytes", "nats").distinct()
    rows = checkpointed(rows.withColumn("lang", F.explode(F.array_compact(F.array("lang", F.lit(ANY))))))
    median = checkpointed(_quantiles(rows, "nats", _NATS_STEP, {"median": 0.5}))
    z = rows.join(F.broadcast(median), "lang").select("lang", ((F.col("nats") - F.col("median")) * _shrink()).alias("z"))
    pooled = z.where(F.col("lang") != ANY).withColumn("lang", F.lit("pooled"))  # each by its own language's median
    found = {r["lang"]: r for r in _quantiles(z.unionByName(pooled), "z", _Z_STEP, {"low": LOWER, "mid": 0.5, "high": UPPER}).collect()}
    outer = lambda r: (min(r["low"] - MARGIN * (r["mid"] - r["low"]), r["mid"] - LEAST_SPREAD), max(r["high"] + MARGIN * (r["high"] - r["mid"]), r["mid"] + LEAST_SPREAD))
    out = {}
    for r in median.collect():
        low, high = outer(found[r["lang"]])
        if found[r["lang"]]["n"] < LEAST_HELD and "pooled" in found:
            low, high = min(low, outer(found["pooled"])[0]), max(high, outer(found["pooled"])[1])
        out[r["lang"]] = (r["median"], low, high)
    return out


def _bounds(ids: DataFrame, scored: Callable[[DataFrame], DataFrame]) -> dict[str, tuple[float, float, float]]:
    """The bounds that the held-out documents give, or, if there is none with text, those of the training.

    scored: gives the scores of the documents with some of the ids."""
    return thresholds(scored(ids.where("held"))) or thresholds(scored(ids.where("trains")))


def classify(docs: DataFrame, labels: DataFrame, most: int = MOST_GRAMS) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, excess, keep) of every row of ``docs``; perplexity is for a byte."""
    ids = checkpointed(good_ids(labels))
    models, rest = fit(rows_of(docs, ids.where("trains")), most)
    scored = scores(docs, models, rest)
    bounds = _bounds(ids, lambda some: rows_of(scored, some))
    rows = [(k, *v) for k, v in bounds.items()]  # one row for each language
    limits = F.broadcast(docs.sparkSession.createDataFrame(rows, "l string, median double, least double, most double"))
    key = F.when(F.col("lang").isin(list(bounds)), F.col("lang")).otherwise(F.lit(ANY))
    out = scored.join(limits, key == F.col("l"), "left").withColumn("excess", (F.col("nats") - F.col("median")) * _shrink())
    return out.select("doc_id", "lang", "n_bytes", F.exp("nats").alias("perplexity"), "excess", F.coalesce(F.col("excess").between(F.col("least"), F.col("most")), F.lit(False)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, most: int = MOST_GRAMS) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns. Without any trusted text all rows stay.

    The bounds follow from held-out rows alone, so all rows are scored once, where they are filtered."""
    ids = checkpointed(good_ids(labels))
    models, rest = fit(rows_of(docs, ids.where("trains")), most)
    if not models:
        return docs
    bounds = _bounds(ids, lambda some: scores(rows_of(docs, some), models, rest))
    shared, schema = docs.sparkSession.sparkContext.broadcast((models, bounds)), docs.schema

    def run(batches):
        models, bounds = shared.value
        for batch in batches:
            for part in batch_slices(batch, "text", _SLICE):
                langs = [None if x is None else str(x) for x in part.column(part.schema.get_field_index("lang")).to_pylist()]
                sizes, nats = score_rows(langs, part.column(part.schema.get_field_index("text")), models)
                nats -= part.column(part.num_columns - 1).to_numpy() / np.maximum(sizes, 1)
                median, least, most_z = np.array([bounds.get(x, bounds[ANY]) for x in langs], float).reshape(-1, 3).T
                z = excess(sizes, nats, median)
                yield part.select(range(part.num_columns - 1)).filter(pa.array((z >= least) & (z <= most_z)))

    return with_gains(docs, models, rest).mapInArrow(run, schema)
