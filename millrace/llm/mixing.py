"""Mixing sources to target weights by a low-discrepancy schedule (operator 6). DataFrame operations only.

1. Sizes are words. A source's target is its weighted share of all words, at most ``most_passes`` times its size;
   what is above goes to the other sources by weight until none is above.
2. A source's documents are shuffled by a hash and laid end to end; blocks of equal length cut that line.
3. Slot i of the schedule has the golden-ratio point frac(i * phi), which cumulative block shares map to a source.
   A slot's rank among its source's slots names the block it reads (rank modulo blocks) and the pass (rank over
   blocks). Ranks stop at the blocks that the target needs. The points leave every source within a few slots of its
   share; the few that are missing are appended, without a number.
4. Slots join blocks, and blocks their documents' pieces.

Line positions and ranks are prefix sums in two levels (within a bucket, then over buckets), so that a source with a
third of all rows is not sorted in one task. Reruns agree: every order is a hash of doc_id and of the row's own size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, documents' line buckets per source, slots of a rank bucket.
BLOCK_WORDS, LINE_BUCKETS, SLOT_BUCKET = 64, 256, 8192
#: Fixed value: the fraction of the golden ratio, as numerator over 2**31.
_PHI = 1327217885
_ONE = 1 << 31


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, most_passes: int = 3) -> DataFrame:
    """(key, source, source_size, weight, target) of the sources of ``sized`` (source, size).

    Sources are ordered by code point, null last; weights repeat 1, 2, 3. Sources whose limit is met come first in
    the order of limit over weight, so one running sum finds where the resharing stops. The table has one row for
    each source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sums = sums.withColumn("key", F.row_number().over(order).cast("long") - 1).withColumn("weight", F.col("key") % 3 + 1)
    limit = F.col("source_size") * most_passes
    ratio = Window.orderBy((limit / F.col("weight")).asc(), F.col("key").asc())
    everything = Window.partitionBy(F.lit(0))
    tail = ratio.rowsBetween(0, Window.unboundedFollowing)
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"_all": F.sum("source_size").over(everything), "_weights": F.sum("weight").over(tail), "_full": F.coalesce(F.sum(limit).over(before), F.lit(0))})
    # A source is full if its limit is below the share that is left for it once all before it are full.
    sums = sums.withColumn("_is_full", limit * F.col("_weights") <= F.col("weight") * (F.col("_all") - F.col("_full")))
    rest = {"_left": F.col("_all") - F.sum(F.when(F.col("_is_full"), limit).otherwise(0)).over(everything), "_open": F.sum(F.when(F.col("_is_full"), 0).otherwise(F.col("weight"))).over(everything)}
    sums = sums.withColumns(rest)
    share = (F.col("_left") * F.col("weight")).cast("double") / F.col("_open")
    return sums.select("key", "source", "source_size", "weight", F.when(F.col("_is_full"), limit.cast("double")).otherwise(share).alias("target"))


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))


def document_lines(sized: DataFrame, buckets: int = LINE_BUCKETS) -> DataFrame:
    """``sized`` with ``at``, the words before each document on its source's shuffled line."""
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = sized.withColumns({"_order": order, "_bucket": F.conv(F.substring(order, 1, 4), 16, 10).cast("int") % buckets})
    inside = Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(across), F.lit(0)))
    starts = starts.select(F.col("source").alias("_source"), F.col("_bucket").alias("_b"), "_start")
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(starts, rows["source"].eqNullSafe(starts["_source"]) & (rows["_bucket"] == starts["_b"]))
    return rows.withColumn("at", F.col("_start") + F.col("_inside")).drop("_source", "_b", "_start", "_inside", "_order", "_bucket")


def with_blocks(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Sources with the number of their blocks, and of the slots that their target needs."""
    blocks = F.when(F.col("source_size") > 0, F.greatest(F.lit(1), F.round(F.col("source_size") / block_words))).otherwise(0).cast("long")
    need = F.when(F.col("blocks") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long")
    return targets.withColumn("blocks", blocks).withColumn("need", need)


def schedule(sources: DataFrame, slot_bucket: int = SLOT_BUCKET) -> DataFrame:
    """(slot, key, rank, block, pass): the slots of the mix in order. sources: as with_blocks returns them.

    A bucket of slots is a run of the schedule. Points go to sources by a join on a coarse cell of the unit interval
    that both sides share; a source's interval covers as many cells as it is wide.
    """
    spark = sources.sparkSession
    cells = 4096
    line = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    spread = sources.where("need > 0").withColumns({"_before": F.coalesce(F.sum("need").over(line), F.lit(0)), "_slots": F.sum("need").over(everything)})
    edge = lambda c: F.floor(c.cast("decimal(38,0)") * _ONE / F.col("_slots")).cast("long")
    spread = spread.select("key", "blocks", "need", "_slots", edge(F.col("_before")).alias("_lo"), edge(F.col("_before") + F.col("need")).alias("_hi")).where("_lo < _hi")
    spread = spread.withColumn("_cell", F.explode(F.sequence((F.col("_lo") * cells / _ONE).cast("long"), ((F.col("_hi") - 1) * cells / _ONE).cast("long"))))
    total = sources.agg(F.sum("need")).first()[0] or 0
    points = spark.range(total).select(F.col("id").alias("slot"), ((F.col("id") % _ONE) * _PHI % _ONE).alias("_point"))
    points = points.withColumn("_cell", (F.col("_point") * cells / _ONE).cast("long"))
    slots = points.join(spread, "_cell").where("_point >= _lo and _point < _hi").select("slot", "key")
    slots = slots.withColumn("_run", F.floor(F.col("slot") / slot_bucket))
    across = Window.partitionBy("key").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = slots.groupBy("key", "_run").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(across), F.lit(0)))
    inside = Window.partitionBy("key", "_run").orderBy("slot")
    ranked = slots.withColumn("_in", F.row_number().over(inside)).join(runs.select("key", "_run", "_start"), ["key", "_run"])
    ranked = ranked.select("slot", "key", (F.col("_start") + F.col("_in") - 1).alias("rank"))
    had = runs.groupBy("key").agg(F.sum("_n").alias("_had"))
    wanted = sources.where("need > 0").select("key", "blocks", "need")
    late = wanted.join(had, "key", "left").withColumn("_had", F.coalesce("_had", F.lit(0))).where("_had < need")
    late = late.select("key", F.explode(F.sequence(F.col("_had"), F.col("need") - 1)).alias("rank"))
    late = late.select(F.lit(None).cast("long").alias("slot"), "key", "rank")  # after all other slots
    chosen = ranked.unionByName(late).join(wanted, "key").where("rank < need")
    return chosen.select("slot", "key", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("pass"))


def block_pieces(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, source, size, at, key, block, words): the words of each document in each block of its source.

    Block b of a source holds the words from floor(b * size / blocks) to floor((b + 1) * size / blocks)."""
    info = sources.where("blocks > 0").select(F.col("source").alias("_source"), "key", "source_size", "blocks")
    rows = lines.where("size > 0")
    rows = rows.join(info, rows["source"].eqNullSafe(info["_source"])).drop("_source")
    block_of = lambda w: F.expr(f"((({w}) + 1) * blocks - 1) div source_size")
    rows = rows.withColumn("block", F.explode(F.sequence(block_of("at"), block_of("at + size - 1"))))
    lo = F.expr("block * source_size div blocks")
    hi = F.expr("(block + 1) * source_size div blocks")
    words = F.least(F.col("at") + F.col("size"), hi) - F.greatest(F.col("at"), lo)
    return rows.withColumn("words", words).where("words > 0").select("doc_id", "source", "size", "at", "key", "block", "words")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, most_passes: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot) of every row of ``docs`` (doc_id, text, source).

    taken: the words that all scheduled blocks take from the document, passes counted. first_slot: the first slot of the
    schedule that reads a block with some of the document's words (null if none does). A null text has size 0; an
    empty document is never taken; a null source is a source of its own; repeated rows are documents of their own and
    share what is taken from rows that equal them. An empty table gives no rows.
    """
    sized = checkpointed(sized_documents(docs))
    sources = checkpointed(with_blocks(source_targets(sized, most_passes), block_words))
    lines = checkpointed(document_lines(sized))
    reads = schedule(sources).groupBy("key", "block").agg(F.count("*").alias("reads"), F.min("slot").alias("slot"))
    pieces = block_pieces(lines, sources).join(reads, ["key", "block"])
    taken = pieces.groupBy("source", "doc_id", "at").agg(F.sum(F.col("words") * F.col("reads")).alias("taken"), F.min("slot").alias("first_slot"))
    taken = taken.select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("at").alias("_a"), "taken", "first_slot")
    info = sources.select(F.col("source").alias("_t"), "source_size", "target")
    out = lines.join(taken, lines["source"].eqNullSafe(taken["_s"]) & lines["doc_id"].eqNullSafe(taken["_d"]) & (lines["at"] == taken["_a"]) & (lines["size"] > 0), "left")
    out = out.join(info, out["source"].eqNullSafe(info["_t"]))
    return out.select(lines["doc_id"], F.col("size"), F.col("source_size"), F.col("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


#: The same in SQL. {docs} is the table of documents. The schedule is made slot by slot: the golden-ratio point of each
#: slot falls into the interval of a source, and a source's slots read its blocks in turn.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM {docs}),
sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS key FROM sized GROUP BY source),
weighed AS (SELECT *, key % 3 + 1 AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM sums),
ranked AS (
  SELECT *, sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM weighed),
marked AS (SELECT *, cap * ahead <= weight * (total - spent) AS filled FROM ranked),
shared AS (
  SELECT *, total - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER () AS remains, sum(CASE WHEN filled THEN 0 ELSE weight END) OVER () AS open FROM marked),
targets AS (
  SELECT key, source, source_size, CASE WHEN filled THEN CAST(cap AS DOUBLE) ELSE CAST(remains * weight AS DOUBLE) / CAST(open AS DOUBLE) END AS target FROM shared),
blocked AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN greatest(1, round(source_size / 64)) ELSE 0 END AS BIGINT) AS blocks FROM targets),
needed AS (
  SELECT *, CAST(CASE WHEN blocks > 0 THEN round(target * blocks / source_size) ELSE 0 END AS BIGINT) AS need FROM blocked),
ordered AS (
  SELECT doc_id, source, size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM sized),
lines AS (
  SELECT doc_id, source, size, coalesce(CAST(sum(size) OVER (PARTITION BY source ORDER BY CAST(('0x' || substr(h, 1, 4)) AS INTEGER) % 256, h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS pos, row_number() OVER () AS n FROM ordered),
placed AS (SELECT l.*, s.source_size, s.target, s.blocks, s.need, s.key FROM lines l JOIN needed s ON l.source IS NOT DISTINCT FROM s.source),
cut AS (
  SELECT *, unnest(generate_series(((pos + 1) * blocks - 1) // source_size, ((pos + size) * blocks - 1) // source_size)) AS block FROM placed WHERE size > 0),
spread AS (
  SELECT key, blocks, need, CAST(sum(need) OVER () AS BIGINT) AS slots, CAST(sum(need) OVER (ORDER BY key) AS BIGINT) AS upto FROM needed WHERE need > 0),
bounds AS (
  SELECT key, blocks, need, slots, CAST((upto - need)::HUGEINT * 2147483648 // slots AS BIGINT) AS lo, CAST(upto::HUGEINT * 2147483648 // slots AS BIGINT) AS hi FROM spread),
points AS (
  SELECT i AS slot, i % 2147483648 * 1327217885 % 2147483648 AS point FROM (SELECT unnest(range((SELECT coalesce(max(slots), 0) FROM spread))) AS i)),
mapped AS (SELECT p.slot, b.key FROM points p ASOF JOIN (SELECT * FROM bounds WHERE lo < hi) b ON p.point >= b.lo),
early AS (SELECT slot, key, row_number() OVER (PARTITION BY key ORDER BY slot) - 1 AS rank FROM mapped),
had AS (SELECT key, count(*) AS had FROM early GROUP BY key),
late AS (
  SELECT CAST(NULL AS BIGINT) AS slot, s.key, unnest(range(coalesce(had, 0), need)) AS rank FROM spread s LEFT JOIN had USING (key) WHERE coalesce(had, 0) < need),
chosen AS (SELECT e.slot, e.key, rank % blocks AS block FROM (SELECT * FROM early UNION ALL SELECT * FROM late) e JOIN spread USING (key) WHERE rank < need),
reads AS (SELECT key, block, count(*) AS reads, min(slot) AS slot FROM chosen GROUP BY key, block),
pieces AS (
  SELECT n, (least(pos + size, (block + 1) * source_size // blocks) - greatest(pos, block * source_size // blocks)) * reads AS words, slot FROM cut JOIN reads USING (key, block) WHERE least(pos + size, (block + 1) * source_size // blocks) > greatest(pos, block * source_size // blocks)),
taken AS (SELECT n, CAST(sum(words) AS BIGINT) AS taken, min(slot) AS first_slot FROM pieces GROUP BY n)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(t.taken, 0) AS taken, t.first_slot FROM placed p LEFT JOIN taken t USING (n)
"""
