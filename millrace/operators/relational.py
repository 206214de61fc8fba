"""Relational operators that are compositions of built-in ones, in forms that hold at scale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.checkpoints import checkpointed


def ordering(*keys: str) -> list[Column]:
    """Sort keys with the host's null order: ascending nulls last, descending ("-name") nulls first."""
    return [F.col(k[1:]).desc_nulls_first() if k.startswith("-") else F.col(k).asc_nulls_last() for k in keys]


def order_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*ordering(*keys))


def distinct_on(df: DataFrame, on: list[str], *keys: str) -> DataFrame:
    """The first row by ``keys`` of each group of ``on``."""
    return top_n_per_group(df, on, 1, *keys)


def top_n_per_group(df: DataFrame, on: list[str], n: int, *keys: str) -> DataFrame:
    """The first n rows of each group. The limit on the rank is applied before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(*on).orderBy(*ordering(*keys)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def with_ties(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """FETCH FIRST n ROWS WITH TIES: the n-th row's keys are found by a top-k, and rows up to it stay."""
    edge = df.orderBy(*ordering(*keys)).limit(n).select(*[F.col(k.lstrip("-")) for k in keys])
    last = edge.orderBy(*[F.col(k[1:]).asc_nulls_last() if k.startswith("-") else F.col(k).desc_nulls_first() for k in keys]).limit(1)
    rows = last.collect()
    if not rows:
        return df
    keep, equal = F.lit(False), F.lit(True)
    for k in keys:
        name, value = k.lstrip("-"), F.lit(rows[0][k.lstrip("-")])
        c = F.col(name)
        before = (c > value) | (c.isNull() & value.isNotNull()) if k.startswith("-") else (c < value) | (c.isNotNull() & value.isNull())
        keep = keep | (equal & F.coalesce(before, F.lit(False)))
        equal = equal & c.eqNullSafe(value)
    return df.where(keep | equal)


def qualify(df: DataFrame, name: str, value: Column, condition: str) -> DataFrame:
    """Filter on a window expression."""
    return df.withColumn(name, value).where(condition)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, how: str = "left", slices: int = 1) -> DataFrame:
    """Each left row with the latest right row of the same ``by`` at or before its time.

    One union, one shuffle by ``by`` and one sorted pass; no pairs are made. Right columns other than ``by`` must have
    names of their own. Of right rows with one time the last in the order of their other columns counts.

    slices: into so many ranges of the right side's times each key is cut, so that a key with a large share of the rows
    takes as many tasks. What a range begins with is carried over from one row for each key and range.
    """
    others = [c for c in right.columns if c not in by]
    rest = [c for c in left.columns if c not in by]
    payload = F.struct(*others)
    a = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*rest).alias("_l"), F.lit(None).cast(right.select(payload.alias("x")).schema["x"].dataType).alias("_r"))
    b = right.where(F.col(right_time).isNotNull()).select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*rest).alias("x")).schema["x"].dataType).alias("_l"), payload.alias("_r"))
    rows, keys, before = a.unionByName(b), [*by], F.lit(None)
    if slices > 1:
        ends = b.agg(F.percentile_approx("_t", [i / slices for i in range(1, slices)]).alias("e")).first()["e"] or []
        cuts = [F.lit(e).cast(b.schema["_t"].dataType) for e in ends]
        rows = rows.withColumn("_s", sum((F.when(F.col("_t") > c, 1).otherwise(0) for c in cuts), F.lit(0)))
        last = rows.groupBy(*by, "_s").agg(F.max_by("_r", F.when(F.col("_side") == 0, F.struct("_t", "_r"))).alias("_last"))
        earlier = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        last = last.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_s").alias("_k_s"), F.last("_last", ignorenulls=True).over(earlier).alias("_before")).where("_before is not null")
        rows = rows.join(last, [*[rows[c].eqNullSafe(last[f"_k_{c}"]) for c in by], rows["_s"] == last["_k_s"]], "left")
        keys, before = [*by, "_s"], F.col("_before")
    window = Window.partitionBy(*keys).orderBy(F.col("_t").asc_nulls_first(), "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumn("_m", F.last("_r", ignorenulls=True).over(window)).where("_side = 1")
    joined = joined.withColumn("_m", F.when(F.col("_t").isNotNull(), F.coalesce(F.col("_m"), before))) if slices > 1 else joined
    if how == "inner":
        joined = joined.where("_m is not null")
    return joined.select(*by, "_l.*", "_m.*")


def count_distinct_over(df: DataFrame, partition: list[str], x: Column, name: str) -> DataFrame:
    """``df`` with count(DISTINCT x) of each row's partition: the largest dense rank, one shuffle and no set of values."""
    rank = F.dense_rank().over(Window.partitionBy(*partition).orderBy(F.col("_x").asc_nulls_last()))
    ranked = df.withColumn("_x", x).withColumn("_d", F.when(F.col("_x").isNotNull(), rank))
    return ranked.withColumn(name, F.coalesce(F.max("_d").over(Window.partitionBy(*partition)), F.lit(0)).cast("bigint")).drop("_x", "_d")


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def compare_subquery(df: DataFrame, x: Column, op: str, quantifier: str, values: DataFrame, name: str) -> DataFrame:
    """``df`` with x op ALL (values) or x op ANY (values), for > >= < and <=, nulls and empty sets as SQL has them. ``values``
    has one column; its extremes and its counts are one row that goes to every task."""
    v = F.col(f"`{values.columns[0]}`")
    facts = values.agg(F.count("*").alias("_n"), F.count(v).alias("_known"), F.min(v).alias("_least"), F.max(v).alias("_most"))
    everything = quantifier.upper() == "ALL"
    edge = F.col("_most") if (op[0] == ">") == everything else F.col("_least")
    holds = _COMPARE[op](x, edge)
    decided = F.when(F.col("_n") == 0, everything).when(~holds if everything else holds, not everything)
    answer = decided.when((F.col("_known") < F.col("_n")) | x.isNull(), F.lit(None).cast("boolean")).otherwise(everything)
    return df.join(F.broadcast(facts)).withColumn(name, answer).drop("_n", "_known", "_least", "_most")


def range_join(left: DataFrame, right: DataFrame, at: str, low: str, high: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Left rows whose ``at`` is in [low, high] of a right row. Numbers only.

    Ranges are cut into cells of ``width``, so the join is on equal cells and doesn't compare all pairs; a range costs
    as many rows as it has cells.
    """
    keys = by or []
    points = left.withColumn("_cell", F.floor(F.col(at) / width).cast("bigint"))
    ranges = right.where(F.col(low) <= F.col(high)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / width).cast("bigint"), F.floor(F.col(high) / width).cast("bigint"))))
    return points.join(ranges, [*keys, "_cell"]).where(F.col(at).between(F.col(low), F.col(high))).drop("_cell")


def with_positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with 0-based positions in a total order: a range-partitioned sort and the partitions' offsets, so rows
    are never in one task. The sorted rows are kept, because offsets and rows must come from the same partitions."""
    tagged = checkpointed(df.sort(*order).withColumn("_mono", F.monotonically_increasing_id()))
    tagged = tagged.withColumn("_part", F.shiftright("_mono", 33))
    sizes = tagged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_start")
    inside = F.col("_mono") - F.shiftleft(F.col("_part"), 33)
    return tagged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + inside).drop("_mono", "_part", "_start")


def positional_join(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Rows of both sides side by side by position; the shorter side is filled with nulls."""
    a, b = with_positions(left, left_order, "_p"), with_positions(right, right_order, "_p")
    return a.join(b, "_p", "full").drop("_p")


def recursive_distinct(seed: DataFrame, step: Callable[[DataFrame], DataFrame], most_rounds: int = 100) -> DataFrame:
    """WITH RECURSIVE ... UNION: rows that the step adds to what the last round added, until there are no new ones."""
    found = new = checkpointed(seed.distinct())
    for _ in range(most_rounds):
        new = checkpointed(step(new).select(*found.columns).subtract(found))
        if new.isEmpty():
            return found
        found = checkpointed(found.unionByName(new))
    raise RuntimeError("the recursion did not end")


def union_by_name(a: DataFrame, b: DataFrame, distinct: bool = False) -> DataFrame:
    """UNION [ALL] BY NAME: columns that one side lacks are null there."""
    both = a.unionByName(b, allowMissingColumns=True)
    return both.distinct() if distinct else both


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def pivot(df: DataFrame, by: list[str], on: str, values: list, aggregate: Column) -> DataFrame:
    """One column for each of the given values of ``on``."""
    return df.groupBy(*by).pivot(on, values).agg(aggregate)


def groups_frame_sum(df: DataFrame, partition: list[str], order: str, x: str, before: int, after: int, name: str) -> DataFrame:
    """sum(x) over a GROUPS frame: peers count as one. A dense rank makes it a range frame."""
    ranked = df.withColumn("_g", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*ordering(order))))
    return ranked.withColumn(name, F.sum(x).over(Window.partitionBy(*partition).orderBy("_g").rangeBetween(-before, after))).drop("_g")


def sum_excluding_current(x: str, window) -> Column:
    """sum(x) over a frame with EXCLUDE CURRENT ROW."""
    return F.when(F.count(x).over(window) - F.when(F.col(x).isNotNull(), 1).otherwise(0) > 0, F.sum(x).over(window) - F.coalesce(F.col(x), F.lit(0)))


def sample(df: DataFrame, percent: float, seed: int | None = None) -> DataFrame:
    """TABLESAMPLE: each row with a probability (SYSTEM and BERNOULLI alike)."""
    if not 0 <= percent <= 100:
        raise ValueError("sample percentage must be between 0 and 100")
    if percent == 100:
        return df
    return df.sample(withReplacement=False, fraction=percent / 100, seed=seed)


def sample_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """TABLESAMPLE (n ROWS): n random rows by a top-k over random numbers."""
    return df.orderBy(F.rand(seed)).limit(n)
