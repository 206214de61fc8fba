"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


#: Edges or keys of a task in which small tables are joined; a table of fewer rows takes one task and not as many as there
#: are shuffle partitions.
ROWS_OF_A_TASK = 100_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of about ``rows`` small rows in as few partitions as that takes."""
    return df.coalesce(rows // ROWS_OF_A_TASK + 1)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u long, v long); root is the least node of its component.

    Every round keeps at most one row for each edge and shuffles by node; minima are combined before the shuffle,
    and the join back onto a hub's edges is one that adaptive execution can split. The number of rounds grows with
    the logarithm of the nodes. Self-loops are ignored, so a node that has no other edge is not returned.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = checkpointed(e)
    state = _state(e)
    for _ in range(most_rounds):
        if not state[0]:
            break
        few = lambda df, n=state[0]: gathered(df, n)
        pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
        both = few(e).select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("e")).select("e.u", "e.v")
        least = few(both.groupBy("u").agg(F.min("v").alias("m"))).select("u", F.least("u", "m").alias("m"))
        large = few(few(both.join(least, "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = few(large.groupBy("u").agg(F.min("v").alias("m")))
        # Every neighbour of a node, and the node, gets the least of its neighbours.
        small = few(large.join(least, "u")).select(F.explode(F.array(pair("v", "m"), pair("u", "m"))).alias("e"))
        e = checkpointed(few(small.select("e.u", "e.v").where("u <> v").distinct()))
        before, state = state, _state(e)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    e = gathered(e, state[0])
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return gathered(e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), state[0])
