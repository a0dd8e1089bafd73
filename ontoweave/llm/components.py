"""Connected components of an edge table by alternating stars; all state stays in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, dropped, written

#: Nodes with more edges than this, or than the edges by half of BROADCAST_IDS, are hot.
HOT = 1000


def _with_least(edges: DataFrame, rows: DataFrame, used: list[DataFrame]) -> DataFrame:
    """rows (a, b) with m, the least of each a by the written table edges (a, m, n: its number of edges).

    Few nodes are broadcast. Of many, the hot ones are: they are BROADCAST_IDS / 2 at most, as each has its share of the
    edges; the others meet by a shuffle in which no node has more than HOT rows, or that share."""
    used.append(edges)
    total = edges.agg(F.count("*"), F.sum("n")).first()
    if total[0] <= BROADCAST_IDS:
        return rows.join(F.broadcast(edges.select("a", "m")), "a")
    limit = max(HOT, 2 * total[1] // BROADCAST_IDS + 1)
    tagged = rows.join(F.broadcast(edges.where(F.col("n") > limit).select("a", "m")), "a", "left")
    cold = tagged.where("m is null").select("a", "b").join(edges.where(F.col("n") <= limit).select("a", "m"), "a")
    return tagged.where("m is not null").unionByName(cold)


def _large_star(edges: DataFrame, used: list[DataFrame]) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "least")
    return _with_least(least, both, used).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, used: list[DataFrame]) -> DataFrame:
    least = written(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
    low = _with_least(least, edges, used).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, label) of each node of edges (a, b: bigint); label is the smallest node of the component.

    Large and small stars alternate until nothing changes, in a number of rounds that grows with the logarithm of the
    component. Each round is written tables, so lineage stays short. Minima are partial aggregates, and a node with many
    neighbours meets its minimum by a broadcast of bounded size, never in one task. Loops, repeated and reversed edges are
    allowed; edges with a null end are left out; no edges give no rows.
    """
    spark = edges.sparkSession
    now = written(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        used = [now]
        large = written(_large_star(now, used), "edges")
        after = written(_small_star(large, used), "edges")
        new = _state(after)
        dropped(spark, large, *used)
        now, same, state = after, new == state, new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct())
