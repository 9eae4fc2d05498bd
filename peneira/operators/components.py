"""Connected groups of linked nodes, by stars that shrink (alternating large-star and small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peneira.session import released, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the neighbours of every node to the least of them: the larger ones, or the node itself with the smaller ones."""
    if large:
        ways = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        ways = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = ways.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = joined.where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).unionAll(least.where("u <> m").select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where("a <> b").distinct()


def connected(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the least node of its group.

    No group is gathered anywhere: each round is two aggregations and joins by
    node, the number of rounds grows with the logarithm of the longest path,
    and each round's links are written to the shared folder, those of the round
    before removed. A node with very many neighbours has one row in the
    aggregate it is joined with, so the adaptive plan splits its side of the
    join. The driver sees whether a round was the last. No edges give no rows;
    loops and repeats are ignored.
    """
    now = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        shrunk = staged(_star(_star(now, True), False), "stars")
        released(now)
        now = shrunk
        # Done when all are stars apart: no node hangs on two others, and none on which others hang hangs itself.
        ends = now.select(F.col("b").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionAll(now.select(F.col("a").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        ways = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        if ways.where("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty():
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
