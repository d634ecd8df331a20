"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_checkpoint
from .skew import joined

#: Edges, as counted, up to which a node's least neighbour is broadcast (16 bytes an edge), and edges of a task then.
FEW, EACH = 1 << 18, 1 << 16


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node and component (its least node) of every node in edges (a, b).

    Each round hangs every node's larger neighbours on its least one, then every
    node on the least of its smaller neighbours, until nothing moves. Rounds grow
    with the logarithm of the longest path; if edges still move in the last of
    ``most`` rounds, an error is raised. No node's neighbours are gathered: a
    round is two aggregations by minimum and two joins. Edges are counted after
    each round: up to FEW the minima are broadcast and tasks are few, beyond it
    edges of a node that has many of them are dealt over tasks.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = shared_checkpoint(now)
    before = _digest(now)
    for _ in range(most if before[0] else 0):
        now, total = _fewer(now, before[0]), before[0]
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _beside_least(both, total, 2 * total).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).filter("a <> b")
        if total > FEW:
            large = large.distinct()
        small = _beside_least(large, total, total).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = shared_checkpoint(_fewer(small.select("e.a", "e.b").filter("a <> b").distinct(), total))
        after = _digest(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components: edges still moved in round {most}")
    roots = _fewer(now.select(F.col("b").alias("node")).distinct(), before[0]).select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _fewer(df: DataFrame, edges: int) -> DataFrame:
    """Few edges in few tasks, whatever the shuffle's number."""
    return df.coalesce(-(-edges // EACH)) if 0 < edges <= FEW else df


def _beside_least(edges: DataFrame, total: int, rows: int) -> DataFrame:
    """Edges (a, b) with m, the least b of their a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    if total <= FEW:
        return edges.join(F.broadcast(_fewer(least.drop("n"), total)), "a")
    return joined(edges, least, "a", "b", rows).drop("n")


def _digest(edges: DataFrame) -> tuple:
    """Number of edges and the sum of their hashes: equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
