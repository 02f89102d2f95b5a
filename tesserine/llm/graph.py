"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut, drop


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over edges (a, b).  Large star links every neighbour above a node,
    small star every neighbour at or below it, to the least of the neighbourhood."""
    if small:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(least.select(F.col("a").alias("k"), F.least("a", "m").alias("m")), F.col("a") == F.col("k"))
    if small:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(joined.select("a", F.col("m").alias("b")))
    else:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): each node of ``edges`` with the least node of its component.

    Rounds are O(log n) in practice; each is a table of the shared folder, so neither the
    plan nor the recovery of a lost executor grows with the rounds.  Edges with a null end
    and self-loops are left out; no edges give no rows.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    current = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        after = cut(_star(_star(current, False), True), "edges")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(current)
        current = after
        if mark == tuple(now):
            break
        mark = tuple(now)
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
