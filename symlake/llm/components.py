"""Connected components of a table of links, by alternating star contractions.

Each round every node hands its larger neighbours, then its smaller ones, to its smallest neighbour, until each node
hangs on the smallest node of its component. Rounds are written tables: they survive lost executors and cut lineage.
Only counts reach the driver. A node with very many links is pre-aggregated before the shuffle, and the join back to
its links has the links on the side that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlake.llm.session import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``a > b`` holds for every edge here."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, component`` for every node that has a link; ``component`` is the smallest node reachable.

    ``edges(a, b)``: integer ids, any order, repeats and self-links allowed; rows with a null end are ignored."""
    clean = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, n = scratch.save(clean, f"{name}-0")
    mark, k = None, 0
    while n:
        k += 1
        current, n = scratch.save(_small_star(_large_star(current)), f"{name}-{k}")
        # Stars do not change any more: the same set of links as before.
        now = current.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if now == mark:
            break
        mark = now
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
