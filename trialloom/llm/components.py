"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import drop_written, written


def _to_roots(parents: DataFrame) -> DataFrame:
    """Pointer jumping: repeat parent := parent of parent until nothing changes."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = written(
            parents.join(above, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved"))
        )
        done = jumped.where("moved").isEmpty()
        drop_written(parents)
        parents = jumped
        if done:
            return parents


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(src, dst), both long; root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, jumps pointers to the roots
    and contracts the edges, so the larger end of every edge goes in each round (a star
    whose centre is its largest node takes two). All state is written tables: nothing is gathered on the driver. A hub's edges meet a lookup
    table with one row for each node, a join whose large side Spark can split.
    Null ends and self loops are ignored; no edges give no rows.
    """
    edges = written(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    result = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        parents = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("parent")).select("node", F.least("node", "parent").alias("parent"))
        roots = _to_roots(written(parents))
        if result is None:
            merged = roots.select("node", F.col("parent").alias("root"))
            result, old = merged, None
        else:
            hop = roots.select(F.col("node").alias("root"), F.col("parent").alias("top"))
            old, result = result, written(result.join(hop, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        a = roots.select(F.col("node").alias("src"), F.col("parent").alias("a"))
        b = roots.select(F.col("node").alias("dst"), F.col("parent").alias("b"))
        half = written(edges.join(a, "src").select("a", "dst"))
        after = half.join(b, "dst").where("a <> b").select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst"))
        last, edges = edges, written(after.distinct())
        for gone in (last, half, old):
            drop_written(gone)
    if result is None:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return result
