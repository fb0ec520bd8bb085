"""Connected components by edge contraction: hook every root to its smallest neighbouring root,
flatten by pointer jumping, relabel the edges, repeat until no edge joins two roots.

All state is in written tables; hubs are harmless, since minima are pre-aggregated before the
shuffle. Every round at least the roots that are no local minimum vanish.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _flatten(parent: DataFrame) -> DataFrame:
    """parent(node, root) with root <= node: jump until every root is its own."""
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
        parent = stash(parent.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "jump")
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
        if parent.join(up, "root").where("above <> root").isEmpty():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, root): every endpoint with the smallest node reachable from it.

    Null ends and self-links are ignored; repeated links count once; no link gives an empty table.
    """
    edges = stash(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    result = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    first = True
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")) \
            .select("node", F.least("node", "root").alias("root"))
        flat = _flatten(stash(hook, "hook"))
        result = flat if first else stash(
            result.join(flat.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left")
            .select("node", F.coalesce("above", "root").alias("root")), "roots")
        first = False
        at = lambda c: flat.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        edges = stash(edges.join(at("a"), "a").join(at("b"), "b").where("a_root <> b_root")
                      .select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges")
    return result
