"""Connected components of an edge table, by hooking and contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """(node, label): each node of an edge with one node that stands for all it reaches.

    A round hooks each node to its smallest neighbour, follows the hooks to
    their roots, and keeps only edges between different roots, until none is
    left; should that take more than `rounds`, it raises.  Each step is written
    and its predecessor deleted; a lost executor costs one step at most.
    """
    open_ = shared.staged(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    labels = None
    for _ in range(rounds):
        both = open_.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(open_.select(F.col("b").alias("node"), F.col("a").alias("other")))
        roots = shared.staged(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root")), "roots")
        while True:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
            higher = roots.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved"))
            before, (roots, moved) = roots, shared.staged_counting(higher, "roots", F.col("moved"))
            shared.drop(before)
            if not moved:
                break
        if labels is None:
            labels = shared.staged(roots.select("node", F.col("root").alias("label")), "labels")
        else:
            before = labels
            labels = shared.staged(before.join(roots.select(F.col("node").alias("label"), "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
            shared.drop(before)
        one, other = roots.select(F.col("node").alias("a"), F.col("root").alias("x")), roots.select(F.col("node").alias("b"), F.col("root").alias("y"))
        between = open_.join(one, "a").join(other, "b").filter("x != y")
        between = between.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        before, (open_, left) = open_, shared.staged_counting(between, "edges", F.lit(True))
        shared.drop(before, roots)
        if not left:
            shared.drop(open_)
            return labels
    raise RuntimeError(f"components aren't settled after {rounds} rounds")
