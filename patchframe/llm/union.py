"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage


def components(links: DataFrame) -> DataFrame:
    """``v, root``: every vertex of ``links(a, b)`` and the smallest vertex it reaches.

    Each round every vertex of the contracted graph points to its smallest neighbour,
    pointers are followed twice, and the graph is contracted along them; a path loses
    at least three of four vertices a round.  Minima have map-side combine and look-ups
    join on a unique side, so a vertex with very many links is no single task.  Links
    to oneself, repeated links and links with a null end add nothing.
    """
    E = stage(links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    first = E
    while not E.isEmpty():
        ends = E.unionByName(E.select(F.col("b").alias("a"), F.col("a").alias("b")))
        P = stage(ends.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("p")).select(F.col("a").alias("v"), "p"), "pointers")
        up = P.select(F.col("v").alias("p"), F.col("p").alias("q"))
        J = P.join(up, "p").select("v", F.col("q").alias("p"))
        J = stage(J.join(up, "p").select("v", F.col("q").alias("p")), "jumps")
        if labels is None:
            new = J.select("v", F.col("p").alias("root"))
        else:
            new = labels.join(J.select(F.col("v").alias("root"), "p"), "root", "left").select("v", F.coalesce("p", "root").alias("root"))
        new = stage(new, "labels")
        a, b = J.select(F.col("v").alias("a"), F.col("p").alias("pa")), J.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        F_ = E.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        E_ = stage(F_, "links")
        for old in (P, J, labels, E if E is not first else None):
            if old is not None:
                drop_stage(old)
        E, labels = E_, new
    if labels is None:
        return first.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return labels


def local_roots(n: int, i, j):
    """Smallest index reachable from each of ``n`` indices by the links ``i - j`` (numpy arrays)."""
    import numpy as np

    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, root):
            return root
        root = new
