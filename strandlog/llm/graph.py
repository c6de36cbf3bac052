"""Connected components of a graph of longs, as DataFrame rounds over the shared folder.

Each round every node points to the neighbour (or itself) of the smallest hash, a hash that changes by round; edges
are rewritten to the pointed-to nodes and loops go. A round leaves about half of the nodes of a path, and one or two
of a star or clique, so the rounds grow with the logarithm of the longest path. No node's neighbours are gathered:
the minimum is pre-aggregated, and both sides of each join come from a written table, so that adaptive execution can
split a hub's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.runtime import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); nodes of a component, and no others, have the same root."""
    live = cut(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "edges")
    label: DataFrame | None = None
    turn = 0
    while label is None or not live.isEmpty():
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("v"))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        point = cut(best.select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["v"].alias("to")), "point")
        step = lambda e, c, out: e.join(point.select(F.col("node").alias(c), F.col("to").alias(out)), c)
        moved = step(step(live, "a", "p"), "b", "q").filter("p != q")
        live = cut(moved.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "edges")
        if label is None:
            label = point.select("node", F.col("to").alias("root"))
        else:
            last = point.select(F.col("node").alias("root"), "to")
            label = cut(label.join(last, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "label")
        turn += 1
    return label
