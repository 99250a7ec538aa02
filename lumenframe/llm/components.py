"""Connected components of an edge table, by alternating large-star and small-star rounds
(Kiveris et al., 2014).

Nodes are longs and may be of any number; nothing but one count and one checksum per round
reaches the driver. Smallest neighbours come from aggregates that combine before the shuffle,
and the joins that follow have one row per node on the right, so Spark may split a hot node.
Each round is cut off by ``checkpoint``.

Defined results: an edge with a null end says nothing and is left out, as is one from a node to itself; repeated
edges are one; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.lineage import ensure_checkpoint_dir
from lumenframe.llm.words import counted_apart


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (a, b), read both ways for a large star, from the larger end for a small one."""
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if large:
        both = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = counted_apart(both, ["u"], F.min("v").alias("v0")).select("u", F.least("u", "v0").alias("m"))
    joined = both.join(low, "u")
    if large:
        # Neighbours above u are tied to the smallest node around u.
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        # u and its smaller neighbours are tied to the smallest of them.
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge (a, b)."""
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.select("a", "b").filter("a <> b").distinct().checkpoint()  # the filter leaves null ends out too
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        edges = _star(_star(edges, True), False).checkpoint()
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
