"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import checkpointed

#: Edges in one partition, about.
EDGES_A_PART = 50_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    ``edges`` holds ``src`` and ``dst`` of one ordered type, in any direction, repeats and
    loops allowed. Each round links the larger neighbours of a node to its smallest one and
    then the smaller neighbours likewise, until the edges are stars around the smallest
    nodes; the number of rounds grows with the logarithm of the longest path. Minima are
    combined before each shuffle, and the joins are plain equi-joins which Spark splits
    where a node is hot. Every round is checkpointed, in as many partitions as its edges fill.
    No edge is ever collected. Edges with a null end are left out; without edges there are
    no rows.
    """
    loops = edges.filter("src = dst").select("src").distinct()
    e = checkpointed(
        edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    )
    signature = _signature(e)
    for _ in range(max_rounds):
        if not signature[0]:
            break
        parts = max(1, -(-signature[0] // EDGES_A_PART))
        before, e = e, checkpointed(_small_star(_large_star(e, parts), parts))
        now = _signature(e)
        # Equal counts and no new edge: the same edges.
        if now == signature and e.join(before, ["src", "dst"], "left_anti").isEmpty():
            break
        signature = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    centres = e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    alone = loops.select(F.col("src").alias("node"), F.col("src").alias("component"))
    found = stars.unionByName(centres).unionByName(alone)
    return found.groupBy("node").agg(F.min("component").alias("component"))


def _signature(e: DataFrame) -> tuple:
    """Differs if the edges differ, but for chance."""
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst") % 1000000007)).first())


def _large_star(e: DataFrame, parts: int) -> DataFrame:
    """Every larger neighbour of a node, linked to the smallest of the node and its neighbours."""
    e = e.coalesce(parts)
    both = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy(F.col("src").alias("n")).agg(F.min("dst").alias("m")).select("n", F.least("n", "m").alias("m")).coalesce(parts)
    return (
        both.filter("dst > src").join(least, F.col("src") == F.col("n"))
        .select(F.col("dst").alias("src"), F.col("m").alias("dst")).filter("src <> dst").coalesce(parts).distinct().coalesce(parts)
    )


def _small_star(e: DataFrame, parts: int) -> DataFrame:
    """Every smaller neighbour of a node and the node itself, linked to the smallest of them."""
    least = e.groupBy(F.col("src").alias("n")).agg(F.min("dst").alias("m")).coalesce(parts)
    moved = e.join(least, F.col("src") == F.col("n")).select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    own = least.select(F.col("n").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(own).filter("src <> dst").coalesce(parts).distinct().coalesce(parts)
