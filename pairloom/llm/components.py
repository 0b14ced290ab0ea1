"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.workspace import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b`` of one orderable type), where
    the component is the smallest node that can be reached.

    Alternates large-star and small-star steps: each node links its larger neighbours, then its
    smaller ones and itself, to the smallest node it sees. The number of edges does not grow and
    the number of rounds is about the logarithm of the longest path. Minima are aggregated
    before they are joined back, so a node with very many neighbours is no single group. Every
    round is stored in the checkpoint folder. Null nodes and loops are left out.
    """
    edges = edges.select("a", "b").filter("a <> b").distinct()
    edges, state = _stored(edges)
    while state.n:
        edges = _small_star(_large_star(edges))
        edges, after = _stored(edges)
        if after == state:
            break
        state = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct()
    )


def _stored(edges: DataFrame):
    edges = cut_lineage(edges)
    mark = F.sum(F.xxhash64("a", "b") % F.lit(2**40)).alias("mark")
    return edges, edges.agg(F.count(F.lit(1)).alias("n"), mark).first()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    larger = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return larger.filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    smaller = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return smaller.union(own).filter("a <> b").distinct()
