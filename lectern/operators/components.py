"""Connected components of a link table, by alternating star contractions.

Every round is two joins and two aggregations on node ids, so no component is ever gathered in one
task; the rounds are logarithmic in the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.storage import drop_table, materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns ``node`` and ``component``: the smallest node reachable, for each node with a link.

    Links that are null at either end and self links are ignored; repeated links and either
    direction are fine; no links give no rows.
    """
    edges = materialize(_tidy(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), "links")
    before = None
    while True:
        after = _fingerprint(edges)
        if after == before or after[0] == 0:
            break
        before = after
        large = _large_star(edges)
        contracted = materialize(_small_star(large), "links")
        drop_table(edges)
        edges = contracted
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)


def _tidy(edges: DataFrame) -> DataFrame:
    """u > v, each link once."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the least of that node's neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, is linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _tidy(moved.unionByName(least.select("u", F.col("m").alias("v"))))
