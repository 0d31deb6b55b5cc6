"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundmesh.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge table (u, v).

    Each round every node points at its smallest neighbour, pointers are followed once more, and edges shrink to those
    between different roots; rounds are about the logarithm of the longest chain. Neighbour minima are partial
    aggregates and the joins are ones that AQE can split, so a hub does not gather its edges in one task. Every
    round is written to the shared folder.
    """
    nodes = materialize(edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct().select("node", F.col("node").alias("component")), "nodes")
    left = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    while left.limit(1).count():
        both = left.union(left.select("v", "u"))
        pointer = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("to"))
        pointer = materialize(pointer, "pointers")
        further = pointer.select(F.col("u").alias("to"), F.col("to").alias("root"))
        roots = materialize(pointer.join(further, "to", "left").select("u", F.coalesce("root", "to").alias("root")), "roots")
        named = materialize(nodes.join(roots.withColumnRenamed("u", "component"), "component", "left").select("node", F.coalesce("root", "component").alias("component")), "nodes")
        moved = left.join(roots, "u").select(F.col("root").alias("u"), "v")
        moved = moved.join(roots.select(F.col("u").alias("v"), F.col("root").alias("to")), "v").where("u <> to")
        shrunk = materialize(moved.select(F.least("u", "to").alias("u"), F.greatest("u", "to").alias("v")).distinct(), "edges")
        discard(pointer, roots, nodes, left)
        nodes, left = named, shrunk
    discard(left)
    return nodes
