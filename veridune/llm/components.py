"""Connected components of an edge table, by contraction to least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(a long, b long); root is the least node of its component.

    Each round maps every node to its least neighbour, follows those maps twice, and contracts the edges.  Tables are
    written to the shared folder each round, so plans stay short, nothing is collected, and both sides of every join are
    plain reads, which adaptive execution can split where one hub has many edges.
    """
    edges = store.materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = store.materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "parent")
        for _ in range(2):
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            parent = store.materialize(parent.join(up, "p").select("a", F.col("q").alias("p")), "parent")
        if roots is None:
            roots = parent.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            step = parent.select(F.col("a").alias("root"), F.col("p").alias("to"))
            roots = roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = store.materialize(roots, "roots")
        pa_, pb = parent.select("a", F.col("p").alias("pa")), parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(pa_, "a").join(pb, "b").where("pa <> pb")
        edges = store.materialize(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
