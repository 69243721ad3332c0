"""Connected components over an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): every node of `edges` (a, b; longs) with the smallest node that it reaches.

    Each round gives every node its smallest neighbour as parent, follows parents twice, and replaces
    the ends of all edges by those roots; edges inside a component vanish, so the table shrinks by a
    factor each round and the number of rounds grows with its logarithm. The smallest node of a
    component always keeps itself. Hubs are pre-aggregated before each shuffle, and all tables of a round are
    written to the shared folder. Self loops and repeated edges are ignored; no edges give no rows.
    """

    def narrowed(e: DataFrame) -> DataFrame:
        return e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()

    left, found = scratch.save(narrowed(edges), "edges"), None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        parent = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent"))
        parent = scratch.save(parent, "parents")
        for _ in range(2):
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            parent = parent.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"))
        parent = scratch.save(parent, "roots")
        before, rest = found, left
        if found is None:
            found = scratch.renamed(parent, "node", "component")  # the first round has all nodes
        else:
            roots = parent.select(F.col("node").alias("component"), "parent")
            found = scratch.save(found.join(roots, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "components")
        of_a = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        of_b = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        left = scratch.save(narrowed(left.join(of_a, "a").join(of_b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "edges")
        scratch.drop(before, rest)
    return found if found is not None else scratch.renamed(left, "node", "component")
