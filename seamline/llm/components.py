"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.storage import written


def component_labels(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges`` (long columns a and b); nodes have equal labels where they are connected.

    In each round every node hooks on to the node that comes first, in an order hashed anew, among itself, its neighbours and
    theirs, and the edges are contracted: a star is one node after one round, and of any shape a constant share of nodes
    goes each time. Each round's tables are written, so that lineage stays short and a node with very many rows can be
    split in joins.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, turn = None, 0
    while labels is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, k=turn: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("x"))
        firsts = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("b"), F.least("m", rank("a")).alias("m"))
        parents = both.join(firsts, "b").groupBy("a").agg(F.min("m")["x"].alias("parent")).withColumnRenamed("a", "node")
        parents = written(parents, "parents")
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("label"))
        else:
            step = parents.select(F.col("node").alias("label"), "parent")
            labels = written(labels.join(step, "label", "left").select("node", F.coalesce("parent", "label").alias("label")), "labels")
        pa, pb = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa")), parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = edges.join(pa, "a").join(pb, "b").where("pa <> pb")
        edges = written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        turn += 1
    return labels
