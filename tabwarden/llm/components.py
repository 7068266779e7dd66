"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.llm.tables import Tables


def _flattened(parents: DataFrame, write: Tables) -> DataFrame:
    """Follow (node, parent) to the roots; a parent is smaller than its node, or missing."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        step = parents.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved"))
        step = write(step, "parents")
        if step.where("moved").isEmpty():
            return step.select("node", "parent")
        parents = step.select("node", "parent")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b): the smallest node reachable.

    Each round every node joins its smallest neighbour, trees are flattened by pointer jumping and the
    edges are carried over to the roots, so a star ends in one round and a path of n in log n. Tables are
    written between the steps; joins on hot roots read them on both sides, so that Spark can split them.
    Self loops and repeated edges are allowed; a null end drops the edge. No edges: no rows.
    """
    write = Tables(edges.sparkSession, "components")
    all_edges = write(edges.select("a", "b").where("a is not null and b is not null").distinct(), "edges")
    live = all_edges.where("a <> b")
    labels = all_edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    labels = write(labels, "labels")
    while not live.isEmpty():
        both = live.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        hooked = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).where("parent < node")
        roots = _flattened(write(hooked, "hooked"), write)
        ra = roots.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        rb = roots.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = live.join(ra, "a", "left").select(F.coalesce("pa", "a").alias("a"), "b").join(rb, "b", "left").select("a", F.coalesce("pb", "b").alias("b"))
        live = write(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "live")
        rc = roots.select(F.col("node").alias("component"), F.col("parent").alias("root"))
        labels = write(labels.join(rc, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
    return labels
