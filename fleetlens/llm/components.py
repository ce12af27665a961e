"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.lineage import written


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node`` and ``component``, the least node of its component, for all nodes of edges ``a``, ``b``.

    Each round points every node at its least neighbour and joins the ends of what is
    left, so that the nodes of a component at least halve; edges that a round maps onto
    each other become one. A hub costs one row per edge, never a list.
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node"))
    turn = 0
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("from"), F.least("a", "least").alias("to")), f"{name}-parents-{turn}")
        # Two steps up at once: a chain of falling nodes shrinks faster.
        up = parents.alias("p").join(parents.alias("q"), F.col("p.to") == F.col("q.from"), "left").select(F.col("p.from").alias("from"), F.coalesce("q.to", "p.to").alias("to"))
        up = written(up, f"{name}-up-{turn}")
        edges = (
            edges.join(up.select(F.col("from").alias("a"), F.col("to").alias("x")), "a").join(up.select(F.col("from").alias("b"), F.col("to").alias("y")), "b")
            .filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        edges = written(edges, f"{name}-edges-{turn}")
        labels = labels.join(up, F.col("component") == F.col("from"), "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = written(labels, f"{name}-labels-{turn}")
        turn += 1
    return labels
