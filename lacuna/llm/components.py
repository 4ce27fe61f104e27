"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import settle


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); equal roots mean connected.

    Each round sends every node to its least neighbour or itself and keeps the
    edges between what is left, so a round at least halves the components'
    nodes as long as node numbers lie at random along paths; callers number
    nodes by a one-to-one hash. Each round's tables are kept in the shared
    folder. Node numbers are longs, never null.
    """
    edges = settle(_between(edges))
    steps = []
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        step = settle(step.select("node", F.least("node", "to").alias("to")))
        steps.append(step)
        first = step.select(F.col("node").alias("a"), F.col("to").alias("a_to"))
        second = step.select(F.col("node").alias("b"), F.col("to").alias("b_to"))
        edges = edges.join(first, "a").join(second, "b")
        edges = settle(_between(edges.select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))))
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[0].withColumnRenamed("to", "root")
    for step in steps[1:]:
        later = step.select(F.col("node").alias("root"), "to")
        found = found.join(later, "root", "left").select(
            "node", F.coalesce("to", "root").alias("root")
        )
    return found


def _between(edges: DataFrame) -> DataFrame:
    """Each edge once, without loops."""
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return edges.filter(F.col("a") != F.col("b")).select(low, high).distinct()
