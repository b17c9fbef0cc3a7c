"""Connected components of a table of links, without gathering any component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.session import set_aside


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> id, component (the smallest id reachable) for every id in a link.

    Labels start as the ids.  In each round a node takes the smallest label next to it and then the
    label of its label, twice, so labels cross a chain in jumps.  Only minima and equi-joins are
    used; a node with many links is a skewed join key that Spark splits, never one task's list.
    """
    edges = set_aside(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = set_aside(
        edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("_near")).select("id", F.least("id", "_near").alias("component"))
    )
    while True:
        near = (
            edges.join(labels, edges["a"] == labels["id"])
            .groupBy("b")
            .agg(F.min("component").alias("_near"))
        )
        # Written before the jumps: they join it with itself, and would plan and run all above once for each side.
        lower = set_aside(
            labels.join(near, labels["id"] == near["b"]).select(
                "id", F.col("component").alias("_old"), F.least("component", "_near").alias("component")
            )
        )
        # Nothing lowered: both ends of every link have one label, so jumps change nothing either.
        if lower.filter(F.col("component") != F.col("_old")).isEmpty():
            return lower.select("id", "component")
        for _ in range(2):
            target = lower.select(F.col("id").alias("_to"), F.col("component").alias("_then"))
            lower = lower.join(target, lower["component"] == target["_to"]).select("id", F.col("_then").alias("component"))
        labels = set_aside(lower)
