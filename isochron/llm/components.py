"""Connected components by min-label rounds with pointer jumping, each round a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm.store import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link, from (a, b) rows; the component is its least node.

    A round gives each node the least label among its neighbours' and its own, then the label of its label, so a
    path of n nodes takes about log n rounds."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(both.filter("a <> b").distinct())
    labels = written(edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")))
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = step.alias("s").join(labels.alias("l"), F.col("s.component") == F.col("l.node"))
        after = written(jump.select("s.node", "s.old", F.least("s.component", "l.component").alias("component")))
        labels = after.select("node", "component")
        if after.filter("component < old").isEmpty():
            return labels
