"""Connected components of large, sparse graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.corpus import discard, settled


def components(links: DataFrame) -> DataFrame:
    """Component (its least node) of every node with a link. ``links``: columns a, b.

    Each round gives a node the least label among its own and its neighbours', and then the
    label that its label has (a jump that halves long chains), until nothing changes. Only
    aggregates and joins by node: a node with very many links costs its links, not a task.
    """
    both = settled(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = settled(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "m").alias("new"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        # a label is a node, and its own label is no greater
        step = settled(hooked.join(jump, F.col("new") == F.col("_n")).select("node", F.least("new", "_l").alias("label"), "old"), "labels")
        labels = step.select("node", "label")
        if step.filter("label <> old").isEmpty():
            discard(both)
            return labels
