"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the smallest node reachable.

    Each round gives a node, and the node it points to, the smallest label next to them, and
    then lets pointers jump, so the number of rounds grows with the logarithm of the longest
    path. Every step is a join or an aggregate with a partial step; rounds are staged.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        seen = (
            both.join(labels.withColumnRenamed("node", "b").withColumnRenamed("label", "theirs"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("theirs").alias("theirs"))
            .join(labels, "node")
        )
        offers = (
            seen.select("node", F.least("theirs", "label").alias("label"))
            .union(seen.filter("theirs < label").select(F.col("label").alias("node"), F.col("theirs").alias("label")))
            .groupBy("node")
            .agg(F.min("label").alias("label"))
        )
        offers = stage(offers, "offers")
        jump = offers.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = offers.join(jump, "label", "left").select(
            "node", F.coalesce("further", "label").alias("label")
        )
        new = stage(jumped, "labels")
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").filter("label <> old")
        if changed.isEmpty():
            return new
        labels = new
