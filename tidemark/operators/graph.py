"""Connected components of a graph that is given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import stage


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for all ends of the (a, b) edges: the smallest id that each can reach.

    Labels spread along edges and then jump to the label of the label, so the rounds grow with the
    logarithm of a component's width.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("component")), "labels")
    while True:
        told = both.join(labels, both["a"] == labels["id"]).groupBy(F.col("b").alias("id")).agg(F.min("component").alias("told"))
        near = labels.join(told, "id").select("id", F.col("component").alias("was"), F.least("component", "told").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = stage(near.join(jump, "component", "left").select("id", "was", F.least("component", "further").alias("component")), "labels")
        moved = new.where("component < was").limit(1).count()
        labels = new.select("id", "component")
        if not moved:
            return labels
