"""Places of rows in a global order: by ranges that Spark sorts, without one task for a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import stage


def positions(df: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """Adds pos (from 0) and n: a row's place within its group by ``order``, and the group's rows.

    Rows are cut into sorted ranges by (group, order), written with their place in the range, and ranges
    are counted; a range adds the counts of the ranges before it.  So a group may span all ranges.
    Rows of equal order take neighbouring places.  A null group isn't allowed.
    """
    keys = [group, *order]
    placed = stage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), label)
    placed = placed.withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("part", group).agg(F.min("at").alias("first"), F.count("*").alias("here"))
    whole = Window.partitionBy(group)  # a row for each range
    so_far = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select("part", group, "first", (F.sum("here").over(so_far) - F.col("here")).alias("before"), F.sum("here").over(whole).alias("n"))
    return placed.join(starts, ["part", group]).withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "before")
