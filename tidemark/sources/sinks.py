"""Upserts over Parquet tables, payload integrity, and exports.

Parquet has no MERGE: each flavour builds the merged rows as one plan, and ``replace_partitions``
writes only the partitions that the rows touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_new(old: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The incoming rows that are new by key, the first of each key."""
    first = incoming.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
    return first.join(old.select(*keys), keys, "left_anti")


def keep_first_known(old: DataFrame, incoming: DataFrame, keys: list[str], first: list[str], least: list[str], greatest: list[str], ordinal: str) -> DataFrame:
    """Fields keep their first value that isn't null; times widen."""
    both = old.withColumn("__old", F.lit(0)).unionByName(incoming.withColumn("__old", F.lit(1)))
    place = F.struct("__old", ordinal)
    return both.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in first], *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in greatest])


def incoming_wins(old: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming values replace old ones unless null; one incoming row per key."""
    rest = [c for c in old.columns if c not in keys]
    new = incoming.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in rest])
    return old.join(new, keys, "full_outer").select(*keys, *[F.coalesce(f"__new_{c}", c).alias(c) for c in rest])


def overwrite_rows(old: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last incoming row of a key replaces the old one as a whole."""
    both = old.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    ranked = both.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__new"), *order)))
    return ranked.where("__r = 1").drop("__r", "__new")


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Delete and insert by partition: only partitions that occur in rows are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def with_integrity(rows: DataFrame, payload: str) -> DataFrame:
    """Adds the payload's size in bytes and SHA-256; the payload's fields are in a pinned order."""
    return rows.withColumns({"payload_bytes": F.octet_length(payload).cast("long"), "payload_sha256": F.sha2(payload, 256)})


def integrity_status(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, size_matches, hash_matches, status of every expected payload."""
    a = actual.select(key, F.col("payload_bytes").alias("a_bytes"), F.col("payload_sha256").alias("a_hash"))
    out = expected.select(key, "payload_bytes", "payload_sha256").join(a, key, "left")
    size, same = F.col("payload_bytes").eqNullSafe(F.col("a_bytes")), F.col("payload_sha256").eqNullSafe(F.col("a_hash"))
    status = F.when(F.col("a_hash").isNull(), "missing").when(size & same, "intact").otherwise("mismatch")
    return out.select(key, size.alias("size_matches"), same.alias("hash_matches"), status.alias("status"))


def as_json(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """One JSON text per row under the names that an API shows."""
    return rows.select(F.to_json(F.struct(*[F.col(c).alias(n) for c, n in names.items()]), {"ignoreNullFields": "false"}).alias("json"))
