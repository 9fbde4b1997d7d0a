"""Streaming ingestion of micro events: admission, deduplication, and the session table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.time import local_date
from tidemark.sources.versions import exists
from tidemark.storage import stage

#: Events may be so old, and so far ahead of the clock.
MAX_AGE, MAX_SKEW = "24 hours", "300 seconds"


def rejection(ts: Column, as_of: Column) -> Column:
    """Why an event isn't admitted; null if it is."""
    return F.when(ts.isNull(), "no_time").when(ts < as_of - F.expr(f"interval {MAX_AGE}"), "too_old").when(ts > as_of + F.expr(f"interval {MAX_SKEW}"), "in_future")


def fingerprint(columns: list[str]) -> Column:
    """A hash of the fields' JSON in the given order, nulls included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def identified(events: DataFrame, columns: list[str]) -> DataFrame:
    """Adds event_key: the client's id of an event, else its fingerprint."""
    return events.withColumn("event_key", F.coalesce(F.nullif(F.trim("client_event_id"), F.lit("")), fingerprint(columns)))


def judged_batch(events: DataFrame, known: DataFrame, as_of: Column, order: str) -> DataFrame:
    """Adds outcome: why an event isn't admitted, duplicate of a known one or of an earlier admissible one of the batch, or accepted.

    A copy that isn't admitted never stands in the way of one that is.
    """
    why = events.withColumn("__why", rejection(F.col("ts"), as_of))
    first = F.row_number().over(Window.partitionBy("event_key", F.col("__why").isNull()).orderBy(order)) == 1
    old = known.select("event_key").distinct().withColumn("__known", F.lit(True))
    rows = why.withColumn("__first", first).join(old, "event_key", "left")
    outcome = F.coalesce("__why", F.when(~F.col("__first") | F.col("__known").isNotNull(), "duplicate"), F.lit("accepted"))
    return rows.withColumn("outcome", outcome).drop("__why", "__first", "__known")


def refresh_requests(accepted: DataFrame, orders: DataFrame) -> DataFrame:
    """kind, key of what a batch makes stale: local days of the cube, and orders of the batch's sessions."""
    days = accepted.select(F.lit("cube_day").alias("kind"), local_date(F.col("ts")).cast("string").alias("key"))
    touched = orders.join(accepted.select("session_id").distinct(), "session_id", "left_semi").select(F.lit("order").alias("kind"), F.col("order_id").cast("string").alias("key"))
    return days.union(touched).distinct()


def known_events(spark: SparkSession, path: str, batch: DataFrame, as_of: Column, number: int) -> DataFrame:
    """event_key of other batches' events that this batch can repeat: those of the days that its clock still admits.

    An event is admitted up to MAX_AGE after its time, so older days are never read and can be removed.
    """
    if not exists(spark, f"{path}/seen"):
        return spark.createDataFrame([], "event_key string")
    oldest, newest = batch.agg(F.to_date(F.min(as_of - F.expr(f"interval {MAX_AGE}"))), F.to_date(F.max(as_of + F.expr(f"interval {MAX_SKEW}")))).first()
    seen = spark.read.schema("event_key string, day date, batch int").parquet(f"{path}/seen")
    return seen.where(F.col("day").between(F.lit(oldest), F.lit(newest)) & (F.col("batch") != number)).select("event_key")


def ingest(batch: DataFrame, path: str, number: int, columns: list[str], as_of: Column) -> None:
    """One batch of a stream: judge, keep what is accepted, and write the batch's events, keys, partial sessions, rejects and stale days.

    The keys that later batches are held against, ``seen``, lie by day of the event.  All parts are written under the batch's number, the keys last,
    so that a batch that was broken off and comes again replaces itself.  ``as_of`` is the clock of an event's
    reception, best a column, so that a repeated batch is judged as before.
    """
    spark = batch.sparkSession
    rows = identified(batch, columns)
    judged = stage(judged_batch(rows, known_events(spark, path, batch, as_of, number), as_of, "ts"), "judged")
    accepted = judged.where("outcome = 'accepted'").drop("outcome")
    sessions = accepted.groupBy("session_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("events"))
    parts = {"events": accepted, "sessions": sessions, "rejected": judged.where("outcome <> 'accepted'"), "stale_days": accepted.select(local_date(F.col("ts")).alias("day")).distinct()}
    for name, part in parts.items():
        part.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
    for day in (r[0] for r in accepted.select(F.to_date("ts")).distinct().collect()):  # the days that the clock admits: two or three
        accepted.where(F.to_date("ts") == F.lit(day)).select("event_key").write.mode("overwrite").parquet(f"{path}/seen/day={day}/batch={number}")


def deduplicated(events: DataFrame, keys: list[str], ts: str = "ts", delay: str = MAX_AGE) -> DataFrame:
    """Events without those that repeat the keys within the watermark; state older than it is dropped."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def write_sessions(events: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each batch adds its sessions' partial rows under its own number, so that a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        part = batch.groupBy("session_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("events"))
        part.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    writer = events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The session table: partial rows of all batches added up."""
    return spark.read.parquet(path).groupBy("session_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("events").alias("events"))
