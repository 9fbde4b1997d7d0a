"""Stored attribution: result rows and credits, backfill of a window, and what explains a stored row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quality import completeness


def credit_rows(credited: DataFrame) -> DataFrame:
    """The stored credits: one row per order, model and touch."""
    return credited.select("order_id", "model", "position", "session_id", "ts", "source", "medium", "campaign", "content", "term", "weight", "credit_cents", "is_primary", "evidence")


def result_rows(journeys: DataFrame, tiers: DataFrame) -> DataFrame:
    """order_id, tier, evidence, session_id, source, medium, campaign, touches and the snapshot that is kept as JSON.

    One aggregation per order; the winner is the touch that is_winner marks.
    """
    won = F.max_by(F.struct("session_id", "source", "medium", "campaign", "click_value"), F.when(F.col("is_winner"), F.lit(1)))
    per = journeys.groupBy("order_id").agg(won.alias("w"), F.count_if(F.col("evidence") != "unattributed").alias("touches"))
    out = tiers.join(per, "order_id")
    winner = F.struct(F.col("w.session_id").alias("sessionId"), F.col("w.source").alias("source"), F.col("w.medium").alias("medium"), F.col("w.campaign").alias("campaign"), F.col("w.click_value").alias("clickIdValue"))
    snapshot = F.to_json(F.struct(F.col("tier"), F.col("confidence").alias("confidenceScore"), winner.alias("winner"), F.col("touches").alias("touchpointCount")), {"ignoreNullFields": "false"})
    return out.select("order_id", "tier", "evidence", "w.session_id", "w.source", "w.medium", "w.campaign", "touches", snapshot.alias("snapshot"))


def replaced(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Delete and insert: the rows of the keys that ``new`` holds are replaced as a whole."""
    return old.join(new.select(*by).distinct(), by, "left_anti").unionByName(new)


def in_window(rows: DataFrame, ts: str, first: Column, last: Column) -> DataFrame:
    """Rows of a rolling window of days, which a sync pulls anew and replaces by date."""
    return rows.where((F.to_date(ts) >= first) & (F.to_date(ts) <= last))


def backfill_scope(orders: DataFrame, first: Column, last: Column, web_only: bool = True) -> DataFrame:
    rows = orders.where((F.col("ts") >= first) & (F.col("ts") <= last))
    return rows.where(F.coalesce("source_name", F.lit("")) == "web") if web_only else rows


def next_batch(scope: DataFrame, results: DataFrame, size: int, after: tuple[str, int] | None = None) -> DataFrame:
    """The next orders without a result, oldest first, after a cursor (time, order)."""
    rows = scope.join(results.select("order_id"), "order_id", "left_anti")
    if after is not None:
        cursor = F.struct(F.lit(after[0]).cast("timestamp_ntz").alias("ts"), F.lit(after[1]).cast("long").alias("order_id"))
        rows = rows.where(F.struct("ts", "order_id") > cursor)
    return rows.orderBy("ts", "order_id").limit(size)


def backfilled(old: DataFrame, new: DataFrame, dry_run: bool = False) -> DataFrame:
    """The results after a backfill: new rows only where an order had none; a dry run changes nothing."""
    return old if dry_run else old.unionByName(new.join(old.select("order_id"), "order_id", "left_anti").select(old.columns))


def report(scope: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: total, missing before and after, recovered, and the rates of completeness."""
    was = completeness(scope, before).select("total", F.col("missing").alias("missing_before"), F.col("rate").alias("rate_before"))
    now = completeness(scope, after).select(F.col("missing").alias("missing_after"), F.col("rate").alias("rate_after"))
    return was.join(F.broadcast(now)).withColumn("recovered", F.col("missing_before") - F.col("missing_after"))


def lacking(orders: DataFrame, results: DataFrame) -> DataFrame:
    """order_id of orders without a result, or with one that names no source, medium or campaign."""
    known = results.select("order_id", F.coalesce("source", "medium", "campaign").isNotNull().alias("__named"))
    return orders.select("order_id").join(known, "order_id", "left").where(~F.coalesce("__named", F.lit(False))).select("order_id")


def fill_rates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, and for each column how many have a text and which share that is, 0 without rows."""
    counted = rows.agg(F.count("*").alias("rows"), *[F.count_if(F.coalesce(F.trim(c), F.lit("")) != "").alias(f"{c}_present") for c in columns])
    return counted.select("*", *[F.when(F.col("rows") > 0, F.col(f"{c}_present") / F.col("rows")).otherwise(0.0).alias(f"{c}_rate") for c in columns])


def coverage(rows: DataFrame, *keys: str) -> DataFrame:
    """Requested entities by status: resolved, fallback_name, unresolved, and their rates."""
    n = F.col("requested")
    state = lambda s: F.count_if(F.col("status") == s)
    out = rows.groupBy(*keys).agg(F.count("*").alias("requested"), state("resolved").alias("resolved"), state("fallback_name").alias("fallback"), state("unresolved").alias("unresolved"))
    return out.select("*", *[F.when(n > 0, F.col(c) / n).otherwise(0.0).alias(f"{c}_rate") for c in ("resolved", "fallback", "unresolved")])


def advanced(watermarks: DataFrame, done: DataFrame) -> DataFrame:
    """Stored watermarks (key, watermark) after processed hours (key, hour): they never go back."""
    new = done.groupBy("key").agg(F.max("hour").alias("hour"))
    return watermarks.join(new, "key", "full_outer").select("key", F.greatest("watermark", "hour").alias("watermark"))


def swept_batches(rows: DataFrame, ts: str, cutoff: Column, size: int, most: int) -> DataFrame:
    """One row: expired rows, how many a sweep of at most ``most`` batches of ``size`` deletes, its batches, and what is left."""
    expired = rows.where(F.col(ts) < cutoff).agg(F.count("*").alias("expired"))
    deleted = F.least(F.col("expired"), F.lit(size * most).cast("long"))
    return expired.select("expired", deleted.alias("deleted"), F.ceil(deleted / size).cast("long").alias("batches"), (F.col("expired") - deleted).alias("remaining"))

