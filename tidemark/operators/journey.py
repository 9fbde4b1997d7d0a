"""Customer journeys: what happened in each session, which orders it led to, and its place among the customer's sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days before a journey's anchor (its latest evidence) that count.
LOOKBACK_DAYS = 30
# Kinds of micro events, by the supplied tables' names.
EVENT_KINDS = {"view": "page_view", "click": "product_view", "signup": "add_to_cart", "purchase": "checkout_started"}


def windows(events: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """user_id, starts, expires: the days up to the journey's latest event, both ends inclusive."""
    return events.groupBy("user_id").agg(F.max("ts").alias("expires")).select("user_id", (F.col("expires") - F.make_dt_interval(F.lit(days))).alias("starts"), "expires")


def inside(ts: str) -> Column:
    return (F.col(ts) >= F.col("starts")) & (F.col(ts) <= F.col("expires"))


def event_rollup(events: DataFrame) -> DataFrame:
    """Per session: first and last event, counts by kind, distinct tokens in order."""
    counts = [F.count_if(F.col("event_type") == raw).alias(f"{kind}_count") for raw, kind in EVENT_KINDS.items()]
    tokens = [F.array_sort(F.collect_set(t)).alias(f"{t}s") for t in ("checkout_token", "cart_token")]
    return events.groupBy("session_id").agg(F.min("ts").alias("first_event_at"), F.max("ts").alias("last_event_at"), F.count("*").alias("event_count"), *counts, *tokens)


def session_orders(sessions: DataFrame, rollup: DataFrame, orders: DataFrame) -> DataFrame:
    """session_id, order_id, cents, ts: orders that began in a session or carry one of its tokens.

    Three equi joins on (customer, key) and one distinct, in place of a join on alternatives.
    """
    o = orders.select("order_id", "user_id", "ts", "cents", F.col("session_id").alias("landing"), "checkout_token", "cart_token")
    s = sessions.select("session_id", "user_id", "starts", "expires")
    met = o.join(s.withColumn("landing", F.col("session_id")), ["user_id", "landing"])
    found = met.where(inside("ts")).select("session_id", "order_id", "cents", "ts")
    for token in ("checkout_token", "cart_token"):
        keys = s.join(rollup, "session_id").select("session_id", "user_id", "starts", "expires", F.explode(f"{token}s").alias(token))
        found = found.unionByName(o.join(keys, ["user_id", token]).where(inside("ts")).select("session_id", "order_id", "cents", "ts"))
    return found.distinct()


def journey_facts(sessions: DataFrame, events: DataFrame, orders: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """One row per session within its journey's window, with the session's, the journey's and its place's measures."""
    window = windows(events, days)
    scoped = sessions.join(window, "user_id").where(inside("first_seen"))
    rollup = event_rollup(events)
    own = session_orders(scoped, rollup, orders).groupBy("session_id").agg(F.count("*").alias("session_orders"), F.sum("cents").alias("session_cents"), F.min("ts").alias("session_first_order_at"))
    whole = orders.join(window, "user_id").where(inside("ts")).groupBy("user_id").agg(F.count("*").alias("journey_orders"), F.sum("cents").alias("journey_cents"))
    zero = F.lit(0).cast("long")
    rows = scoped.join(rollup, "session_id", "left").join(own, "session_id", "left").join(whole, "user_id", "left").select(
        "user_id", "session_id", F.coalesce("first_event_at", "first_seen").alias("started_at"), F.greatest("last_seen", "last_event_at", "first_seen").alias("ended_at"),
        *[F.coalesce(c, zero).alias(c) for c in ("event_count", *[f"{k}_count" for k in EVENT_KINDS.values()], "session_orders", "session_cents", "journey_orders", "journey_cents")],
        "session_first_order_at", "source", "campaign",
    )
    journey = Window.partitionBy("user_id")
    ordered = journey.orderBy("started_at", "session_id")
    rows = rows.select(
        "*", F.row_number().over(ordered).alias("session_number"), F.count("*").over(journey).alias("journey_sessions"), F.min("started_at").over(journey).alias("journey_started_at"),
        F.max("ended_at").over(journey).alias("journey_ended_at"), F.sum("event_count").over(journey).alias("journey_events"),
        F.sum("event_count").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("event_end_number"),
    )
    return rows.withColumns({
        "reverse_number": F.col("journey_sessions") - F.col("session_number") + 1,
        "event_start_number": F.when(F.col("event_count") > 0, F.col("event_end_number") - F.col("event_count") + 1).otherwise(zero),
        "is_first": F.col("session_number") == 1, "is_last": F.col("session_number") == F.col("journey_sessions"), "is_converting": F.col("session_orders") > 0,
    })


def affected_orders(touches: DataFrame, orders: DataFrame) -> DataFrame:
    """order_id of every order that one of the touches can have led to: by session, token or customer."""
    parts = [orders.join(touches.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi").select("order_id") for key in ("session_id", "checkout_token", "cart_token", "user_id")]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.distinct()


def relinked_sessions(sessions: DataFrame, evidence: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """session_id, evidence_at: sessions seen up to ``days`` before later evidence of the same customer, with the newest such evidence.

    The newest evidence up to ``days`` after a time is looked for in the customer's order of times, so no pairs are made.
    """
    e = evidence.select("user_id", F.col("ts").alias("at"), F.lit(None).cast("string").alias("session_id"), F.col("ts").alias("evidence_at"))
    s = sessions.select("user_id", F.col("last_seen").alias("at"), "session_id", F.lit(None).cast("timestamp_ntz").alias("evidence_at"))
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    after = Window.partitionBy("user_id").orderBy(micros).rangeBetween(Window.currentRow, days * 86_400_000_000)
    met = e.unionByName(s).withColumn("evidence_at", F.max("evidence_at").over(after)).where("session_id is not null and evidence_at is not null")
    return met.groupBy("session_id").agg(F.max("evidence_at").alias("evidence_at"))
