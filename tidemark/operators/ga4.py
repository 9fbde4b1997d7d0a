"""Warehouse sessions as a fallback: hourly planning, normalising of raw rows, candidate merge and lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.attribution import own_and_next, slot

DIMENSIONS = ["source", "medium", "campaign", "content", "term"]
PER_KEY, WINDOW_DAYS = 25, 7


def planned_hours(df: DataFrame, now: str, watermark: str, lookback_hours: int, backfill_hours: int) -> DataFrame:
    """Explodes each row to the hours to fetch: from the watermark less the backfill, or from the look-back, to the latest complete hour."""
    latest = F.date_trunc("hour", now) - F.expr("interval 1 hour")
    start = F.when(F.col(watermark).isNotNull(), F.date_trunc("hour", F.col(watermark)) - F.make_dt_interval(hours=F.lit(backfill_hours - 1))).otherwise(latest - F.make_dt_interval(hours=F.lit(lookback_hours - 1)))
    hours = F.when(start <= latest, F.sequence(start, latest, F.expr("interval 1 hour")))
    return df.withColumn("hour", F.explode(hours))


def parameter_value(p: Column) -> Column:
    """The value of an event parameter as text: string, int, float, double, whichever comes first."""
    return F.coalesce(F.nullif(F.trim(p["string_value"]), F.lit("")), p["int_value"].cast("string"), p["float_value"].cast("string"), p["double_value"].cast("string"))


def parameters(events: DataFrame, column: str = "event_params") -> DataFrame:
    """One row per event and parameter; events without any keep one row of nulls."""
    return events.withColumn("__p", F.explode_outer(column)).select("*", F.col("__p.key").alias("key"), parameter_value(F.col("__p")).alias("param")).drop("__p", column)


def clean_click_id(c: Column) -> Column:
    """Letters, digits, dot, underscore and hyphen only, else null."""
    return F.when(F.trim(c).rlike("^[A-Za-z0-9._-]+$"), F.trim(c))


# Parameters that hold a click id, in order.
CLICK_PARAMETERS = ["gclid", "dclid", "gbraid", "wbraid", "fbclid", "ttclid", "msclkid"]


def first_click_id(params: Column) -> Column:
    """struct(key, value): the first of CLICK_PARAMETERS, in any case, that has a clean value among (key, string_value) entries."""
    found = F.transform(F.array(*[F.lit(k) for k in CLICK_PARAMETERS]), lambda k: F.struct(k.alias("key"), clean_click_id(F.array_max(F.transform(F.filter(params, lambda p: F.lower(p["key"]) == k), lambda p: p["string_value"]))).alias("value")))
    return F.get(F.filter(found, lambda x: x["value"].isNotNull()), F.lit(0))


def export_list(rows: DataFrame, ts: str, key: str) -> DataFrame:
    """All rows, the latest first, then by key."""
    return rows.orderBy(F.desc(ts), F.asc(key))


def dimension_count() -> Column:
    return sum((F.col(d).isNotNull().cast("int") for d in DIMENSIONS), F.lit(0))


def has_signal() -> Column:
    return (dimension_count() > 0) | F.col("click_value").isNotNull()


def bundle_order() -> Column:
    """A row's bundle (dimensions and click id) replaces another's when this is larger, and stays on a tie."""
    return F.struct(has_signal().cast("int").alias("signal"), F.col("click_value").isNotNull().cast("int").alias("click"), dimension_count().alias("dims"), F.col("export_hour").alias("hour"), (F.col("table_type") == "events").cast("int").alias("daily"), (-F.col("ordinal")).alias("earlier"))


def merge_candidates(rows: DataFrame, keys: list[str], singles: list[str]) -> DataFrame:
    """One row per key: the best bundle; each single field's latest value that isn't null; flags by or; the latest retention.

    Rows arrive by ``ordinal``.  The rule is an order, so the fold over arrivals is a maximum and may be
    taken in parts.
    """
    bundle = F.max_by(F.struct(*DIMENSIONS, "click_type", "click_value", "export_hour", "table_type"), bundle_order())
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(c) for c in singles]
    out = rows.groupBy(*keys).agg(bundle.alias("__b"), *latest, F.max("required").alias("required"), F.max("retained_until").alias("retained_until"))
    return out.select(*keys, "__b.*", *singles, "required", "retained_until")


def eligible() -> Column:
    return F.col("required") & has_signal()


def lookup_order() -> list[Column]:
    """The order of rows that were looked up: recency, click id, freshness, daily tables, dimensions, ids."""
    daily = F.col("table_type") == "events"
    return [F.desc("occurred_at"), F.col("click_value").isNotNull().desc(), F.desc("export_hour"), daily.desc(), dimension_count().desc(), F.asc_nulls_last("session_key"), F.asc_nulls_last("client_key"), F.asc_nulls_last("transaction_key"), F.asc("candidate_key")]


def lookup(asks: DataFrame, candidates: DataFrame, keys: list[str], per_key: int = PER_KEY, days: int = WINDOW_DAYS) -> DataFrame:
    """ask_id, candidate_key, occurred_at, match_kind, place: eligible candidates by any of the keys within the window.

    Each key is an equi join with at most ``per_key`` of the latest rows, by key and slot of time, so that rows far out of
    the window aren't met; a candidate that several keys find is kept once, under the kind that sorts first.
    """
    good = candidates.where(eligible()).withColumn("__slot", own_and_next(F.col("occurred_at"), days))
    asks = asks.withColumn("__slot", slot(F.col("asked_at"), days))
    out = None
    for key in keys:
        met = asks.where(F.col(key).isNotNull()).select("ask_id", "asked_at", key, "__slot").join(good, [key, "__slot"]).drop("__slot")
        met = met.where((F.col("occurred_at") <= F.col("asked_at")) & (F.col("occurred_at") >= F.col("asked_at") - F.make_dt_interval(F.lit(days))))
        ranked = met.withColumn("__r", F.row_number().over(Window.partitionBy("ask_id").orderBy(F.desc("occurred_at"), "candidate_key"))).where(F.col("__r") <= per_key)
        part = ranked.drop("__r", "asked_at").withColumn("match_kind", F.lit(key))
        out = part if out is None else out.unionByName(part)
    once = out.withColumn("__r", F.row_number().over(Window.partitionBy("ask_id", "candidate_key", "occurred_at").orderBy("match_kind"))).where("__r = 1").drop("__r")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("ask_id").orderBy(*lookup_order())))
