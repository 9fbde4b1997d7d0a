"""The marketing views over the supplied tables: touches, sessions, orders and spend.

The supplied tables hold no marketing data; these mappings give each row a place in the domain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import cents
from tidemark.functions.time import local_date

DIMENSIONS = ["source", "medium", "campaign", "content", "term"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Micro events with session, tokens, dimensions and click id; ``dealt`` deals the rows of the table out, by user and time, before anything is made of them."""
    raw = table(spark, sf_dir, "events")
    raw = (raw.repartition("user_id", "ts") if dealt else raw).withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("int"))
    r = F.col("k") % 6
    paid = F.when(r.isin(0, 3), "cpc").when(r.isin(1, 2), "paid_social").when(r == 4, "email")
    named = F.when(r == 0, "google").when(r == 1, "meta").when(r == 2, "tiktok").when(r == 3, "microsoft").when(r == 4, "email")
    clicked = r.isin(0, 1) & (F.col("k") % 4 == 0)
    return raw.select(
        "event_id", "user_id", "ts", "event_type", "k", "value",
        F.concat(F.col("user_id").cast("string"), F.lit(":"), F.to_date("ts").cast("string")).alias("session_id"),
        named.alias("source"), paid.alias("medium"),
        F.when(named.isNotNull(), F.concat(F.lit("c"), (F.col("k") % 10).cast("string"))).alias("campaign"),
        F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("term"),
        F.when(clicked, F.when(r == 0, "gclid").otherwise("fbclid")).alias("click_type"),
        F.when(clicked, F.concat(F.lit("clk"), F.col("event_id").cast("string"))).alias("click_value"),
        F.concat(F.lit("t"), (F.col("event_id") % 500).cast("string")).alias("checkout_token"),
        F.concat(F.lit("c"), (F.col("event_id") % 300).cast("string")).alias("cart_token"),
    )


def touches(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    return events(spark, sf_dir, dealt).where(F.col("event_type").isin("view", "click", "signup"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's first and last time and the dimensions of its first touch.

    Touches are put in order before they are summed up, in the task that reads them.  A row group of the table is one task's
    at any size, so they are dealt out first, as narrow rows; a hot session is dealt out by time.
    """
    first = F.min_by(F.struct("event_id", *DIMENSIONS, "click_type", "click_value"), F.struct("ts", "event_id"))
    out = touches(spark, sf_dir, dealt=True).groupBy("session_id", "user_id").agg(first.alias("first"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("touches"))
    return out.select("session_id", "user_id", "first_seen", "last_seen", "touches", "first.*")


def orders(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Purchases as orders, money in cents."""
    bought = events(spark, sf_dir, dealt).where("event_type = 'purchase'")
    return bought.select(
        F.col("event_id").alias("order_id"), "user_id", "ts", cents(F.col("value")).alias("cents"),
        F.when(F.col("k") % 7 == 0, "pos").otherwise("web").alias("source_name"), "checkout_token", "cart_token", "session_id",
        local_date(F.col("ts")).alias("order_date"),
    )


def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ad spend rows in January 2024, money in cents."""
    rows = table(spark, sf_dir, "lineitem")
    google = F.col("l_returnflag") == "A"
    return rows.select(
        F.date_add(F.lit("2024-01-01").cast("date"), F.dayofyear("l_shipdate") % 30).alias("report_date"),
        (F.col("l_suppkey") % 5).alias("connection_id"), F.concat(F.lit("c"), (F.col("l_partkey") % 40).cast("string")).alias("campaign_id"),
        F.concat(F.lit("e"), (F.col("l_partkey") % 400).cast("string")).alias("entity_id"),
        F.when(google, "google").otherwise("meta").alias("platform"), F.when(F.col("l_linenumber") > 1, "creative").otherwise("campaign").alias("granularity"),
        F.when(google, "google").otherwise("meta").alias("source"), F.when(google, "cpc").otherwise("paid_social").alias("medium"),
        F.concat(F.lit("c"), (F.col("l_partkey") % 40).cast("string")).alias("campaign"),
        cents(F.col("l_extendedprice") * F.col("l_discount")).alias("cents"), F.col("l_quantity").cast("long").alias("clicks"),
        (F.col("l_quantity").cast("long") * 20).alias("impressions"),
    )


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("ts"), cents(F.col("o_totalprice")).alias("cents"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
