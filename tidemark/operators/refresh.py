"""The cube kept up to date: a change set goes through orders and credits to local days, and only these are built anew."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.time import local_date
from tidemark.operators import attribution as A
from tidemark.operators import journey as J
from tidemark.operators import reporting as R
from tidemark.sources.versions import Versioned
from tidemark.storage import shared_dir, stage

CREDIT = ["order_id", "order_date", "source_name", "user_id", "model", *R.DIMENSIONS, "weight", "credit_cents"]


@dataclass
class Data:
    """What the cube is made of, as it is now."""

    touches: DataFrame
    sessions: DataFrame
    orders: DataFrame
    spend: DataFrame

    def credits(self, orders: DataFrame) -> DataFrame:
        return A.credits_of_lists(A.touch_lists(orders, self.sessions, self.touches)).select(CREDIT)


@dataclass
class Tables:
    """The stored credits, parted by the order's day, and the stored cube, parted by its day."""

    credits: Versioned
    cube: Versioned


def tables_for(spark: SparkSession, data: Data, path: str | None = None) -> Tables:
    """The two tables under a folder, by default a new one in the shared folder."""
    path = path or f"{shared_dir(spark).rstrip('/')}/live-{uuid.uuid4().hex}"
    credits = data.credits(data.orders)
    cube = R.cube(data.sessions, credits, data.orders, data.spend)
    return Tables(Versioned(spark, f"{path}/credits", credits.schema, "order_date"), Versioned(spark, f"{path}/cube", cube.schema, "metric_date"))


def create(tables: Tables, data: Data, run: str) -> None:
    """Build credits and cube from all data."""
    tables.credits.replace(data.credits(data.orders), None, f"{run}:credits")
    tables.cube.replace(R.cube(data.sessions, tables.credits.read(), data.orders, data.spend), None, f"{run}:cube")


def days_of(df: DataFrame, day: Column | str) -> list[str]:
    """The distinct days of a column as texts: as many as a table has parts."""
    text = (F.col(day) if isinstance(day, str) else day).cast("string")
    return sorted(r[0] for r in df.select(text.alias("d")).where("d is not null").distinct().collect())


def on_days(df: DataFrame, day: Column, days: list[str]) -> DataFrame:
    return df.where(day.isin(*[F.lit(d).cast("date") for d in days])) if days else df.limit(0)


def affected_orders(orders: DataFrame, touches: DataFrame, sessions: DataFrame) -> DataFrame:
    """The orders that changed touches or sessions can serve: by session at any time, by token or customer within the look-back.

    A touch reaches the days up to the look-back after it, so that orders meet the few changes by key and day.
    """
    reach = lambda ts: F.explode(F.sequence(F.to_date(ts), F.date_add(F.to_date(ts), A.LOOKBACK_DAYS))).alias("__day")
    dated = orders.withColumn("__day", F.to_date("ts"))
    parts = [orders.join(touches.select("session_id").distinct(), "session_id", "left_semi").select("order_id")]
    for key, rows, ts in (("checkout_token", touches, "ts"), ("cart_token", touches, "ts"), ("user_id", sessions, "first_seen")):
        near = rows.where(F.col(key).isNotNull()).select(key, reach(ts)).distinct()
        parts.append(dated.join(near, [key, "__day"], "left_semi").select("order_id"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.distinct()


def refresh(tables: Tables, data: Data, before: DataFrame, touches: DataFrame, orders: DataFrame, spend: DataFrame, run: str) -> list[str]:
    """Bring credits and cube up to date; returns the days of the cube that were built anew.

    ``touches``, ``orders`` and ``spend`` are new rows, ``data`` holds all rows with them, ``before`` the sessions as they were.
    Orders are affected that are new, that changed touches or sessions can serve, or whose customer has a new order,
    as the first order may be another.  Days are affected on which an affected order lies, a changed session begins
    or began, or spend is new.  Credits and cube are read and written for these days only; a repeated run
    changes nothing.
    """
    touched = touches.select("session_id").distinct()
    changed = stage(before.select("session_id", "user_id", "first_seen").union(data.sessions.select("session_id", "user_id", "first_seen")).join(touched, "session_id", "left_semi").distinct(), "changed")
    of_customers = data.orders.join(orders.select("user_id").distinct(), "user_id", "left_semi").select("order_id")
    hit = affected_orders(data.orders, touches, changed).union(of_customers).union(orders.select("order_id")).distinct()
    hit = stage(data.orders.join(hit, "order_id", "left_semi"), "affected")
    order_days = days_of(hit, "order_date")
    tables.credits.merge(data.credits(hit), hit.select("order_id"), order_days, f"{run}:credits")
    begins = local_date(F.col("first_seen"))
    days = sorted({*order_days, *days_of(changed, begins), *days_of(spend, "report_date")})
    there = on_days(data.orders, F.col("order_date"), days).select("user_id").distinct()
    ranked = data.orders.join(there, "user_id", "left_semi")  # a customer's rank needs all of the customer's orders
    rows = R.cube(on_days(data.sessions, begins, days), tables.credits.read(days), ranked, on_days(data.spend, F.col("report_date"), days))
    tables.cube.replace(rows, days, f"{run}:cube")
    return days


#: Parts of the stored journey facts; a customer's rows lie in one.
FACT_PARTS = 64


def fact_part(user_id: Column | str) -> Column:
    return F.pmod(F.xxhash64(user_id), F.lit(FACT_PARTS)).cast("int")


def facts_of(sessions: DataFrame, events: DataFrame, orders: DataFrame) -> DataFrame:
    return J.journey_facts(sessions, events, orders).withColumn("part", fact_part("user_id"))


def facts_table(spark: SparkSession, facts: DataFrame, path: str | None = None) -> Versioned:
    path = path or f"{shared_dir(spark).rstrip('/')}/facts-{uuid.uuid4().hex}"
    return Versioned(spark, path, facts.schema, "part")


def refresh_facts(table: Versioned, sessions: DataFrame, events: DataFrame, orders: DataFrame, changed: DataFrame, run: str) -> list[str]:
    """Bring the stored journey facts up to date for the customers (user_id) of new or changed rows; returns the parts that were written.

    All that a session's row says, its numbers and running sums among the customer's sessions, the window that ends with the customer's latest
    event, and the orders that its tokens meet, comes from rows of the same customer.  So a change spreads over its customers and no
    further: only their rows are read, put together again and swapped with their parts.
    """
    who = stage(changed.select("user_id").where("user_id is not null").distinct(), "customers")
    own = lambda df: df.join(who, "user_id", "left_semi")
    parts = sorted(str(r[0]) for r in who.select(fact_part("user_id")).distinct().collect())
    table.merge(facts_of(own(sessions), own(events), own(orders)), who, parts, run)
    return parts
