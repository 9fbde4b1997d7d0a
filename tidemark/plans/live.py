"""Queries on tables that are kept up to date: versioned results (C12) and the cube by affected days."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import attribution as A
from tidemark.operators import refresh as U
from tidemark.operators import reporting as R
from tidemark.plans.base_sql import over_credits, over_cube
from tidemark.plans.journey import sessions_of
from tidemark.plans.registry import query
from tidemark.sources import views as V
from tidemark.sources.versions import Versioned
from tidemark.storage import shared_dir, stage

MEASURES = ", ".join(R.MEASURES)


def corrected(spark, sf_dir):
    """All orders' credits are stored; then every third order comes back with twice its money and replaces its rows, twice under one name."""
    orders, sessions, touches = V.orders(spark, sf_dir), stage(V.sessions(spark, sf_dir), "sessions"), V.touches(spark, sf_dir, dealt=True)
    journeys = stage(A.journeys(orders, sessions, touches), "journeys")
    credits = lambda rows: A.credits(rows).select(U.CREDIT)
    table = Versioned(spark, f"{shared_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex}", credits(journeys).schema, "order_date")
    table.replace(credits(journeys), None, "all orders")
    again = journeys.where("order_id % 3 = 0").withColumn("cents", F.col("cents") * 2)
    for _ in range(2):
        table.merge(credits(again), again.select("order_id").distinct(), U.days_of(again, "order_date"), "corrections")
    return table


@query("c12_versioned_credits", over_credits("SELECT model, order_id, count(*) AS touches, CAST(max(cents) * CASE WHEN order_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS cents FROM cred GROUP BY model, order_id"))
def c12_versioned(spark, sf_dir):
    return corrected(spark, sf_dir).read().groupBy("model", "order_id").agg(F.count("*").alias("touches"), F.sum("credit_cents").alias("cents"))


@query("c12_versions", over_credits("SELECT CAST(1 AS BIGINT) AS version, 'all orders' AS run, count(DISTINCT order_date) AS parts FROM ord UNION ALL SELECT 2, 'corrections', count(DISTINCT order_date) FROM ord"))
def c12_versions(spark, sf_dir):
    return corrected(spark, sf_dir).history().select("version", "run", "parts")


def arrived(spark, sf_dir, last: int) -> U.Data:
    """All that has arrived with batches 0 to ``last``: every third touch and order comes a batch later than the one before, whatever its time."""
    here = lambda df, c: df.where(F.col(c) % 3 <= last)
    touches = here(V.touches(spark, sf_dir, dealt=True), "event_id")
    return U.Data(touches, stage(sessions_of(touches), "sessions"), here(V.orders(spark, sf_dir), "order_id"), here(V.spend(spark, sf_dir).withColumn("__day", F.dayofmonth("report_date")), "__day").drop("__day"))


@query("c13_refreshed_cube", over_cube(f"SELECT CAST(metric_date AS VARCHAR) AS metric_date, model, source, medium, campaign, content, term, {MEASURES} FROM cube"))
def c13_refreshed(spark, sf_dir):
    """The cube of all rows, reached by two change sets of late touches, orders and spend."""
    data = arrived(spark, sf_dir, 0)
    tables = U.tables_for(spark, data)
    U.create(tables, data, "first")
    for batch in (1, 2):
        now, new = arrived(spark, sf_dir, batch), lambda df, c, b=batch: df.where(F.col(c) % 3 == b)
        spend = new(now.spend.withColumn("__day", F.dayofmonth("report_date")), "__day").drop("__day")
        U.refresh(tables, now, data.sessions, new(now.touches, "event_id"), new(now.orders, "order_id"), spend, f"batch {batch}")
        data = now
    return tables.cube.read().withColumn("metric_date", F.col("metric_date").cast("string"))
