"""Queries on customer journeys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import journey as J
from tidemark.operators import refresh as U
from tidemark.plans.base_sql import over
from tidemark.plans.registry import query
from tidemark.sources import views as V


def _us(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def _events(spark, sf_dir):
    return V.events(spark, sf_dir).where("event_type <> 'error'")


JOURNEY = """
good AS (SELECT * FROM ev WHERE event_type <> 'error'),
win AS (SELECT user_id, max(ts) - INTERVAL 30 DAY AS starts, max(ts) AS expires FROM good GROUP BY 1),
roll AS (SELECT session_id, min(ts) AS first_event_at, max(ts) AS last_event_at, count(*) AS event_count, count(*) FILTER (event_type = 'view') AS page_view_count, count(*) FILTER (event_type = 'click') AS product_view_count,
  count(*) FILTER (event_type = 'signup') AS add_to_cart_count, count(*) FILTER (event_type = 'purchase') AS checkout_started_count, list_sort(list(DISTINCT checkout_token)) AS checkout_tokens, list_sort(list(DISTINCT cart_token)) AS cart_tokens FROM good GROUP BY 1),
scoped AS (SELECT s.*, w.starts, w.expires FROM sess s JOIN win w USING (user_id) WHERE s.first_seen >= w.starts AND s.first_seen <= w.expires),
so AS (SELECT DISTINCT s.session_id, o.order_id, o.cents, o.ts FROM scoped s LEFT JOIN roll e USING (session_id) JOIN ord o ON o.user_id = s.user_id AND o.ts >= s.starts AND o.ts <= s.expires
  AND (o.session_id = s.session_id OR list_contains(e.checkout_tokens, o.checkout_token) OR list_contains(e.cart_tokens, o.cart_token))),
sor AS (SELECT session_id, count(*) AS session_orders, sum(cents) AS session_cents, min(ts) AS session_first_order_at FROM so GROUP BY 1),
jor AS (SELECT o.user_id, count(*) AS journey_orders, sum(o.cents) AS journey_cents FROM ord o JOIN win w ON o.user_id = w.user_id AND o.ts >= w.starts AND o.ts <= w.expires GROUP BY 1),
base AS (SELECT s.user_id, s.session_id, s.source, s.campaign, coalesce(e.first_event_at, s.first_seen) AS started_at, greatest(s.last_seen, e.last_event_at, s.first_seen) AS ended_at,
  CAST(coalesce(e.event_count, 0) AS BIGINT) AS event_count, coalesce(e.page_view_count, 0) AS page_view_count, coalesce(e.product_view_count, 0) AS product_view_count, coalesce(e.add_to_cart_count, 0) AS add_to_cart_count,
  coalesce(e.checkout_started_count, 0) AS checkout_started_count, coalesce(so.session_orders, 0) AS session_orders, CAST(coalesce(so.session_cents, 0) AS BIGINT) AS session_cents, coalesce(j.journey_orders, 0) AS journey_orders,
  CAST(coalesce(j.journey_cents, 0) AS BIGINT) AS journey_cents FROM scoped s LEFT JOIN roll e USING (session_id) LEFT JOIN sor so USING (session_id) LEFT JOIN jor j ON j.user_id = s.user_id),
num AS (SELECT *, row_number() OVER o AS session_number, count(*) OVER p AS journey_sessions, min(started_at) OVER p AS journey_started_at, max(ended_at) OVER p AS journey_ended_at, CAST(sum(event_count) OVER p AS BIGINT) AS journey_events,
  CAST(sum(event_count) OVER (PARTITION BY user_id ORDER BY started_at, session_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS event_end_number
  FROM base WINDOW p AS (PARTITION BY user_id), o AS (PARTITION BY user_id ORDER BY started_at, session_id))
"""
COUNTS = "event_count, page_view_count, product_view_count, add_to_cart_count, checkout_started_count"


def sessions_of(touches):
    """Sessions of the touches that are there, as the view makes them of all."""
    first = F.min_by(F.struct("event_id", *V.DIMENSIONS, "click_type", "click_value"), F.struct("ts", "event_id"))
    return touches.groupBy("session_id", "user_id").agg(first.alias("first"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")).select("session_id", "user_id", "first_seen", "last_seen", "first.*")


def facts(spark, sf_dir):
    return J.journey_facts(V.sessions(spark, sf_dir), _events(spark, sf_dir), V.orders(spark, sf_dir))


FACTS_SQL = over(f"""SELECT user_id, session_id, epoch_us(started_at) AS started_us, epoch_us(ended_at) AS ended_us, {COUNTS}, session_orders, session_cents, journey_orders, journey_cents,
  CAST(session_number AS BIGINT) AS session_number, journey_sessions, epoch_us(journey_started_at) AS journey_started_us, epoch_us(journey_ended_at) AS journey_ended_us, journey_events, event_end_number,
  CAST(journey_sessions - session_number + 1 AS BIGINT) AS reverse_number, CASE WHEN event_count > 0 THEN event_end_number - event_count + 1 ELSE 0 END AS event_start_number,
  session_number = 1 AS is_first, session_number = journey_sessions AS is_last, session_orders > 0 AS is_converting FROM num""", JOURNEY)


def shown(rows):
    return rows.select(
        "user_id", "session_id", _us("started_at").alias("started_us"), _us("ended_at").alias("ended_us"), *COUNTS.split(", "), "session_orders", "session_cents", "journey_orders", "journey_cents",
        F.col("session_number").cast("long").alias("session_number"), "journey_sessions", _us("journey_started_at").alias("journey_started_us"), _us("journey_ended_at").alias("journey_ended_us"),
        "journey_events", "event_end_number", F.col("reverse_number").cast("long").alias("reverse_number"), "event_start_number", "is_first", "is_last", "is_converting",
    )


@query("c14_customer_journey", FACTS_SQL)
def c14(spark, sf_dir):
    return shown(facts(spark, sf_dir))


@query("c14_refreshed_journeys", FACTS_SQL)
def c14_refreshed(spark, sf_dir):
    """The facts of all rows, reached by two change sets that come in any order of time; only their customers are put together anew."""
    last = lambda df, n, c="event_id": df.where((F.col(c) * 7 + F.col("user_id")) % 3 <= n)
    data = lambda n: (sessions_of(last(V.touches(spark, sf_dir), n)), last(_events(spark, sf_dir), n), last(V.orders(spark, sf_dir), n, "order_id"))
    first = U.facts_of(*data(0))
    table = U.facts_table(spark, first)
    table.replace(first, None, "first")
    for n in (1, 2):
        new = _events(spark, sf_dir).where((F.col("event_id") * 7 + F.col("user_id")) % 3 == n)
        U.refresh_facts(table, *data(n), new, f"batch {n}")
    return shown(table.read())


@query("a10_event_rollup", over("SELECT session_id, epoch_us(first_event_at) AS first_us, epoch_us(last_event_at) AS last_us, event_count, page_view_count, product_view_count, add_to_cart_count, checkout_started_count, array_to_string(checkout_tokens, ',') AS tokens FROM roll", JOURNEY))
def a10(spark, sf_dir):
    return J.event_rollup(_events(spark, sf_dir)).select("session_id", _us("first_event_at").alias("first_us"), _us("last_event_at").alias("last_us"), *COUNTS.split(", "), F.array_join("checkout_tokens", ",").alias("tokens"))


@query("j08_session_orders", over("SELECT session_id, order_id, cents FROM so", JOURNEY))
def j08(spark, sf_dir):
    events = _events(spark, sf_dir)
    scoped = V.sessions(spark, sf_dir).join(J.windows(events), "user_id").where(J.inside("first_seen"))
    return J.session_orders(scoped, J.event_rollup(events), V.orders(spark, sf_dir)).select("session_id", "order_id", "cents")


@query("w03_journey_totals", over("SELECT DISTINCT user_id, journey_sessions, journey_events, epoch_us(journey_started_at) AS started_us, epoch_us(journey_ended_at) AS ended_us, journey_orders, journey_cents FROM num", JOURNEY))
def w03(spark, sf_dir):
    return facts(spark, sf_dir).select("user_id", "journey_sessions", "journey_events", _us("journey_started_at").alias("started_us"), _us("journey_ended_at").alias("ended_us"), "journey_orders", "journey_cents").distinct()


@query("j09_affected_orders", over("SELECT DISTINCT o.order_id FROM ord o WHERE EXISTS (SELECT 1 FROM touch t WHERE t.event_type = 'signup' AND t.click_value IS NOT NULL AND (t.session_id = o.session_id OR t.checkout_token = o.checkout_token OR t.cart_token = o.cart_token OR t.user_id = o.user_id))"))
def j09(spark, sf_dir):
    return J.affected_orders(V.touches(spark, sf_dir).where("event_type = 'signup' and click_value is not null"), V.orders(spark, sf_dir))


@query("k09_relinked_sessions", over("SELECT s.session_id, epoch_us(max(o.ts)) AS evidence_us FROM sess s JOIN ord o ON o.user_id = s.user_id AND s.last_seen <= o.ts AND s.last_seen >= o.ts - INTERVAL 7 DAY GROUP BY 1"))
def k09(spark, sf_dir):
    return J.relinked_sessions(V.sessions(spark, sf_dir), V.orders(spark, sf_dir), 7).select("session_id", _us("evidence_at").alias("evidence_us"))


@query("k05_hourly_windows", over("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS hour_us, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM ev GROUP BY 1, 2"))
def k05(spark, sf_dir):
    rows = V.events(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return rows.select(F.unix_micros(F.col("w.start").cast("timestamp")).alias("hour_us"), "event_type", "n", "users")


@query("k10_rate_limited", over("SELECT sha256(CAST(user_id AS VARCHAR)) AS key, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS window_us, count(*) AS n FROM ev GROUP BY 1, 2 HAVING count(*) > 5"))
def k10(spark, sf_dir):
    rows = V.events(spark, sf_dir).groupBy(F.sha2(F.col("user_id").cast("string"), 256).alias("key"), F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return rows.where("n > 5").select("key", F.unix_micros(F.col("w.start").cast("timestamp")).alias("window_us"), "n")
