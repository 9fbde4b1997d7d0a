"""Queries on candidates, tiers, winners and credits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import attribution as A
from tidemark.operators import hints as H
from tidemark.operators import reporting as R
from tidemark.plans.base_sql import over, over_credits
from tidemark.plans.registry import query
from tidemark.sources import views as V
from tidemark.storage import stage


def _micros(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def dealt_orders(spark, sf_dir):
    """Orders, written once: each of their many uses would read a row group of events as one task again."""
    return stage(V.orders(spark, sf_dir, dealt=True), "orders")


def credited(spark, sf_dir, models=A.MODELS, sessions=None, orders=None, **options):
    sessions = stage(V.sessions(spark, sf_dir), "sessions") if sessions is None else sessions  # two kinds of evidence read them
    orders = dealt_orders(spark, sf_dir) if orders is None else orders
    return A.credits_of_lists(A.touch_lists(orders, sessions, V.touches(spark, sf_dir, dealt=True)), models, **options)


def _candidates(spark, sf_dir):
    return A.candidates(V.orders(spark, sf_dir), V.sessions(spark, sf_dir), V.touches(spark, sf_dir, dealt=True))


@query("v_touch", over("SELECT event_id, session_id, source, medium, campaign, click_type, click_value, checkout_token FROM touch"))
def v_touch(spark, sf_dir):
    return V.touches(spark, sf_dir).select("event_id", "session_id", "source", "medium", "campaign", "click_type", "click_value", "checkout_token")


@query("j04_first_event_of_session", over("SELECT session_id, user_id, event_id, source, campaign, touches, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us FROM sess"))
def j04(spark, sf_dir):
    return V.sessions(spark, sf_dir).select("session_id", "user_id", "event_id", "source", "campaign", "touches", _micros("first_seen").alias("first_us"), _micros("last_seen").alias("last_us"))


@query("j06_as_of_checkout_token", over_credits("SELECT order_id, session_id, event_id, source, click_value FROM tok"))
def j06(spark, sf_dir):
    return A.latest_by_token(V.orders(spark, sf_dir), V.touches(spark, sf_dir, dealt=True), "checkout_token").select("order_id", "session_id", "event_id", "source", "click_value")


@query("j06_as_of_cart_token", over_credits("SELECT order_id, session_id, event_id FROM cart"))
def j06_cart(spark, sf_dir):
    return A.latest_by_token(V.orders(spark, sf_dir), V.touches(spark, sf_dir, dealt=True), "cart_token").select("order_id", "session_id", "event_id")


@query("j07_sessions_in_window", over_credits("SELECT order_id, session_id, epoch_us(ts) AS ts_us FROM ident"))
def j07(spark, sf_dir):
    return A.identity_sessions(V.orders(spark, sf_dir), V.sessions(spark, sf_dir)).select("order_id", "session_id", _micros("ts").alias("ts_us"))


@query("j27_landing_session", over_credits("SELECT order_id, session_id FROM landing"))
def j27(spark, sf_dir):
    return A.landing_sessions(V.orders(spark, sf_dir), V.sessions(spark, sf_dir)).select("order_id", "session_id")


@query("c10_candidates", over_credits("SELECT order_id, session_id, evidence, is_direct, event_id FROM cand"))
def c10(spark, sf_dir):
    return _candidates(spark, sf_dir).select("order_id", "session_id", "evidence", "is_direct", "event_id")


@query("p14_direct_touches", over_credits("SELECT evidence, CAST(count(*) AS BIGINT) AS candidates, CAST(count(*) FILTER (is_direct) AS BIGINT) AS direct FROM cand GROUP BY 1"))
def p14(spark, sf_dir):
    return _candidates(spark, sf_dir).groupBy("evidence").agg(F.count("*").alias("candidates"), F.count_if("is_direct").alias("direct"))


@query("w08_dedupe_by_session", over_credits("SELECT order_id, session_id, evidence, event_id FROM dedup"))
def w08(spark, sf_dir):
    return A.dedupe_by_session(_candidates(spark, sf_dir)).select("order_id", "session_id", "evidence", "event_id")


@query("w09_winner", over_credits("SELECT order_id, session_id, evidence, is_direct, CASE evidence WHEN 'cart_token' THEN 0.9 WHEN 'customer_identity' THEN 0.6 ELSE 1.0 END::DOUBLE AS confidence, CASE evidence WHEN 'customer_identity' THEN 'medium' ELSE 'high' END AS label FROM line WHERE is_winner"))
def w09(spark, sf_dir):
    out = A.winners(A.dedupe_by_session(_candidates(spark, sf_dir))).withColumn("confidence", A.confidence(F.col("evidence")))
    return out.select("order_id", "session_id", "evidence", "is_direct", "confidence", A.confidence_label(F.col("confidence")).alias("label"))


@query("w10_timeline", over_credits("SELECT order_id, session_id, CAST(position AS INTEGER) AS position, CAST(n AS INTEGER) AS n FROM line"))
def w10(spark, sf_dir):
    return A.timeline(A.dedupe_by_session(_candidates(spark, sf_dir))).select("order_id", "session_id", "position", "n")


@query("c09_unattributed_touch", over_credits("SELECT order_id, cents, epoch_us(ts) AS ts_us FROM journey WHERE evidence = 'unattributed'"))
def c09(spark, sf_dir):
    rows = A.journeys(V.orders(spark, sf_dir), V.sessions(spark, sf_dir), V.touches(spark, sf_dir, dealt=True))
    return rows.where("evidence = 'unattributed'").select("order_id", "cents", _micros("ts").alias("ts_us"))


def _model(number, model):
    @query(f"{number}_{model}", over_credits(f"SELECT order_id, CAST(position AS INTEGER) AS position, session_id, CAST(floor(weight * 100000000 + 0.5) AS BIGINT) AS weight_e8, credit_cents, is_primary FROM cred WHERE model = '{model}'"))
    def run(spark, sf_dir):
        return credited(spark, sf_dir, [model]).select("order_id", "position", "session_id", R.weight_e8(F.col("weight")).alias("weight_e8"), "credit_cents", "is_primary")


for _number, _name in (("c01", "first_touch"), ("c02", "last_touch"), ("c03", "linear"), ("c04", "time_decay"), ("c05", "position_based"), ("c06", "rule_based_weighted")):
    _model(_number, _name)


@query("c08_exact_cents", over_credits("SELECT order_id, model, CAST(sum(credit_cents) AS BIGINT) AS credited, any_value(cents) AS cents, CAST(count(*) FILTER (is_primary) AS BIGINT) AS primaries FROM cred GROUP BY 1, 2"))
def c08(spark, sf_dir):
    return credited(spark, sf_dir).groupBy("order_id", "model").agg(F.sum("credit_cents").alias("credited"), F.max("cents").alias("cents"), F.count_if("is_primary").alias("primaries"))


TRACKED = "touch AS (SELECT * FROM ev WHERE event_type IN ('view', 'click', 'signup') AND user_id % 3 > 0)"
HINTED = "CASE order_id % 7 WHEN 1 THEN 'g1' WHEN 4 THEN 'T1' END"
TIERS_SQL = f""",
alltouch AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS rn, min(ts) OVER (PARTITION BY session_id) AS first_seen FROM ev WHERE event_type IN ('view', 'click', 'signup') AND user_id % 4 = 0),
hint AS (SELECT order_id, 'hint:' || CAST(order_id AS VARCHAR) AS session_id, ts, {HINTED} AS click_value, 'shopify_marketing_hint' AS evidence FROM ord WHERE order_id % 7 < 5),
ga AS (SELECT o.order_id, s.session_id, s.first_seen AS ts, s.source, s.click_value, 'ga4_fallback' AS evidence FROM ord o JOIN alltouch s ON s.rn = 1 AND o.user_id = s.user_id AND s.first_seen <= o.ts AND s.first_seen >= o.ts - INTERVAL 7 DAY),
ranked AS (
  SELECT order_id, 0 AS tier, evidence, session_id, is_direct, row_number() OVER (PARTITION BY order_id ORDER BY is_direct, ts DESC, prec, has_click DESC, session_id) AS rn FROM dedup
  UNION ALL SELECT order_id, 1, evidence, session_id, FALSE, row_number() OVER (PARTITION BY order_id ORDER BY click_value IS NOT NULL DESC, ts DESC, session_id) FROM hint
  UNION ALL SELECT order_id, 2, evidence, session_id, source IS NULL AND click_value IS NULL, row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, click_value IS NOT NULL DESC, session_id) FROM ga),
best AS (SELECT order_id, min_by(evidence, tier) AS evidence, min_by(session_id, tier) AS session_id, min_by(is_direct, tier) AS is_direct, min(tier) AS tier FROM ranked WHERE rn = 1 GROUP BY 1),
tiered AS (SELECT o.order_id, o.source_name, CASE coalesce(b.tier, 3) WHEN 0 THEN 'deterministic_first_party' WHEN 1 THEN 'deterministic_shopify_hint' WHEN 2 THEN 'ga4_fallback' ELSE 'unattributed' END AS tier, b.evidence, b.session_id, b.is_direct,
  CASE b.evidence WHEN 'landing_session_id' THEN 1.0 WHEN 'checkout_token' THEN 1.0 WHEN 'cart_token' THEN 0.9 WHEN 'customer_identity' THEN 0.6 WHEN 'shopify_marketing_hint' THEN 0.55 WHEN 'ga4_fallback' THEN 0.35 ELSE 0.0 END::DOUBLE AS confidence
  FROM ord o LEFT JOIN best b USING (order_id))
"""


def over_tiers(select: str) -> str:
    """A query over tiered orders, where browsers of every third user aren't tracked."""
    whole = over_credits("").rstrip() + TIERS_SQL.rstrip() + "\n" + select
    return whole.replace("touch AS (SELECT * FROM ev WHERE event_type IN ('view', 'click', 'signup'))", TRACKED, 1)


def tracked(spark, sf_dir):
    """Sessions and touches of tracked browsers."""
    return V.sessions(spark, sf_dir).where("user_id % 3 > 0"), V.touches(spark, sf_dir, dealt=True).where("user_id % 3 > 0")


def with_attributes(spark, sf_dir):
    """Orders with the attributes and landing site that a shop's checkout adds."""
    entry = lambda name, value: F.array(F.struct(F.lit(name).alias("name"), F.lit(value).alias("value")))
    r = F.col("order_id") % 7
    both = F.concat(entry("utm_source", "Facebook"), entry("utm_medium", "Paid Social"))
    notes = F.when(r == 0, both).when(r == 1, entry("app_gclid", " g1 ")).when(r == 2, entry("landing_url", "/x?utm_source=bing&utm_campaign=Big+Sale#top")).when(r == 5, entry("utm_source", " "))
    legacy = F.when(r == 3, entry("utm_source", "newsletter"))
    explicit = F.when(F.col("order_id") % 5 == 0, F.col("session_id")).when(F.col("order_id") % 5 == 1, "nobody:2024-01-01")
    site = F.when(r == 4, "https://shop.example/?utm_source=tiktok&ttclid=T1")
    return V.orders(spark, sf_dir).withColumns({"note_attributes": notes, "attributes": legacy, "landing_site": site, "explicit_session": explicit})


def tiers(spark, sf_dir):
    orders = with_attributes(spark, sf_dir)
    sessions, touches = tracked(spark, sf_dir)
    hints = H.hints(orders).join(orders.select("order_id", "ts"), "order_id").withColumns({"evidence": F.lit("shopify_marketing_hint"), "is_direct": F.lit(False), "session_id": F.concat(F.lit("hint:"), F.col("order_id").cast("string")), "event_id": F.col("order_id")})
    warehouse = V.sessions(spark, sf_dir).where("user_id % 4 = 0")
    ga4 = A.identity_sessions(orders, warehouse).withColumn("evidence", F.lit("ga4_fallback")).withColumn("is_direct", A.is_direct())
    found = A.dedupe_by_session(A.candidates(orders, sessions, touches))
    return A.resolve_tiers(orders, found, hints, ga4)


@query("c11_tier_resolution", over_tiers("SELECT order_id, tier, evidence, session_id, is_direct, confidence FROM tiered"))
def c11(spark, sf_dir):
    return tiers(spark, sf_dir).select("order_id", "tier", "evidence", "session_id", "is_direct", "confidence")


@query("w11_deduped_candidates", over_tiers("SELECT order_id, session_id, evidence FROM (SELECT *, row_number() OVER (PARTITION BY order_id, session_id ORDER BY ts DESC, click_value IS NOT NULL DESC, evidence) AS rn FROM (SELECT order_id, session_id, ts, click_value, 'ga4_fallback' AS evidence FROM ga UNION ALL SELECT order_id, session_id, ts - INTERVAL 1 HOUR, click_value, 'older' FROM ga)) WHERE rn = 1"))
def w11(spark, sf_dir):
    orders = V.orders(spark, sf_dir)
    ga4 = A.identity_sessions(orders, V.sessions(spark, sf_dir).where("user_id % 4 = 0")).withColumn("evidence", F.lit("ga4_fallback")).withColumn("is_direct", A.is_direct())
    older = ga4.withColumns({"ts": F.col("ts") - F.expr("interval 1 hour"), "evidence": F.lit("older")})
    return A.dedupe_by_source(ga4.unionByName(older), 2).select("order_id", "session_id", "evidence")
