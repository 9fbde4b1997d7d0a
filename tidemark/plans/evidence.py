"""Queries on hints, stored results, backfill and explanations (C12, C25-C27, F10, F15, F16, F28, F41, F43, F51, F56, J05, J16, J22, J27, K01, K04, K12, P08, P09, P12, P25, S17, A30, T05, T06, T08, T12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dims as D
from tidemark.functions import text as T
from tidemark.operators import attribution as A
from tidemark.operators import backfill as B
from tidemark.operators import hints as H
from tidemark.operators import reporting as R
from tidemark.plans.attribution import credited, over_tiers, tiers, tracked, with_attributes
from tidemark.plans.base_sql import over, over_credits, over_cube
from tidemark.plans.payloads import expr
from tidemark.plans.registry import query
from tidemark.plans.reporting import cube
from tidemark.sources import views as V
from tidemark.streaming import ingest as N

HINTS = """hints AS (SELECT order_id, CASE order_id % 7 WHEN 0 THEN 'meta' WHEN 1 THEN 'google' WHEN 2 THEN 'microsoft' WHEN 3 THEN 'email' ELSE 'tiktok' END AS source, CASE order_id % 7 WHEN 0 THEN 'paid_social' WHEN 1 THEN 'cpc' WHEN 4 THEN 'paid_social' END AS medium,
  CASE order_id % 7 WHEN 2 THEN 'big sale' END AS campaign, CASE order_id % 7 WHEN 1 THEN 'gclid' WHEN 4 THEN 'ttclid' END AS click_type, CASE order_id % 7 WHEN 1 THEN 'g1' WHEN 4 THEN 'T1' END AS click_value, CASE WHEN order_id % 7 IN (1, 4) THEN 0.55 ELSE 0.4 END::DOUBLE AS confidence FROM ord WHERE order_id % 7 < 5)"""
LANDING = """lbt AS (SELECT checkout_token, arg_max(session_id, (ts, event_id)) AS s FROM touch GROUP BY 1), lbc AS (SELECT cart_token, arg_max(session_id, (ts, event_id)) AS s FROM touch GROUP BY 1),
land AS (SELECT o.order_id, coalesce(e.session_id, t.s, c.s) AS session_id, CASE WHEN e.session_id IS NOT NULL THEN 'explicit' WHEN t.s IS NOT NULL THEN 'checkout_token' WHEN c.s IS NOT NULL THEN 'cart_token' END AS found_by
  FROM ord o LEFT JOIN sess e ON e.session_id = o.session_id AND o.order_id % 5 = 0 LEFT JOIN lbt t USING (checkout_token) LEFT JOIN lbc c USING (cart_token))"""
FEW = "touch AS (SELECT * FROM ev WHERE event_type IN ('view', 'click', 'signup') AND event_id % 11 = 0)"


def over_few(select: str, *ctes: str) -> str:
    """A query over views in which every eleventh touch was recorded."""
    return over(select, *ctes).replace("touch AS (SELECT * FROM ev WHERE event_type IN ('view', 'click', 'signup'))", FEW, 1)


def few_touches(spark, sf_dir):
    touches = V.touches(spark, sf_dir).where("event_id % 11 = 0")
    return touches, touches.select("session_id").distinct()


@query("f15_attribute_values", over("SELECT order_id, CASE order_id % 7 WHEN 0 THEN 'Facebook' WHEN 3 THEN 'newsletter' END AS utm_source, CASE order_id % 7 WHEN 1 THEN 'g1' END AS gclid FROM ord"))
def f15(spark, sf_dir):
    lists = [F.col("note_attributes"), F.col("attributes")]
    return with_attributes(spark, sf_dir).select("order_id", H.first_attribute(lists, ["utm_source", "app_utm_source"]).alias("utm_source"), H.first_attribute(lists, ["gclid", "app_gclid"]).alias("gclid"))


@query("f16_order_hints", over("SELECT order_id, source, medium, campaign, click_type, click_value, confidence FROM hints", HINTS))
def f16(spark, sf_dir):
    return H.hints(with_attributes(spark, sf_dir)).select("order_id", "source", "medium", "campaign", "click_type", "click_value", "confidence")


@query("f56_attribute_maps", over("SELECT order_id, CASE order_id % 4 WHEN 0 THEN 'a=2;b=x' WHEN 1 THEN 'k=v' WHEN 2 THEN 'a=1;z=true' ELSE '' END AS attributes FROM ord"))
def f56(spark, sf_dir):
    body = expr("""CASE order_id % 4 WHEN 0 THEN '{"note_attributes": [{"name": "a", "value": 1}, {"key": "b", "value": " x "}], "attributes": [{"name": "a", "value": "2"}]}' WHEN 1 THEN '{"attributes": {"k": "v", "blank": " ", "none": null}}' WHEN 2 THEN '{"note_attributes": {"a": 1}, "attributes": [{"name": "z", "value": true}, {"name": "", "value": "q"}]}' ELSE '{"note_attributes": "text"}' END""")
    entries = F.array_sort(F.map_entries(H.attribute_map(F.col("body"))))
    return V.orders(spark, sf_dir).withColumn("body", body).select("order_id", F.array_join(F.transform(entries, lambda x: F.concat_ws("=", x["key"], x["value"])), ";").alias("attributes"))


@query("f10_click_id_fields", over("SELECT event_id, CASE k % 4 WHEN 0 THEN 'fbclid' WHEN 1 THEN 'gclid' WHEN 2 THEN 'ttclid' END AS click_type, CASE k % 4 WHEN 0 THEN 'f' WHEN 1 THEN 'g' WHEN 2 THEN 't' WHEN 3 THEN 'only' END AS click_value FROM ev"))
def f10(spark, sf_dir):
    r = F.col("k") % 4
    kind = F.when(r == 0, "FBCLID").when(r == 3, "other")
    value = F.when(r == 0, "f").when(r == 3, "only")
    click = D.click_id(kind, value, {"gclid": F.when(r < 2, "g"), "ttclid": F.when(r != 3, " t "), "msclkid": F.lit(" ")})
    return V.events(spark, sf_dir).select("event_id", click.alias("c")).select("event_id", F.col("c.type").alias("click_type"), F.col("c.value").alias("click_value"))


@query("f28_cents_text", over("SELECT order_id, CASE WHEN order_id % 2 = 0 THEN '-' ELSE '' END || CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS amount FROM ord WHERE cents > 0"))
def f28(spark, sf_dir):
    return V.orders(spark, sf_dir).where("cents > 0").select("order_id", T.cents_text(F.when(F.col("order_id") % 2 == 0, -F.col("cents")).otherwise(F.col("cents"))).alias("amount"))


@query("j27_resolved_landing", over_few("SELECT order_id, session_id, found_by FROM land", LANDING))
def j27_resolved(spark, sf_dir):
    touches, sessions = few_touches(spark, sf_dir)
    return H.landing_session(with_attributes(spark, sf_dir), sessions, touches)


RECOVERY = """, lt AS (SELECT order_id, bool_or(source IS NOT NULL OR medium IS NOT NULL OR campaign IS NOT NULL) AS named FROM cred WHERE model = 'last_touch' GROUP BY 1),
scope AS (SELECT o.* FROM ord o LEFT JOIN lt USING (order_id) WHERE o.source_name = 'web' AND NOT coalesce(named, FALSE)), """
FEW_LAND = LANDING.replace("FROM touch", "FROM (SELECT * FROM touch WHERE event_id % 11 = 0)").replace("JOIN sess e", "JOIN (SELECT DISTINCT session_id FROM touch WHERE event_id % 11 = 0) e")


def _recovery(spark, sf_dir):
    orders = with_attributes(spark, sf_dir)
    touches, sessions = few_touches(spark, sf_dir)
    scope = H.needs_recovery(orders, credited(spark, sf_dir, ["last_touch"]))
    return scope, H.landing_session(scope, sessions, touches), H.hints(scope)


@query("c26_hint_recovery", over_credits("").rstrip() + RECOVERY + FEW_LAND + ", " + HINTS + " SELECT count(*) AS rescanned, count(*) FILTER (l.session_id IS NOT NULL AND l.session_id <> s.session_id) AS relinked, count(*) FILTER (NOT (l.session_id IS NULL AND h.order_id IS NOT NULL)) AS requeued, count(*) FILTER (l.session_id IS NULL AND h.order_id IS NOT NULL) AS hinted FROM scope s LEFT JOIN land l USING (order_id) LEFT JOIN hints h USING (order_id)")
def c26(spark, sf_dir):
    return H.recovery_report(H.recovered(*_recovery(spark, sf_dir)))


@query("j22_orders_to_recover", over_credits("").rstrip() + RECOVERY.rstrip().rstrip(",") + " SELECT order_id FROM scope")
def j22(spark, sf_dir):
    return H.needs_recovery(V.orders(spark, sf_dir), credited(spark, sf_dir, ["last_touch"])).select("order_id")


LABEL = "CASE tier WHEN 'deterministic_first_party' THEN 'Deterministic first-party' WHEN 'deterministic_shopify_hint' THEN 'Deterministic Shopify hint' WHEN 'ga4_fallback' THEN 'GA4 fallback' ELSE 'Unattributed' END"


@query("f41_tier_labels", over(f"SELECT reason, {LABEL} AS label, tier, CASE reason WHEN 'shopify_hint_derived' THEN 'shopify_marketing_hint' WHEN 'matched_by_landing_session' THEN 'landing_session_id' WHEN 'matched_by_customer_identity' THEN 'stitched_identity_journey' WHEN 'unattributed' THEN 'unattributed' ELSE 'ga4_fallback' END AS source, count(*) AS orders FROM (SELECT order_id, reason, CASE reason WHEN 'shopify_hint_derived' THEN 'deterministic_shopify_hint' WHEN 'unattributed' THEN 'unattributed' WHEN 'other' THEN 'ga4_fallback' ELSE 'deterministic_first_party' END AS tier FROM (SELECT order_id, CASE order_id % 5 WHEN 0 THEN 'shopify_hint_derived' WHEN 1 THEN 'matched_by_landing_session' WHEN 2 THEN 'matched_by_customer_identity' WHEN 3 THEN 'unattributed' ELSE 'other' END AS reason FROM ord)) GROUP BY ALL"))
def f41(spark, sf_dir):
    reason = F.get(F.array(*[F.lit(r) for r in ("shopify_hint_derived", "matched_by_landing_session", "matched_by_customer_identity", "unattributed", "other")]), (F.col("order_id") % 5).cast("int"))
    rows = V.orders(spark, sf_dir).select("order_id", reason.alias("reason")).withColumn("t", H.reason_tier(F.col("reason")))
    return rows.groupBy("reason", H.tier_label(F.col("t.tier")).alias("label"), F.col("t.tier").alias("tier"), F.col("t.source").alias("source")).agg(F.count("*").alias("orders"))


@query("f43_audit_records", over_tiers("SELECT order_id, tier, CASE evidence WHEN 'customer_identity' THEN 'stitched_identity_journey' ELSE coalesce(evidence, 'unattributed') END AS source, coalesce(evidence, 'none') AS reason FROM tiered"))
def f43(spark, sf_dir):
    rows = tiers(spark, sf_dir)
    record = H.audit(F.col("tier"), F.col("evidence"), F.col("ts"), F.coalesce("evidence", F.lit("none")))
    return rows.select("order_id", record.alias("r")).select("order_id", "r.tier", "r.source", "r.reason")


@query("f51_resolver_outcomes", over_tiers("SELECT CAST(CASE tier WHEN 'deterministic_first_party' THEN 0 WHEN 'deterministic_shopify_hint' THEN 1 WHEN 'ga4_fallback' THEN 2 ELSE 3 END AS INTEGER) AS depth, CASE tier WHEN 'deterministic_first_party' THEN 'resolved_in_first_party' WHEN 'deterministic_shopify_hint' THEN 'fell_through_to_shopify_hint' WHEN 'ga4_fallback' THEN 'fell_through_to_ga4_fallback' ELSE 'fell_through_to_unattributed' END AS stage, CASE WHEN evidence IS NULL THEN 'unattributed' WHEN is_direct THEN 'direct_winner' ELSE 'non_direct_winner' END AS outcome, count(*) AS orders FROM tiered GROUP BY ALL"))
def f51(spark, sf_dir):
    rows = tiers(spark, sf_dir).select(H.outcome(F.col("tier"), F.col("evidence").isNotNull(), F.coalesce("is_direct", F.lit(False))).alias("o"))
    return rows.groupBy("o.depth", "o.stage", "o.outcome").agg(F.count("*").alias("orders"))


@query("p08_tier_filter", over_tiers("SELECT c.order_id, c.source, c.campaign FROM cred c JOIN tiered t USING (order_id) WHERE c.model = 'linear' AND c.source = 'google' AND t.tier = 'deterministic_first_party'"))
def p08(spark, sf_dir):
    sessions, touches = tracked(spark, sf_dir)
    rows = A.credits_of_lists(A.touch_lists(V.orders(spark, sf_dir), sessions, touches), ["linear"]).join(tiers(spark, sf_dir).select("order_id", "tier"), "order_id")
    return H.filtered(rows, "linear", source="google", tier="deterministic_first_party").select("order_id", "source", "campaign")


@query("c12_stored_results", over_tiers("""SELECT t.order_id, w.session_id, w.source, n.touches, '{"tier":"' || tier || '","confidenceScore":' || CASE WHEN confidence = 0 THEN '0.0' WHEN confidence = 1 THEN '1.0' ELSE CAST(confidence AS VARCHAR) END || ',"winner":{"sessionId":' || coalesce('"' || w.session_id || '"', 'null') || ',"source":' || coalesce('"' || w.source || '"', 'null') || ',"medium":' || coalesce('"' || w.medium || '"', 'null') || ',"campaign":' || coalesce('"' || w.campaign || '"', 'null') || ',"clickIdValue":' || coalesce('"' || w.click_value || '"', 'null') || '},"touchpointCount":' || CAST(n.touches AS VARCHAR) || '}' AS snapshot
  FROM tiered t JOIN (SELECT * FROM journey WHERE is_winner) w USING (order_id) JOIN (SELECT order_id, count(*) FILTER (evidence <> 'unattributed') AS touches FROM journey GROUP BY 1) n USING (order_id)"""))
def c12(spark, sf_dir):
    sessions, touches = tracked(spark, sf_dir)
    rows = B.result_rows(A.journeys(V.orders(spark, sf_dir), sessions, touches), tiers(spark, sf_dir))
    return rows.select("order_id", "session_id", "source", "touches", "snapshot")


@query("c12_stored_credits", over_tiers("SELECT model, count(*) AS rows, count(DISTINCT order_id) AS orders, CAST(sum(credit_cents) AS BIGINT) AS cents, count(*) FILTER (is_primary) AS primaries FROM cred GROUP BY 1"))
def c12_credits(spark, sf_dir):
    sessions, touches = tracked(spark, sf_dir)
    rows = B.credit_rows(A.credits_of_lists(A.touch_lists(V.orders(spark, sf_dir), sessions, touches)))
    return rows.groupBy("model").agg(F.count("*").alias("rows"), F.countDistinct("order_id").alias("orders"), F.sum("credit_cents").alias("cents"), F.count_if("is_primary").alias("primaries"))


BACKFILL = "old AS (SELECT * FROM cart WHERE order_id % 3 > 0), new AS (SELECT * EXCLUDE (rn) FROM tok WHERE order_id NOT IN (SELECT order_id FROM old)), scp AS (SELECT * FROM ord WHERE source_name = 'web' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25')"
LACKS = "(r.order_id IS NULL OR (r.session_id IS NULL AND r.source IS NULL AND r.medium IS NULL AND r.campaign IS NULL AND r.click_value IS NULL))"


def _backfill(spark, sf_dir):
    orders, touches = V.orders(spark, sf_dir), V.touches(spark, sf_dir, dealt=True)
    at = lambda d: F.lit(f"{d} 00:00:00").cast("timestamp_ntz")
    old = A.latest_by_token(orders, touches, "cart_token").where("order_id % 3 > 0")
    return B.backfill_scope(orders, at("2024-01-05"), at("2024-01-25")), old, A.latest_by_token(orders, touches, "checkout_token")


@query("c25_backfill_report", over_credits("").rstrip() + ", " + BACKFILL + f", b AS (SELECT count(*) AS total, count(*) FILTER {LACKS.replace('(r.', '(WHERE r.', 1)} AS m FROM scp o LEFT JOIN old r USING (order_id)), a AS (SELECT count(*) FILTER {LACKS.replace('(r.', '(WHERE r.', 1)} AS m FROM scp o LEFT JOIN (SELECT order_id, session_id, source, medium, campaign, click_value FROM old UNION ALL SELECT order_id, session_id, source, medium, campaign, click_value FROM new) r USING (order_id)) SELECT b.total, b.m AS missing_before, a.m AS missing_after, b.m - a.m AS recovered, (b.total - b.m) / CAST(b.total AS DOUBLE) AS rate_before, (b.total - a.m) / CAST(b.total AS DOUBLE) AS rate_after FROM b CROSS JOIN a")
def c25(spark, sf_dir):
    scope, old, new = _backfill(spark, sf_dir)
    return B.report(scope, old, B.backfilled(old, new))


@query("c25_next_batch", over_credits("").rstrip() + ", " + BACKFILL + " SELECT order_id FROM scp WHERE order_id NOT IN (SELECT order_id FROM old) AND (ts, order_id) > (TIMESTAMP '2024-01-10', 0) ORDER BY ts, order_id LIMIT 40")
def c25_batch(spark, sf_dir):
    scope, old, _ = _backfill(spark, sf_dir)
    return B.next_batch(scope, old, 40, ("2024-01-10 00:00:00", 0)).select("order_id")


@query("j05_last_touch_of_session", over("SELECT session_id, event_id, source, campaign FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS r FROM touch) WHERE r = 1"))
def j05(spark, sf_dir):
    return H.last_touch(V.touches(spark, sf_dir), ["event_id", "source", "campaign"])


WRITEBACK = """, wb AS (SELECT o.order_id, coalesce(r.session_id, CASE WHEN o.order_id % 6 > 0 THEN o.session_id END) AS session FROM ord o LEFT JOIN cart r USING (order_id)),
lt2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS r FROM touch) WHERE r = 1),
want AS (SELECT w.order_id, w.session, t.source, t.medium, t.campaign, t.click_value FROM wb w LEFT JOIN lt2 t ON t.session_id = w.session)"""


def _wanted(spark, sf_dir):
    orders, touches = V.orders(spark, sf_dir), V.touches(spark, sf_dir, dealt=True)
    results = A.latest_by_token(orders, touches, "cart_token").select("order_id", "session_id")
    known = orders.withColumn("session_id", F.when(F.col("order_id") % 6 > 0, F.col("session_id")))
    return H.writeback_attributes(known, results, touches)


@query("j16_writeback_attributes", over_credits("").rstrip() + WRITEBACK + " SELECT order_id, CASE WHEN session IS NOT NULL THEN 'schema_version=1;session_id=' || session || coalesce(';utm_source=' || source, '') || coalesce(';utm_medium=' || medium, '') || coalesce(';utm_campaign=' || campaign, '') || coalesce(';click_id=' || click_value, '') END AS expected FROM want")
def j16(spark, sf_dir):
    entries = F.transform(F.map_entries("expected"), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return _wanted(spark, sf_dir).select("order_id", F.array_join(entries, ";").alias("expected"))


@query("c27_writeback_reconciliation", over_credits("").rstrip() + WRITEBACK + " SELECT order_id, CASE WHEN session IS NULL THEN 'no_session' WHEN order_id % 3 = 0 THEN 'up_to_date' ELSE 'needs_writeback' END AS status, CAST(CASE WHEN session IS NULL THEN 0 WHEN order_id % 3 = 1 THEN 2 + (source IS NOT NULL)::INT + (medium IS NOT NULL)::INT + (campaign IS NOT NULL)::INT + (click_value IS NOT NULL)::INT ELSE 0 END AS INTEGER) AS missing, CAST(CASE WHEN session IS NOT NULL AND order_id % 3 = 2 THEN 1 ELSE 0 END AS INTEGER) AS different FROM want")
def c27(spark, sf_dir):
    want = _wanted(spark, sf_dir)
    stale = F.map_concat(F.map_filter("expected", lambda k, _: k != "schema_version"), F.create_map(F.lit("schema_version"), F.lit("0"), F.lit("gift"), F.lit("yes")))
    current = want.where("order_id % 3 <> 1").select("order_id", F.when(F.col("order_id") % 3 == 0, F.col("expected")).otherwise(stale).alias("current"))
    return H.reconciled(want, current)


@query("p12_contains_escaped", "SELECT p_partkey FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Sale 50% off' WHEN 1 THEN 'Sale 500 off' WHEN 2 THEN 'a_b' ELSE p_name END AS name, CASE WHEN p_partkey % 7 = 0 THEN 'large BRASS' ELSE p_type END AS kind FROM part) WHERE contains(lower(kind), 'brass') OR contains(lower(name), '50%')")
def p12(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 5 == 0, "Sale 50% off").when(F.col("p_partkey") % 5 == 1, "Sale 500 off").when(F.col("p_partkey") % 5 == 2, "a_b").otherwise(F.col("p_name"))
    kind = F.when(F.col("p_partkey") % 7 == 0, "large BRASS").otherwise(F.col("p_type"))
    return V.table(spark, sf_dir, "part").where(T.escaped_contains(kind, "BRASS") | T.escaped_contains(name, "50%")).select("p_partkey")


@query("p09_null_parameters", "SELECT p.want, o.o_orderkey FROM orders o CROSS JOIN (SELECT unnest(['F', NULL]) AS want) p WHERE o.o_orderkey % 50 = 0 AND (p.want IS NULL OR o.o_orderstatus = p.want)")
def p09(spark, sf_dir):
    rows = V.table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select("o_orderkey", "o_orderstatus")
    asked = rows.withColumn("want", F.explode(F.array(F.lit("F"), F.lit(None).cast("string"))))
    return asked.where(R.matches_or_null(F.col("o_orderstatus"), F.col("want"))).select("want", "o_orderkey")


@query("p25_conversion_rows", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1, 2")
def p25(spark, sf_dir):
    rows = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", "conversion").otherwise("impression").alias("action_report_time"), (F.col("l_linestatus") == "F").alias("use_account_attribution_setting"))
    return R.conversion_mode(rows).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("a30_fill_rates", over("SELECT count(*) AS rows, count(source) AS source_present, count(campaign) AS campaign_present, count(click_value) AS click_value_present, count(source) / CAST(count(*) AS DOUBLE) AS source_rate, count(campaign) / CAST(count(*) AS DOUBLE) AS campaign_rate, count(click_value) / CAST(count(*) AS DOUBLE) AS click_value_rate FROM touch"))
def a30(spark, sf_dir):
    return B.fill_rates(V.touches(spark, sf_dir), ["source", "campaign", "click_value"])


@query("k04_watermarks", over("SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(greatest(CASE WHEN user_id % 4 > 0 THEN TIMESTAMP '2024-01-29 12:00:00' END, CASE WHEN user_id % 5 > 0 THEN max(time_bucket(INTERVAL 1 HOUR, ts)) END)) AS watermark_us FROM ev WHERE user_id % 4 > 0 OR user_id % 5 > 0 GROUP BY user_id"))
def k04(spark, sf_dir):
    ev = V.events(spark, sf_dir)
    done = ev.where("user_id % 5 > 0").select(F.col("user_id").cast("string").alias("key"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    marks = ev.where("user_id % 4 > 0").select(F.col("user_id").cast("string").alias("key"), F.lit("2024-01-29 12:00:00").cast("timestamp_ntz").alias("watermark")).distinct()
    return B.advanced(marks, done).select("key", F.unix_micros(F.col("watermark").cast("timestamp")).alias("watermark_us"))


@query("s17_replaced_partitions", over("SELECT CAST(report_date AS VARCHAR) AS report_date, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS rows FROM (SELECT report_date, cents FROM spend WHERE NOT (report_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12') UNION ALL SELECT report_date, cents + 1 FROM spend WHERE report_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' AND platform = 'google') GROUP BY 1"))
def s17(spark, sf_dir):
    old = V.spend(spark, sf_dir).select("report_date", "platform", "cents")
    new = B.in_window(old.where("platform = 'google'").withColumn("cents", F.col("cents") + 1), "report_date", F.lit("2024-01-10").cast("date"), F.lit("2024-01-12").cast("date"))
    return B.replaced(old, new, ["report_date"]).groupBy(F.col("report_date").cast("string").alias("report_date")).agg(F.sum("cents").alias("cents"), F.count("*").alias("rows"))


@query("k12_rolling_window", over("SELECT CAST(report_date AS VARCHAR) AS report_date, CAST(sum(cents) AS BIGINT) AS cents FROM (SELECT report_date, CASE WHEN report_date > DATE '2024-01-23' THEN cents * 2 ELSE cents END AS cents FROM spend) GROUP BY 1"))
def k12(spark, sf_dir):
    old = V.spend(spark, sf_dir).select("report_date", "cents")
    last = F.lit("2024-01-30").cast("date")
    pulled = B.in_window(old.withColumn("cents", F.col("cents") * 2), "report_date", F.date_sub(last, 6), last)
    return B.replaced(old, pulled, ["report_date"]).groupBy(F.col("report_date").cast("string").alias("report_date")).agg(F.sum("cents").alias("cents"))


@query("t05_status_order", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderkey LIMIT 9000")
def t05(spark, sf_dir):
    rows = V.table(spark, sf_dir, "orders")
    return rows.orderBy(R.by_status(F.col("o_orderstatus"), ["F", "P"]), "o_orderkey").limit(9000).select("o_orderkey", "o_orderstatus")


@query("t06_sample_of_first_rows", over("SELECT source, count(*) AS rows, min(event_id) AS first FROM (SELECT * FROM touch ORDER BY ts, event_id LIMIT 100) GROUP BY 1"))
def t06(spark, sf_dir):
    return V.touches(spark, sf_dir).orderBy("ts", "event_id").limit(100).groupBy("source").agg(F.count("*").alias("rows"), F.min("event_id").alias("first"))


@query("t08_swept_batches", over("SELECT n AS expired, least(n, 900) AS deleted, CAST(ceil(least(n, 900) / 300.0) AS BIGINT) AS batches, n - least(n, 900) AS remaining FROM (SELECT count(*) AS n FROM touch WHERE ts < TIMESTAMP '2024-01-15')"))
def t08(spark, sf_dir):
    return B.swept_batches(V.touches(spark, sf_dir), "ts", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), 300, 3)


@query("t12_top_slices", over_cube("SELECT 'campaign' AS slice, campaign AS name, CAST(sum(revenue_cents) AS BIGINT) AS cents FROM cube WHERE model = 'linear' GROUP BY 2 QUALIFY row_number() OVER (ORDER BY sum(revenue_cents) DESC, campaign) <= 5 UNION ALL SELECT 'source', source, CAST(sum(revenue_cents) AS BIGINT) FROM cube WHERE model = 'linear' GROUP BY 2 QUALIFY row_number() OVER (ORDER BY sum(revenue_cents) DESC, source) <= 3"))
def t12(spark, sf_dir):
    rows = R.filtered(cube(spark, sf_dir, ["linear"]), model="linear")
    return R.top_slices(rows, {"campaign": 5, "source": 3})


@query("k01_ingested_batch", over("""SELECT outcome, count(*) AS events, count(DISTINCT session_id) AS sessions, CAST(count(DISTINCT CASE WHEN outcome = 'accepted' THEN CAST(ts AS DATE) END) AS BIGINT) AS dates FROM (
  SELECT *, CASE WHEN NOT fits THEN CASE WHEN ts < TIMESTAMP '2024-01-19' THEN 'too_old' ELSE 'in_future' END WHEN event_id % 6 = 0 OR row_number() OVER (PARTITION BY event_id, fits ORDER BY copy) > 1 THEN 'duplicate' ELSE 'accepted' END AS outcome FROM (
  SELECT *, ts BETWEEN TIMESTAMP '2024-01-19' AND TIMESTAMP '2024-01-20 00:05:00' AS fits FROM (SELECT * REPLACE (ts + INTERVAL 12 HOUR * copy AS ts) FROM ev CROSS JOIN (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR event_id % 5 = 0))) GROUP BY 1"""))
def k01(spark, sf_dir):
    ev = V.events(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).where("copy = 0 or event_id % 5 = 0")
    ev = ev.withColumn("ts", F.col("ts") + F.make_dt_interval(hours=F.col("copy") * 12))  # a copy may come when the first is too old
    ev = ev.withColumn("client_event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")))
    known = N.identified(ev.where("copy = 0 and event_id % 6 = 0"), ["event_id", "event_type"])
    rows = N.judged_batch(N.identified(ev, ["event_id", "event_type"]), known, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), "copy")
    day = F.when(F.col("outcome") == "accepted", F.to_date("ts"))
    return rows.groupBy("outcome").agg(F.count("*").alias("events"), F.countDistinct("session_id").alias("sessions"), F.countDistinct(day).alias("dates"))


@query("k01_refresh_requests", over("SELECT kind, key FROM (SELECT DISTINCT 'cube_day' AS kind, CAST(CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS DATE) AS VARCHAR) AS key FROM ev WHERE ts BETWEEN TIMESTAMP '2024-01-19' AND TIMESTAMP '2024-01-20 00:05:00' UNION SELECT 'order', CAST(o.order_id AS VARCHAR) FROM ord o WHERE o.session_id IN (SELECT session_id FROM ev WHERE ts BETWEEN TIMESTAMP '2024-01-19' AND TIMESTAMP '2024-01-20 00:05:00'))"))
def k01_requests(spark, sf_dir):
    ev = V.events(spark, sf_dir)
    rows = N.judged_batch(N.identified(ev.withColumn("client_event_id", F.col("event_id").cast("string")), ["event_id"]), N.identified(ev.limit(0).withColumn("client_event_id", F.lit("x")), ["event_id"]), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), "event_id")
    return N.refresh_requests(rows.where("outcome = 'accepted'"), V.orders(spark, sf_dir))
