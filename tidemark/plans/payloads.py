"""Queries on JSON sources.

The payloads are built from the supplied tables by text that both engines read; the SQL states the
expected rows from the tables' columns and parses no JSON.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.time import day_count, event_time, hour_lag, zone_name, zoned_time
from tidemark.operators import ga4 as G
from tidemark.operators import spend as S
from tidemark.plans.base_sql import over
from tidemark.plans.registry import query
from tidemark.plans.spend import AD, ads
from tidemark.sources import payloads as P
from tidemark.sources import shards as D
from tidemark.sources import views as V
from tidemark.storage import shared_dir


def expr(sql: str):
    return F.expr(sql.replace("VARCHAR", "STRING"))


def _us(c):
    return F.unix_micros(c.cast("timestamp"))


SESSION = "'0000000A-0000-4000-8000-' || lpad(CAST(user_id AS VARCHAR), 12, '0')"
STAMP = "'2024-01-' || lpad(CAST(event_id % 28 + 1 AS VARCHAR), 2, '0') || 'T10:20:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0')"
EVENT_BODY = f"""CASE event_id % 11 WHEN 0 THEN '{{"eventType": ' ELSE
  '{{"eventType": "' || CASE event_id % 11 WHEN 1 THEN 'purchase' ELSE 'page_view' END || '", "occurredAt": "' || {STAMP} || CASE event_id % 11 WHEN 2 THEN '' ELSE 'Z' END || '", "sessionId": "' || CASE event_id % 11 WHEN 3 THEN 'none' ELSE {SESSION} END
  || '", "pageUrl": "' || CASE event_id % 11 WHEN 4 THEN 'ftp://x.example/' ELSE 'https://shop.example/p?x=1#top' END || '", "referrerUrl": ' || CASE event_id % 11 WHEN 5 THEN '"mailto:x"' ELSE 'null' END || ', "cartToken": " c' || CAST(event_id % 300 AS VARCHAR)
  || ' ", "consentState": "' || CASE event_id % 11 WHEN 7 THEN 'granted' WHEN 8 THEN 'maybe' ELSE 'denied' END || '"' || CASE event_id % 11 WHEN 6 THEN ', "other": 1' ELSE '' END || ', "context": {{"language": "en"}}}}' END"""
AT = "CAST(strptime(CAST(2024 AS VARCHAR) || '-01-' || lpad(CAST(event_id % 28 + 1 AS VARCHAR), 2, '0') || ' 10:20:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0'), '%Y-%m-%d %H:%M:%S') AS TIMESTAMP)"


@query("s03_browser_events", f"""SELECT event_id, CASE event_id % 11 WHEN 0 THEN 'not_json' WHEN 1 THEN 'event_type' WHEN 2 THEN 'occurred_at' WHEN 3 THEN 'session_id' WHEN 4 THEN 'page_url' WHEN 5 THEN 'referrer_url' WHEN 6 THEN 'unknown_field' END AS problem,
  CASE WHEN event_id % 11 NOT IN (0, 2) THEN epoch_us({AT}) END AS occurred_us, CASE event_id % 11 WHEN 0 THEN NULL WHEN 3 THEN 'none' ELSE lower({SESSION}) END AS session_id, CASE WHEN event_id % 11 NOT IN (0, 4) THEN 'https://shop.example/p?x=1' END AS page_url,
  CASE WHEN event_id % 11 > 0 THEN 'c' || CAST(event_id % 300 AS VARCHAR) END AS cart_token, CASE event_id % 11 WHEN 0 THEN 'unknown' WHEN 7 THEN 'granted' WHEN 8 THEN 'unknown' ELSE 'denied' END AS consent_state FROM events""")
def s03(spark, sf_dir):
    raw = V.table(spark, sf_dir, "events").select("event_id", expr(EVENT_BODY).alias("body"))
    return P.browser_events(raw).select("event_id", "problem", _us(F.col("occurred_at")).alias("occurred_us"), "session_id", "page_url", "cart_token", "consent_state")


CAPTURE = f"""'{{"schema_version": ' || CASE event_id % 7 WHEN 0 THEN '2' ELSE '1' END || ', "session_id": "' || CASE event_id % 7 WHEN 1 THEN '' ELSE {SESSION} END || '", "occurred_at": "' || {STAMP} || 'Z", "captured_at": "' || CASE event_id % 7 WHEN 2 THEN 'soon' ELSE '2024-02-01T00:00:00+01:00' END
  || '", "landing_url": "' || CASE event_id % 7 WHEN 3 THEN 'javascript:x' ELSE ' https://a.example/l#x ' END || '", "utm_source": " GooGle ", "utm_term": "", "gclid": ' || CASE event_id % 2 WHEN 0 THEN '"Abc"' ELSE 'null' END || '}}'"""


@query("s04_captures", """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'schema_version' WHEN 1 THEN 'session_id' WHEN 2 THEN 'time' WHEN 3 THEN 'url' END AS problem, CASE WHEN event_id % 7 <> 2 THEN epoch_us(TIMESTAMP '2024-01-31 23:00:00') END AS captured_us,
  CASE WHEN event_id % 7 <> 3 THEN 'https://a.example/l' END AS landing_url, 'google' AS utm_source, CAST(NULL AS VARCHAR) AS utm_term, CASE WHEN event_id % 2 = 0 THEN 'Abc' END AS gclid,
  CASE WHEN event_id % 7 = 1 THEN 'missing_session_id' WHEN event_id % 7 = 3 THEN 'partial' ELSE 'complete' END AS status FROM events""")
def s04(spark, sf_dir):
    rows = P.captures(V.table(spark, sf_dir, "events").select("event_id", expr(CAPTURE).alias("body")))
    status = P.capture_status(F.col("session_id"), [F.col("utm_source"), F.col("gclid")], [F.col("landing_url")])
    return rows.select("event_id", "problem", _us(F.col("captured_at")).alias("captured_us"), "landing_url", "utm_source", "utm_term", "gclid", status.alias("status"))


@query("s05_session_bootstrap", "SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS landing_url, CASE WHEN page_id % 2 = 0 THEN 'https://search.example/q' END AS referrer_url, CASE WHEN u IS NULL THEN NULL WHEN u IN ('newsletter', 'email') THEN 'email' WHEN u IN ('google', 'adwords', 'youtube') THEN 'google' WHEN u IN ('facebook', 'fb', 'instagram') THEN 'meta' WHEN u IN ('bing') THEN 'microsoft' WHEN u = 'twitter' THEN 'unmapped' ELSE 'unmapped' END AS source FROM (SELECT *, lower(nullif(regexp_extract(url, '^[^?#]*[?](?:[^#]*&)?utm_source=([^&#]*)', 1), '')) AS u FROM pages)")
def s05(spark, sf_dir):
    rows = V.table(spark, sf_dir, "pages").select("page_id", "url", F.when(F.col("page_id") % 2 == 0, "https://search.example/q").otherwise(F.col("url")).alias("referrer"))
    return P.session_bootstrap(rows).select("page_id", "landing_url", "referrer_url", "source")


@query("f13_resolved_urls", "SELECT page_id, 'https://shop.example/a/' || CAST(page_id AS VARCHAR) AS relative, 'https://shop.example/x' AS rooted, 'https://cdn.example/y' AS schemeless, CAST(NULL AS VARCHAR) AS mail, 'https://shop.example/a/b?k=2' AS query_only FROM pages")
def f13(spark, sf_dir):
    base = "https://shop.example/a/b?k=1#z"
    at = lambda c: T.resolved_url(c, base)
    return V.table(spark, sf_dir, "pages").select("page_id", at(F.col("page_id").cast("string")).alias("relative"), at(F.lit("/x#f")).alias("rooted"), at(F.lit("//cdn.example/y")).alias("schemeless"), at(F.lit("mailto:x@y.example")).alias("mail"), at(F.lit("?k=2")).alias("query_only"))


ORDER_BODY = """'{"id": ' || CASE o_orderkey % 13 WHEN 0 THEN 'null' ELSE CAST(o_orderkey AS VARCHAR) END || ', "name": "#' || CAST(o_orderkey AS VARCHAR) || '", "customer_id": "' || CAST(o_custkey AS VARCHAR) || '", "source_name": ' || CASE o_orderkey % 3 WHEN 0 THEN 'null' ELSE '"web"' END || ', "checkout_token": " t' || CAST(o_orderkey % 500 AS VARCHAR)
  || '", "total_price": "' || CASE o_orderkey % 13 WHEN 1 THEN 'free' ELSE CAST(o_orderkey AS VARCHAR) || '.50' END || '", "processed_at": ' || CASE o_orderkey % 5 WHEN 0 THEN 'null' ELSE '"2024-01-05T01:00:00Z"' END || ', "created_at": "2024-01-04T01:00:00-02:00", "line_items": [{"sku": "s' || CAST(o_orderkey % 9 AS VARCHAR)
  || '", "quantity": 2, "price": "1.25"}' || CASE o_orderkey % 2 WHEN 0 THEN ', {"sku": " ", "quantity": 1, "price": "x"}' ELSE '' END || ']}'"""


def _webhook(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("delivery"), F.lit("orders/create").alias("topic"), (F.col("o_custkey") % 3).cast("string").alias("shop"), expr(ORDER_BODY).alias("payload"))


@query("s06_webhook_orders", "SELECT o_orderkey AS delivery, CASE o_orderkey % 13 WHEN 0 THEN 'id' WHEN 1 THEN 'total_price' END AS problem, CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey END AS order_id, CASE WHEN o_orderkey % 3 > 0 THEN 'web' ELSE '' END AS source_name, 't' || CAST(o_orderkey % 500 AS VARCHAR) AS checkout_token, CASE WHEN o_orderkey % 13 <> 1 THEN o_orderkey * 100 + 50 END AS cents, epoch_us(CASE WHEN o_orderkey % 5 > 0 THEN TIMESTAMP '2024-01-05 01:00:00' ELSE TIMESTAMP '2024-01-04 03:00:00' END) AS ordered_us FROM orders")
def s06(spark, sf_dir):
    return P.webhook_orders(_webhook(spark, sf_dir)).select("delivery", "problem", "order_id", "source_name", "checkout_token", "cents", _us(F.col("ordered_at")).alias("ordered_us"))


@query("s06_order_lines", "SELECT o_orderkey AS order_id, CAST(n AS INTEGER) AS line_no, CASE WHEN n = 0 THEN 's' || CAST(o_orderkey % 9 AS VARCHAR) END AS sku, CAST(CASE WHEN n = 0 THEN 2 ELSE 1 END AS INTEGER) AS quantity, CAST(CASE WHEN n = 0 THEN 125 END AS BIGINT) AS cents FROM orders CROSS JOIN (SELECT unnest([0, 1]) AS n) WHERE o_orderkey % 13 > 1 AND (n = 0 OR o_orderkey % 2 = 0)")
def s06_lines(spark, sf_dir):
    return P.order_lines(P.webhook_orders(_webhook(spark, sf_dir)))


@query("s06_receipts", "SELECT CAST(o_custkey % 3 AS VARCHAR) AS shop, count(*) AS deliveries, count(*) FILTER (o_orderkey % 4 = 0 OR copy = 1) AS duplicates FROM orders CROSS JOIN (SELECT unnest([0, 1]) AS copy) GROUP BY 1")
def s06_receipts(spark, sf_dir):
    raw = P.receipts(_webhook(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))))
    old = raw.where("copy = 0 and delivery % 4 = 0")
    return P.new_receipts(old, raw, "copy").groupBy("shop").agg(F.count("*").alias("deliveries"), F.count_if("duplicate").alias("duplicates"))


EXPORT = "array<struct<order_id:bigint,cents:bigint,ordered_at:timestamp_ntz,version:int>>"


@query("s07_paged_backfill", over("SELECT order_id, cents + CASE WHEN order_id % 4 = 0 THEN 1 ELSE 0 END AS cents, epoch_us(ts) AS ordered_us FROM ord WHERE ts >= TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-20'"))
def s07(spark, sf_dir):
    orders = V.orders(spark, sf_dir).select("order_id", "cents", F.col("ts").alias("ordered_at"), F.lit(1).alias("version"))
    again = orders.where("order_id % 4 = 0").withColumns({"cents": F.col("cents") + 1, "version": F.lit(2)})
    pages = orders.unionByName(again).groupBy(F.expr("order_id div 500").alias("page_no")).agg(F.to_json(F.struct(F.collect_list(F.struct("order_id", "cents", "ordered_at", "version")).alias("orders")), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("body"))
    rows = P.paged_rows(pages, f"orders {EXPORT}", "orders").select("item.*")
    at = lambda d: F.lit(f"{d} 00:00:00").cast("timestamp_ntz")
    return P.latest_orders(rows, at("2024-01-08"), at("2024-01-20")).select("order_id", "cents", _us(F.col("ordered_at")).alias("ordered_us"))


def _insight_pages(spark, sf_dir):
    """Pages of 200 orders' rows, however many orders there are; page n names page n + 1 as its next."""
    o, n = F.col("ordinal"), F.col("l_linenumber")
    entry = lambda name, value: F.array(F.struct(F.lit(name).alias("action_type"), value.alias("value")))
    value = F.when(o % 17 == 0, "n/a").otherwise(F.col("l_quantity").cast("long").cast("string"))
    r = o % 23
    name = F.when(r == 0, "purchase").when(r == 1, "omni_purchase").when(r == 2, "Web_Purchase").when(r == 3, "app_purchase").otherwise("link_click")
    metric = lambda k: F.when(n % 3 == k, F.array(F.struct(name.alias("action_type"), value.alias("value"))))
    rows = ads(spark, sf_dir).select(F.expr("ordinal div 2000").alias("page_no"), o.alias("ordinal"), "l_quantity", F.struct("campaign_id", "campaign_name", F.col("report_date").cast("string").alias("date_start"), F.col("cents").cast("string").alias("spend"), metric(1).alias("actions"), metric(0).alias("action_values"), metric(2).alias("purchase_roas")).alias("row"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "l_quantity", "row"))), lambda x: x["row"])
    following = F.concat(F.lit("https://api.example/p"), (F.col("page_no") + 1).cast("string"))
    return rows.groupBy("page_no").agg(listed.alias("data")).select("page_no", F.concat(F.lit("https://api.example/p"), F.col("page_no").cast("string")).alias("url"), F.to_json(F.struct("data", F.struct(following.alias("next")).alias("paging"))).alias("body"))


@query("s08_insight_rows", over("SELECT CAST(report_date AS VARCHAR) AS day, campaign_id, count(*) AS rows, CAST(sum(cents) AS BIGINT) AS cents FROM ad GROUP BY 1, 2", AD))
def s08(spark, sf_dir):
    rows = P.insights(_insight_pages(spark, sf_dir))
    return rows.groupBy(F.col("date_start").alias("day"), "campaign_id").agg(F.count("*").alias("rows"), F.sum(F.col("spend").cast("long")).alias("cents"))


@query("s09_missing_pages", over("SELECT 'https://api.example/p' || CAST(p + 1 AS VARCHAR) AS url FROM (SELECT DISTINCT ordinal // 2000 AS p FROM ad) WHERE p + 1 NOT IN (SELECT DISTINCT ordinal // 2000 FROM ad)", AD))
def s09(spark, sf_dir):
    return P.missing_pages(_insight_pages(spark, sf_dir))


RAW_VALUES = """
ent AS (SELECT report_date, campaign_id, ordinal // 2000 AS page, ordinal, l_quantity, CASE l_linenumber % 3 WHEN 0 THEN 'action_values' WHEN 1 THEN 'actions' ELSE 'purchase_roas' END AS kind,
  CASE ordinal % 23 WHEN 0 THEN 'purchase' WHEN 1 THEN 'omni_purchase' WHEN 2 THEN 'Web_Purchase' WHEN 3 THEN 'app_purchase' ELSE 'link_click' END AS action_type, CASE WHEN ordinal % 17 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) END AS v FROM ad),
byt AS (SELECT report_date, campaign_id, action_type, min((page, ordinal)) AS first, sum(CASE WHEN kind = 'action_values' THEN CAST(v * 100 AS BIGINT) END) AS value_cents, sum(CASE WHEN kind = 'actions' THEN CAST(v AS BIGINT) END) AS purchases,
  arg_min(v, (page, ordinal, l_quantity)) FILTER (kind = 'purchase_roas' AND v IS NOT NULL) AS roas FROM ent WHERE lower(action_type) LIKE '%purchase%' GROUP BY ALL),
bt AS (SELECT *, row_number() OVER (PARTITION BY report_date, campaign_id ORDER BY rank, first) AS rn FROM (SELECT *, CASE action_type WHEN 'purchase' THEN 1 WHEN 'omni_purchase' THEN 2 ELSE 4 END AS rank FROM byt))
"""


@query("c17_order_values_of_payloads", over("SELECT CAST(k.report_date AS VARCHAR) AS day, k.campaign_id, b.action_type AS action_type_used, CASE WHEN b.rank IS NULL THEN 'none' WHEN b.rank <= 3 THEN 'priority' ELSE 'fallback' END AS selection, CAST(b.value_cents AS BIGINT) AS value_cents, CAST(b.purchases AS BIGINT) AS purchases, b.roas, floor(CAST(b.value_cents AS DOUBLE) / nullif(k.cents, 0) * 10000 + 0.5) / 10000.0::DOUBLE AS value_rate FROM (SELECT report_date, campaign_id, CAST(sum(cents) AS DOUBLE) AS cents FROM ad GROUP BY 1, 2) k LEFT JOIN (SELECT * FROM bt WHERE rn = 1) b USING (report_date, campaign_id)", AD, RAW_VALUES))
def c17_raw(spark, sf_dir):
    rows = P.insights(_insight_pages(spark, sf_dir)).withColumnRenamed("date_start", "day")
    entries = P.metric_entries(rows, ["day", "campaign_id"], F.struct("page_no", "item_no"))
    spent = rows.groupBy("day", "campaign_id").agg(F.sum(F.col("spend").cast("long")).alias("cents"))
    out = S.order_values(entries, ["day", "campaign_id"]).join(spent, ["day", "campaign_id"])
    return out.select("day", "campaign_id", "action_type_used", "selection", "value_cents", "purchases", "roas", T.rate4(F.col("value_cents"), F.col("cents")).alias("value_rate"))


@query("s10_query_language_rows", over("SELECT campaign_id, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(cents) * 10000 AS BIGINT) AS micros FROM ad WHERE report_date = DATE '2024-01-12' GROUP BY 1", AD))
def s10(spark, sf_dir):
    rows = ads(spark, sf_dir).select(F.expr("ordinal div 5000").alias("batch"), F.struct(F.struct(F.col("campaign_id").alias("id")).alias("campaign"), F.struct(F.col("report_date").cast("string").alias("date")).alias("segments"), F.struct("clicks", (F.col("cents") * 10_000).cast("string").alias("costMicros")).alias("metrics")).alias("r"))
    pages = rows.groupBy("batch").agg(F.to_json(F.struct(F.collect_list("r").alias("results"))).alias("body"))
    kind = "results array<struct<campaign:struct<id:string>,segments:struct<date:string>,metrics:struct<clicks:bigint,costMicros:string>>>"
    found = P.dated_rows(P.paged_rows(pages, kind, "results"), "item.segments.date", "2024-01-12")
    return found.groupBy(F.col("item.campaign.id").alias("campaign_id")).agg(F.sum("item.metrics.clicks").alias("clicks"), F.sum(F.col("item.metrics.costMicros").cast("long")).alias("micros"))


@query("s11_sharded_scan", over("SELECT CASE WHEN user_id % 4 > 0 THEN 'events' ELSE 'intraday' END AS table_type, strftime(ts, '%Y%m%d') AS suffix, count(*) AS rows FROM ev WHERE strftime(ts, '%Y%m%d') BETWEEN '20240110' AND '20240112' GROUP BY 1, 2"))
def s11(spark, sf_dir):
    rows = V.events(spark, sf_dir).withColumn("suffix", F.date_format("ts", "yyyyMMdd"))
    out = P.shards(rows.where("user_id % 4 > 0"), rows.where("user_id % 4 = 0"), "20240110", "20240112")
    return out.groupBy("table_type", "suffix").agg(F.count("*").alias("rows"))


def laid_out(spark, sf_dir):
    """All events as shards by day; those of the last four days are there as intraday shards, too."""
    path = f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    rows = V.events(spark, sf_dir).select("event_id", "user_id", "ts")
    late = rows.where(F.col("ts") >= F.lit("2024-01-27").cast("timestamp_ntz"))
    both = rows.where(F.to_date("ts") < F.lit("2024-01-29").cast("date")).withColumn("kind", F.lit("events")).unionByName(late.withColumn("kind", F.lit("intraday")))
    D.write_shards(both, path, F.col("kind"), F.to_date("ts"))
    return D.read_shards(spark, path, "event_id long, user_id long, ts timestamp_ntz, kind string").drop("kind")


SHARDS = "sh AS (SELECT event_id, 'events' AS table_type, strftime(ts, '%Y%m%d') AS suffix FROM ev WHERE ts < TIMESTAMP '2024-01-29' UNION ALL SELECT event_id, 'intraday', strftime(ts, '%Y%m%d') FROM ev WHERE ts >= TIMESTAMP '2024-01-27')"


@query("s11_pruned_shards", over("SELECT table_type, suffix, count(*) AS rows FROM sh s WHERE suffix BETWEEN '20240126' AND '20240130' AND (table_type = 'events' OR NOT EXISTS (SELECT 1 FROM sh d WHERE d.table_type = 'events' AND d.suffix = s.suffix)) GROUP BY 1, 2", SHARDS))
def s11_pruned(spark, sf_dir):
    rows = D.one_kind_a_day(D.between(laid_out(spark, sf_dir), "20240126", "20240130"))
    return rows.groupBy("table_type", F.col("table_suffix").alias("suffix")).agg(F.count("*").alias("rows"))


@query("s11_shards_since_watermark", over("SELECT table_type, suffix, count(*) AS rows FROM sh WHERE suffix >= CASE table_type WHEN 'events' THEN '20240118' ELSE '20240127' END AND suffix <= '20240129' GROUP BY 1, 2", SHARDS))
def s11_since(spark, sf_dir):
    marks = V.events(spark, sf_dir).agg(F.max("ts")).select(F.explode(F.expr("map('events', date'2024-01-20', 'intraday', date'2024-01-29')")).alias("table_type", "watermark"))
    return D.since(laid_out(spark, sf_dir), marks, "20240129", 2).groupBy("table_type", F.col("table_suffix").alias("suffix")).agg(F.count("*").alias("rows"))


@query("s21_export_list", over("SELECT session_id, user_id, epoch_us(last_seen) AS last_us FROM sess"))
def s21(spark, sf_dir):
    return G.export_list(V.sessions(spark, sf_dir), "last_seen", "session_id").select("session_id", "user_id", _us(F.col("last_seen")).alias("last_us"))


@query("f23_stable_json", over("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE '{\"a\":[1,{\"x\":null,\"y\":\"' || event_type || '\"}],\"b\":{\"c\":true,\"d\":' || CAST(k AS VARCHAR) || '},\"z\":\"ü\"}' END AS stable FROM ev"))
def f23(spark, sf_dir):
    body = expr("""CASE WHEN event_id % 5 = 0 THEN '{"z": ' ELSE '{"z": "ü", "b": {"d": ' || CAST(k AS VARCHAR) || ', "c": true}, "a": [1, {"y": "' || event_type || '", "x": null}]}' END""")
    return V.events(spark, sf_dir).select("event_id", P.stable_json(body).alias("stable"))


@query("f21_sql_fingerprints", over("SELECT event_id, sha256('{\"page_url\": \"' || coalesce(source, '') || '\", \"cart_token\": \"' || cart_token || '\", \"event_type\": \"' || event_type || '\", \"session_id\": \"' || session_id || '\"}') AS fingerprint FROM ev"))
def f21(spark, sf_dir):
    ev = V.events(spark, sf_dir)
    # equal lengths go by letters: cart_token, event_type and session_id have ten
    return ev.select("event_id", P.sql_fingerprint({c: F.col(c) for c in ("session_id", "event_type", "cart_token")} | {"page_url": F.col("source")}).alias("fingerprint"))


@query("f22_candidate_keys", over("SELECT event_id, sha256('{\"user_id\":' || CAST(user_id AS VARCHAR) || ',\"source\":' || coalesce('\"' || source || '\"', 'null') || '}') AS candidate_key FROM ev"))
def f22(spark, sf_dir):
    return V.events(spark, sf_dir).select("event_id", P.json_key("user_id", "source").alias("candidate_key"))


@query("f20_privacy_fingerprints", over("SELECT event_id, CASE WHEN user_id % 9 > 0 THEN sha256('10.0.0.' || CAST(user_id AS VARCHAR)) END AS ip_hash, sha256('{\"session_id\":\"' || session_id || '\",\"event_type\":\"' || event_type || '\",\"campaign\":' || coalesce('\"' || campaign || '\"', 'null') || '}') AS fingerprint FROM ev"))
def f20(spark, sf_dir):
    ip = F.when(F.col("user_id") % 9 > 0, F.concat(F.lit(" 10.0.0."), F.col("user_id").cast("string"), F.lit(" "))).otherwise(" ")
    return V.events(spark, sf_dir).select("event_id", T.ip_hash(ip).alias("ip_hash"), P.json_key("session_id", "event_type", "campaign").alias("fingerprint"))


@query("f39_snapshot_fields", "SELECT event_id, CASE WHEN event_id % 4 IN (0, 3) THEN 0.5 END AS confidence, CASE WHEN event_id % 3 = 0 THEN 's' || CAST(user_id AS VARCHAR) END AS session_id FROM events")
def f39(spark, sf_dir):
    body = expr("""'{"confidenceScore": ' || CASE event_id % 4 WHEN 0 THEN '0.5' WHEN 1 THEN '"0.5"' WHEN 2 THEN 'null' ELSE '5e-1' END || ', "winner": ' || CASE event_id % 3 WHEN 0 THEN '{"sessionId": "s' || CAST(user_id AS VARCHAR) || '"}' WHEN 1 THEN '{"sessionId": 7}' ELSE '["x"]' END || '}'""")
    rows = V.table(spark, sf_dir, "events").select("event_id", body.alias("snapshot"))
    return rows.select("event_id", P.typed_json(F.col("snapshot"), "$.confidenceScore", "double").alias("confidence"), P.typed_json(F.col("snapshot"), "$.winner.sessionId", "string").alias("session_id"))


@query("f40_consent_states", "SELECT state, count(*) AS n FROM (SELECT CASE event_id % 5 WHEN 0 THEN 'granted' WHEN 1 THEN 'denied' WHEN 2 THEN 'unknown' WHEN 3 THEN 'denied' ELSE 'unknown' END AS state FROM events) GROUP BY 1")
def f40(spark, sf_dir):
    body = expr("""CASE event_id % 5 WHEN 0 THEN '{"consentState": "granted", "consent_state": "denied"}' WHEN 1 THEN '{"consent_state": "denied"}' WHEN 2 THEN '{"consentState": "yes"}' WHEN 3 THEN '{"consentState": "yes", "consent_state": "denied"}' ELSE 'no json' END""")
    return V.table(spark, sf_dir, "events").groupBy(P.payload_consent(body).alias("state")).agg(F.count("*").alias("n"))


@query("f45_click_ids", over("SELECT event_id, CASE WHEN k % 3 = 0 THEN 'gbraid' WHEN k % 3 = 1 THEN 'gclid' END AS click_type, CASE WHEN k % 3 = 0 THEN 'B_' || CAST(event_id AS VARCHAR) WHEN k % 3 = 1 THEN 'G.' || CAST(event_id AS VARCHAR) END AS click_value FROM ev"))
def f45(spark, sf_dir):
    k, e = F.col("k"), F.col("event_id").cast("string")
    param = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("string_value"))
    rows = V.events(spark, sf_dir).select("event_id", F.array(param("page", F.lit("x")), param("GCLID", F.when(k % 3 == 1, F.concat(F.lit("G."), e)).otherwise("a b")), param("gbraid", F.when(k % 3 == 0, F.concat(F.lit(" B_"), e)).otherwise("%"))).alias("params"))
    return rows.select("event_id", G.first_click_id(F.col("params")).alias("c")).select("event_id", F.col("c.key").alias("click_type"), F.col("c.value").alias("click_value"))


@query("p01_order_times", over("SELECT event_id, epoch_us(CASE WHEN k % 3 = 0 THEN ts WHEN k % 3 = 1 THEN ts - INTERVAL 1 HOUR ELSE TIMESTAMP '2024-02-01' END) AS ordered_us FROM ev"))
def p01(spark, sf_dir):
    ev = V.events(spark, sf_dir).select("event_id", F.when(F.col("k") % 3 == 0, F.col("ts")).alias("processed_at"), F.when(F.col("k") % 3 < 2, F.col("ts") - F.expr("interval 1 hour")).alias("created_at"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("ingested_at"))
    return ev.select("event_id", _us(event_time("processed_at", "created_at", "ingested_at")).alias("ordered_us"))


@query("p02_zoned_times", f"SELECT event_id, epoch_us(CASE event_id % 4 WHEN 0 THEN {AT} WHEN 1 THEN {AT} - INTERVAL 2 HOUR WHEN 2 THEN TIMESTAMP '2024-01-01 00:00:00' END) AS ts_us, CASE event_id % 4 WHEN 0 THEN 'processed' WHEN 1 THEN 'processed' WHEN 2 THEN 'created' END AS source FROM events")
def p02(spark, sf_dir):
    processed = expr(f"CASE event_id % 4 WHEN 0 THEN {STAMP} || 'Z' WHEN 1 THEN ' ' || {STAMP} || '+02:00 ' WHEN 2 THEN {STAMP} ELSE 'none' END")
    created = expr("CASE event_id % 4 WHEN 3 THEN '2024-01-01' ELSE '2024-01-01T00:00:00Z' END")
    rows = V.table(spark, sf_dir, "events").select("event_id", processed.alias("processed"), created.alias("created")).select("event_id", zoned_time("processed", "created").alias("t"))
    return rows.select("event_id", F.unix_micros("t.ts").alias("ts_us"), "t.source")


@query("p19_web_protocols", "SELECT page_id, page_id % 3 <> 0 AS passes FROM pages")
def p19(spark, sf_dir):
    url = F.when(F.col("page_id") % 3 == 0, "data:text/html,x").when(F.col("page_id") % 3 == 1, F.col("url"))
    return V.table(spark, sf_dir, "pages").select("page_id", P.has_web_protocol(url).alias("passes"))


@query("p26_date_lists", over("SELECT user_id, array_to_string(list_sort(list(DISTINCT strftime(ts, '%Y-%m-%d'))), ',') AS days FROM ev GROUP BY 1"))
def p26(spark, sf_dir):
    text = F.when(F.col("event_id") % 10 == 0, "2024-1-5").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    both = V.events(spark, sf_dir).select("user_id", F.explode(F.array(text, F.date_format("ts", "yyyy-MM-dd"))).alias("day"))
    listed = both.groupBy("user_id").agg(F.collect_list("day").alias("days"))
    return listed.select("user_id", F.array_join(T.date_list(F.col("days")), ",").alias("days"))


@query("p11_membership", over("SELECT order_id FROM ord WHERE list_contains([3, 14, 15, 92, 65], user_id)"))
def p11(spark, sf_dir):
    return V.orders(spark, sf_dir).where(F.col("user_id").isin([3, 14, 15, 92, 65])).select("order_id")


@query("f37_zone_names", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'America/Los_Angeles' WHEN 1 THEN 'America/Los_Angeles' WHEN 2 THEN 'Europe/Berlin' END AS zone FROM customer")
def f37(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 4 == 0, " pst ").when(F.col("c_custkey") % 4 == 1, "PT").when(F.col("c_custkey") % 4 == 2, "Europe/Berlin").otherwise("Mars/Base")
    return V.table(spark, sf_dir, "customer").select("c_custkey", zone_name(raw).alias("zone"))


@query("f52_ingestion_lag", over("SELECT user_id, CAST(greatest(round((epoch_us(TIMESTAMP '2024-01-30 22:00:00') - epoch_us(m)) / 3600000000.0), 0) AS BIGINT) AS lag_hours, CASE WHEN greatest(round((epoch_us(TIMESTAMP '2024-01-30 22:00:00') - epoch_us(m)) / 3600000000.0), 0) >= 2 THEN 'lagging' ELSE 'healthy' END AS status FROM (SELECT user_id, max(ts) AS m FROM ev GROUP BY 1)"))
def f52(spark, sf_dir):
    marks = V.events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("m"))
    lag = hour_lag(F.lit("2024-01-30 22:00:00").cast("timestamp_ntz"), F.col("m"))
    return marks.select("user_id", lag.alias("lag_hours"), F.when(lag >= 2, "lagging").otherwise("healthy").alias("status"))


@query("f33_daily_spend", over("SELECT campaign_id, CAST(date_diff('day', min(report_date), max(report_date)) + 1 AS INTEGER) AS days, CAST(sum(cents) AS DOUBLE) / (date_diff('day', min(report_date), max(report_date)) + 1) AS cents_per_day FROM ad GROUP BY 1", AD))
def f33(spark, sf_dir):
    rows = ads(spark, sf_dir).groupBy("campaign_id").agg(F.min("report_date").alias("a"), F.max("report_date").alias("b"), F.sum("cents").alias("cents"))
    n = day_count(F.col("a"), F.col("b"))
    return rows.select("campaign_id", n.alias("days"), (F.col("cents") / n).alias("cents_per_day"))


@query("u07_entity_extracts", over("SELECT platform, kind, entity, count(*) AS rows FROM (SELECT CASE WHEN account_id < 'a2' THEN 'google_ads' ELSE 'meta_ads' END AS platform, 'campaign' AS kind, campaign_id AS entity FROM ad UNION ALL SELECT CASE WHEN account_id < 'a2' THEN 'google_ads' ELSE 'meta_ads' END, 'adset', adset_id FROM ad UNION ALL SELECT CASE WHEN account_id < 'a2' THEN 'google_ads' ELSE 'meta_ads' END, 'ad', ad_id FROM ad) WHERE entity IS NOT NULL GROUP BY ALL", AD))
def u07(spark, sf_dir):
    rows = ads(spark, sf_dir)
    tables = {"google_ads": rows.where("account_id < 'a2'"), "meta_ads": rows.where("account_id >= 'a2'")}
    return S.entity_extracts(tables, ["campaign", "adset", "ad"]).groupBy("platform", "kind", "entity").agg(F.count("*").alias("rows"))


@query("j25_metadata_by_composite_key", over("SELECT a.ordinal, CASE WHEN a.campaign_id NOT LIKE '%7' THEN 'named ' || a.campaign_id END AS entity_name, CASE WHEN a.creative_id LIKE '%1' THEN 'art ' || a.creative_id END AS creative_name FROM ad a", AD))
def j25(spark, sf_dir):
    rows = ads(spark, sf_dir).withColumn("platform", F.lit("meta_ads"))
    known = rows.where(~F.col("campaign_id").endswith("7")).select("platform", "account_id", F.lit("campaign").alias("kind"), F.col("campaign_id").alias("entity"), F.concat(F.lit("named "), "campaign_id").alias("name")).distinct()
    art = rows.where(F.col("creative_id").endswith("1")).select("creative_id", F.concat(F.lit("art "), "creative_id").alias("creative_name")).distinct()
    return S.with_names(rows, known, art).select("ordinal", "entity_name", "creative_name")
