"""Queries on column functions and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dims as D
from tidemark.functions import text as T
from tidemark.functions.time import day_bounds, days
from tidemark.plans.base_sql import over
from tidemark.plans.registry import query
from tidemark.sources import sinks as K
from tidemark.sources import views as V
from tidemark.streaming import ingest as N


def _table(spark, sf_dir, name):
    return V.table(spark, sf_dir, name)


@query("f01_text_forms", "SELECT c_custkey, nullif(trim(t), '') AS trimmed, upper(nullif(trim(t), '')) AS uppered, regexp_replace(regexp_replace(lower(nullif(trim(t), '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key, regexp_replace(lower(nullif(trim(t), '')), '\\s+', ' ', 'g') AS free FROM (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '   ' ELSE '  ' || c_mktsegment || ' & Co.  ' || c_name || '! ' END AS t FROM customer)")
def f01(spark, sf_dir):
    t = F.when(F.col("c_custkey") % 11 == 0, "   ").otherwise(F.concat(F.lit("  "), "c_mktsegment", F.lit(" & Co.  "), "c_name", F.lit("! ")))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", t.alias("t"))
    return rows.select("c_custkey", T.trim_to_null(F.col("t")).alias("trimmed"), T.upper_to_null(F.col("t")).alias("uppered"), T.lookup_key(F.col("t")).alias("key"), T.freeform(F.col("t")).alias("free"))


ALIAS = "CASE o_orderkey % 8 WHEN 0 THEN 'Facebook' WHEN 1 THEN ' google-ads ' WHEN 2 THEN 'BING' WHEN 3 THEN 'TikTok' WHEN 4 THEN 'newsletter' WHEN 5 THEN '' WHEN 6 THEN 'somewhere' ELSE NULL END"
MEDIUM = "CASE o_orderkey % 5 WHEN 0 THEN 'PPC' WHEN 1 THEN 'Paid Social' WHEN 2 THEN 'seo' WHEN 3 THEN NULL ELSE 'weird' END"
CLICK = "CASE o_orderkey % 3 WHEN 0 THEN 'gclid' WHEN 1 THEN 'ttclid' END"


@query("f11_canonical_dimensions", f"SELECT o_orderkey, CASE s WHEN 'Facebook' THEN 'meta' WHEN ' google-ads ' THEN 'google' WHEN 'BING' THEN 'microsoft' WHEN 'TikTok' THEN 'tiktok' WHEN 'newsletter' THEN 'email' WHEN 'somewhere' THEN 'unmapped' ELSE CASE c WHEN 'gclid' THEN 'google' WHEN 'ttclid' THEN 'tiktok' END END AS source, CASE m WHEN 'PPC' THEN 'cpc' WHEN 'Paid Social' THEN 'paid_social' WHEN 'seo' THEN 'organic_search' WHEN 'weird' THEN 'unmapped' ELSE CASE c WHEN 'gclid' THEN 'cpc' WHEN 'ttclid' THEN 'paid_social' END END AS medium, lower(o_orderpriority) AS campaign, c AS click_type, CASE WHEN c IS NOT NULL THEN 'k' || CAST(o_orderkey AS VARCHAR) END AS click_value FROM (SELECT *, {ALIAS} AS s, {MEDIUM} AS m, {CLICK} AS c FROM orders)")
def f11(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderpriority", f"{ALIAS} as s", f"{MEDIUM} as m", f"{CLICK} as c").withColumn("v", F.when(F.col("c").isNotNull(), F.concat(F.lit("k"), F.col("o_orderkey").cast("string"))))
    raw = {"source": F.col("s"), "medium": F.col("m"), "campaign": F.col("o_orderpriority"), "click_type": F.col("c"), "click_value": F.col("v")}
    return rows.select("o_orderkey", D.touchpoint(raw).alias("d")).select("o_orderkey", "d.source", "d.medium", "d.campaign", "d.click_type", "d.click_value")


@query("f12_spend_dimensions", f"SELECT o_orderkey, CASE s WHEN 'Facebook' THEN 'meta' WHEN ' google-ads ' THEN 'google' WHEN 'BING' THEN 'microsoft' WHEN 'TikTok' THEN 'tiktok' WHEN 'newsletter' THEN 'email' WHEN 'somewhere' THEN 'unmapped' ELSE 'unknown' END AS source, 'unknown' AS content FROM (SELECT *, {ALIAS} AS s FROM orders)")
def f12(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{ALIAS} as s")
    return rows.select("o_orderkey", D.spend({"source": F.col("s")}).alias("d")).select("o_orderkey", "d.source", "d.content")


@query("f14_query_parameters", "SELECT page_id, url_decode(replace(nullif(regexp_extract(url, '^[^?#]*[?](?:[^#]*&)?utm_source=([^&#]*)', 1), ''), '+', ' ')) AS utm_source, url_decode(replace(nullif(regexp_extract(url, '^[^?#]*[?](?:[^#]*&)?ref=([^&#]*)', 1), ''), '+', ' ')) AS ref, CASE WHEN regexp_matches(regexp_replace(trim(url), '#.*$', ''), '^https?://[^/]+') THEN regexp_replace(trim(url), '#.*$', '') END AS bare, lower(nullif(regexp_extract(url, '^https?://([^/:?#]+)', 1), '')) AS host FROM pages")
def f14(spark, sf_dir):
    url = F.col("url")
    return _table(spark, sf_dir, "pages").select("page_id", T.query_parameter(url, "utm_source").alias("utm_source"), T.query_parameter(url, "ref").alias("ref"), T.normal_url(url).alias("bare"), T.url_host(url).alias("host"))


PHONE = "CASE c_custkey % 5 WHEN 0 THEN '+44 20 7946 ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') WHEN 1 THEN '(555) 123-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') WHEN 2 THEN '1555123' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') WHEN 3 THEN '0049 30 12' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') ELSE '12' END"


@query("f17_privacy_hashes", f"SELECT c_custkey, sha256(lower(trim('  ' || c_name || '@X.com '))) AS email, CASE c_custkey % 5 WHEN 1 THEN '+1' || d WHEN 3 THEN '+' || substr(d, 3) WHEN 4 THEN NULL ELSE '+' || d END AS phone FROM (SELECT *, regexp_replace({PHONE}, '[^0-9]', '', 'g') AS d FROM customer)")
def f17(spark, sf_dir):
    email = F.concat(F.lit("  "), "c_name", F.lit("@X.com "))
    return _table(spark, sf_dir, "customer").select("c_custkey", T.email_hash(email).alias("email"), T.e164(F.expr(PHONE.replace("VARCHAR", "STRING"))).alias("phone"))


@query("f31_number_parsing", "SELECT p_partkey, coalesce(TRY_CAST(nullif(regexp_extract(t, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0) AS prefix, TRY_CAST(nullif(trim(t), '') AS DOUBLE) AS strict, coalesce(TRY_CAST(t AS DOUBLE), 0.0) AS or_zero, CAST(floor(p_size * 123456 / 10000.0::DOUBLE + 0.5) AS BIGINT) AS micros, least(greatest(p_retailprice / 1000 - 1, 0.0), 1.0) AS clamped, CAST(least(30.0::DOUBLE * pow(2, greatest(p_size % 9, 1) - 1), 900) AS BIGINT) AS wait FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) || ' pcs' WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN 'none' ELSE '-' || CAST(p_size AS VARCHAR) || '.5' END AS t FROM part)")
def f31(spark, sf_dir):
    text = "case p_partkey % 4 when 0 then concat(p_size, ' pcs') when 1 then string(p_size) when 2 then 'none' else concat('-', p_size, '.5') end as t"
    t = F.col("t")
    return _table(spark, sf_dir, "part").selectExpr("*", text).select(
        "p_partkey", T.integer_prefix(t).alias("prefix"), T.strict_number(t).alias("strict"), T.number_or_zero(t).alias("or_zero"), T.micros_to_cents(F.col("p_size") * 123456).alias("micros"),
        T.clamp01(F.col("p_retailprice") / 1000 - 1).alias("clamped"), T.backoff_seconds(F.col("p_size") % 9, 30, 900).alias("wait"),
    )


@query("f36_local_day_bounds", over("""SELECT CAST(d AS VARCHAR) AS day, epoch_us(starts) AS starts_us, epoch_us(ends) AS ends_us, count(e.event_id) AS events FROM (
  SELECT d, (CAST(d AS TIMESTAMP) AT TIME ZONE 'America/Los_Angeles') AT TIME ZONE 'UTC' AS starts, (CAST(d + INTERVAL 1 DAY AS TIMESTAMP) AT TIME ZONE 'America/Los_Angeles') AT TIME ZONE 'UTC' - INTERVAL 1 MILLISECOND AS ends FROM (SELECT CAST(unnest(generate_series(DATE '2023-12-31', DATE '2024-12-31', INTERVAL 1 DAY)) AS DATE) AS d))
  LEFT JOIN ev e ON e.ts >= starts AND e.ts <= ends GROUP BY ALL"""))
def f36(spark, sf_dir):
    """The bounds of the year's local days in UTC, two of which aren't 24 hours long, and the events within them."""
    bounds = days(spark, "2023-12-31", "2024-12-31").withColumn("b", day_bounds(F.col("day"))).select("day", "b.starts", "b.ends")
    events = V.events(spark, sf_dir).select("ts", F.explode(F.array(F.to_date("ts"), F.date_sub(F.to_date("ts"), 1))).alias("day"))  # a time lies on its UTC day or the one before
    found = events.join(F.broadcast(bounds), "day").where(F.col("ts").between(F.col("starts"), F.col("ends"))).groupBy("day").agg(F.count("*").alias("events"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(f"{c}_us")
    return bounds.join(found, "day", "left").select(F.col("day").cast("string").alias("day"), us("starts"), us("ends"), F.coalesce("events", F.lit(0).cast("long")).alias("events"))


@query("p22_free_text", "SELECT c_custkey FROM customer WHERE contains(lower(c_name || chr(1) || c_mktsegment), 'mach')")
def p22(spark, sf_dir):
    return _table(spark, sf_dir, "customer").where(T.free_text_match(["c_name", "c_mktsegment"], " Mach ")).select("c_custkey")


@query("p21_keyset_page", "SELECT o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1998-01-01', 500) ORDER BY o_orderdate, o_orderkey LIMIT 100")
def p21(spark, sf_dir):
    after = F.struct(F.lit("1998-01-01 00:00:00").cast("timestamp_ntz").alias("o_orderdate"), F.lit(500).cast("long").alias("o_orderkey"))
    return _table(spark, sf_dir, "orders").where(F.struct("o_orderdate", "o_orderkey") > after).orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey")


UPSERT = "WITH o AS (SELECT c_custkey AS k, c_mktsegment AS a, c_nationkey AS n FROM customer WHERE c_custkey % 4 > 0), i AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 > 0 THEN 'new' END AS a, c_nationkey + 100 AS n FROM customer WHERE c_custkey % 2 = 0)"


def _both(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 4 > 0").selectExpr("c_custkey as k", "c_mktsegment as a", "c_nationkey as n")
    return old, c.where("c_custkey % 2 = 0").selectExpr("c_custkey as k", "case when c_custkey % 3 > 0 then 'new' end as a", "c_nationkey + 100 as n")


@query("s13_insert_new", UPSERT + " SELECT k, a, n FROM i WHERE k NOT IN (SELECT k FROM o)")
def s13(spark, sf_dir):
    return K.insert_new(*_both(spark, sf_dir), ["k"], [F.col("n")])


@query("s14_keep_first_known", UPSERT + " SELECT k, coalesce(o.a, i.a) AS a, least(o.n, i.n) AS n FROM o FULL OUTER JOIN i USING (k)")
def s14(spark, sf_dir):
    old, new = (df.withColumn("at", F.lit(0)) for df in _both(spark, sf_dir))
    return K.keep_first_known(old, new, ["k"], ["a"], ["n"], [], "at")


@query("s15_incoming_wins", UPSERT + " SELECT k, coalesce(i.a, o.a) AS a, coalesce(i.n, o.n) AS n FROM o FULL OUTER JOIN i USING (k)")
def s15(spark, sf_dir):
    return K.incoming_wins(*_both(spark, sf_dir), ["k"])


@query("s16_overwrite", UPSERT + " SELECT k, CASE WHEN i.k IS NULL THEN o.a ELSE i.a END AS a, coalesce(i.n, o.n) AS n FROM o FULL OUTER JOIN i USING (k)")
def s16(spark, sf_dir):
    return K.overwrite_rows(*_both(spark, sf_dir), ["k"], [F.col("n")])


PAYLOAD = "'{\"event_id\":' || CAST(event_id AS VARCHAR) || ',\"event_type\":\"' || event_type || '\"}'"


@query("s18_payload_integrity", f"SELECT event_id, CAST(octet_length(encode({PAYLOAD})) AS BIGINT) AS payload_bytes, sha256({PAYLOAD}) AS payload_sha256 FROM events")
def s18(spark, sf_dir):
    return K.with_integrity(_table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("p")), "p").drop("p")


@query("s19_integrity_status", f"SELECT event_id, event_id % 5 > 0 AND (event_id % 7 > 0) AS size_matches, event_id % 5 > 0 AND event_id % 7 > 0 AS hash_matches, CASE WHEN event_id % 5 = 0 THEN 'missing' WHEN event_id % 7 = 0 THEN 'mismatch' ELSE 'intact' END AS status FROM events")
def s19(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("p"))
    stored = rows.where("event_id % 5 > 0").withColumn("p", F.when(F.col("event_id") % 7 == 0, F.concat("p", F.lit(" "))).otherwise(F.col("p")))
    return K.integrity_status(K.with_integrity(rows, "p"), K.with_integrity(stored, "p"), "event_id")


@query("s20_json_rows", "SELECT '{\"customerKey\":' || CAST(c_custkey AS VARCHAR) || ',\"name\":\"' || c_name || '\",\"note\":null}' AS json FROM customer")
def s20(spark, sf_dir):
    return K.as_json(_table(spark, sf_dir, "customer").withColumn("none", F.lit(None).cast("string")), {"c_custkey": "customerKey", "c_name": "name", "none": "note"})


@query("k03_rejected_events", over("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN ts < TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR THEN 'too_old' WHEN ts > TIMESTAMP '2024-01-20' + INTERVAL 300 SECOND THEN 'in_future' ELSE 'admitted' END AS reason FROM ev) GROUP BY 1"))
def k03(spark, sf_dir):
    reason = F.coalesce(N.rejection(F.col("ts"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")), F.lit("admitted"))
    return V.events(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("k11_dual_write", over("SELECT status, count(*) AS n FROM (SELECT CASE WHEN b.event_id IS NULL THEN 'server_only' WHEN s.event_id IS NULL THEN 'browser_only' WHEN b.k = s.k THEN 'consistent' ELSE 'mismatch' END AS status FROM (SELECT * FROM ev WHERE event_id % 4 > 0) b FULL OUTER JOIN (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN k + 1 ELSE k END AS k FROM ev WHERE event_id % 5 > 0) s ON b.event_id = s.event_id) GROUP BY 1"))
def k11(spark, sf_dir):
    ev = V.events(spark, sf_dir)
    b = ev.where("event_id % 4 > 0").select("event_id", N.fingerprint(["event_id", "k"]).alias("b"))
    s = ev.where("event_id % 5 > 0").withColumn("k", F.when(F.col("event_id") % 9 == 0, F.col("k") + 1).otherwise(F.col("k"))).select("event_id", N.fingerprint(["event_id", "k"]).alias("s"))
    status = F.when(F.col("b").isNull(), "server_only").when(F.col("s").isNull(), "browser_only").when(F.col("b") == F.col("s"), "consistent").otherwise("mismatch")
    return b.join(s, "event_id", "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("n"))
