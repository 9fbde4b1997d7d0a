"""Queries on quality, retention, backfill and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import attribution as A
from tidemark.operators import quality as Q
from tidemark.plans.base_sql import over, over_credits
from tidemark.plans.registry import query
from tidemark.sources import views as V

NOW = "2024-01-31 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


DAILY = "daily AS (SELECT day AS metric_date, coalesce(v, 0) AS visits, coalesce(o, 0) AS orders, coalesce(r, 0) AS revenue FROM (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type <> 'purchase') AS v, count(*) FILTER (event_type = 'purchase') AS o, sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) FILTER (event_type = 'purchase') AS r FROM ev WHERE CAST(ts AS DATE) < DATE '2024-01-30' OR event_id % 3 = 0 GROUP BY 1))"


@query("c21_anomalies", over("""SELECT metric, c AS current_value, b AS baseline_value, (b - c) / b AS relative_delta FROM (SELECT metric, CAST(max(CASE WHEN metric_date = DATE '2024-01-30' THEN v END) AS DOUBLE) AS c, CAST(sum(CASE WHEN metric_date <> DATE '2024-01-30' THEN v END) AS DOUBLE) / count(CASE WHEN metric_date <> DATE '2024-01-30' THEN v END) AS b
  FROM (SELECT metric_date, 'visits' AS metric, visits AS v FROM daily UNION ALL SELECT metric_date, 'orders', orders FROM daily UNION ALL SELECT metric_date, 'revenue', revenue FROM daily) GROUP BY 1) WHERE c IS NOT NULL AND b >= 5 AND (b - c) / b >= 0.35""", DAILY))
def c21(spark, sf_dir):
    ev = V.events(spark, sf_dir).where("ts < timestamp_ntz '2024-01-30 00:00:00' or event_id % 3 = 0")
    bought = F.col("event_type") == "purchase"
    daily = ev.groupBy(F.to_date("ts").alias("metric_date")).agg(F.count_if(~bought).alias("visits"), F.count_if(bought).alias("orders"), F.coalesce(F.sum(F.when(bought, F.floor(F.col("value") * 100 + 0.5).cast("long"))), F.lit(0)).alias("revenue"))
    return Q.anomalies(daily, "2024-01-30", ["visits", "orders", "revenue"])


CHECKS = """checks AS (
  SELECT 'sessions_of_two_days' AS check_key, count(*) AS discrepancies, 0 AS threshold, 'critical' AS severity FROM (SELECT session_id FROM ev GROUP BY 1 HAVING count(DISTINCT CAST(ts AS DATE)) > 1)
  UNION ALL SELECT 'errors', count(*) FILTER (event_type = 'error'), 5, 'critical' FROM ev
  UNION ALL SELECT 'direct', count(*) FILTER (source IS NULL), 1000000000, 'warning' FROM ev)"""
STATUS = "CASE WHEN discrepancies = 0 THEN 'healthy' WHEN discrepancies > threshold AND severity = 'critical' THEN 'failed' ELSE 'warning' END"


def _checks(spark, sf_dir):
    ev = V.events(spark, sf_dir)
    row = lambda df, name, limit, severity: df.select(F.lit(name).alias("check_key"), "discrepancies", F.lit(limit).alias("threshold"), F.lit(severity).alias("severity"))
    two = ev.groupBy("session_id").agg(F.countDistinct(F.to_date("ts")).alias("n")).agg(F.count_if(F.col("n") > 1).alias("discrepancies"))
    rows = row(two, "sessions_of_two_days", 0, "critical")
    rows = rows.unionByName(row(ev.agg(F.count_if(F.col("event_type") == "error").alias("discrepancies")), "errors", 5, "critical"))
    rows = rows.unionByName(row(ev.agg(F.count_if(F.col("source").isNull()).alias("discrepancies")), "direct", 1_000_000_000, "warning"))
    return Q.evaluated(rows, F.col("threshold"), F.col("severity"))


@query("c22_thresholds", over(f"SELECT check_key, discrepancies, {STATUS} AS status, CASE WHEN discrepancies = 0 THEN 'info' WHEN discrepancies > threshold THEN severity ELSE 'warning' END AS severity, discrepancies > 0 AND discrepancies > threshold AS alert FROM checks", CHECKS))
def c22(spark, sf_dir):
    return _checks(spark, sf_dir).select("check_key", "discrepancies", "status", "severity", "alert")


@query("a33_check_report", over(f"SELECT count(*) AS checks, count(*) FILTER (s = 'healthy') AS healthy, count(*) FILTER (s = 'failed') AS failed, CAST(sum(discrepancies) AS BIGINT) AS discrepancies FROM (SELECT *, {STATUS} AS s FROM checks)", CHECKS))
def a33(spark, sf_dir):
    return _checks(spark, sf_dir).agg(F.count("*").alias("checks"), F.count_if(F.col("status") == "healthy").alias("healthy"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("discrepancies").alias("discrepancies"))


@query("a17_duplicate_assignments", "SELECT key, CAST(len(vs) AS INTEGER) AS n, array_to_string(vs, ',') AS customers FROM (SELECT key, list_sort(list(DISTINCT v)) AS vs FROM (SELECT CAST(c_custkey % 50 AS VARCHAR) AS key, CAST(c_nationkey AS VARCHAR) AS v FROM customer UNION ALL SELECT CAST(o_custkey % 50 AS VARCHAR), o_orderstatus FROM orders) GROUP BY 1) WHERE len(vs) > 1")
def a17(spark, sf_dir):
    rows = V.table(spark, sf_dir, "customer").selectExpr("string(c_custkey % 50) as key", "string(c_nationkey) as v").union(V.table(spark, sf_dir, "orders").selectExpr("string(o_custkey % 50)", "o_orderstatus"))
    return Q.conflicting(rows, "key", "v").select("key", "n", F.array_join("values", ",").alias("customers"))


@query("a19_hash_anomalies", """SELECT check_key, CAST(count(*) AS BIGINT) AS invalid, array_to_string(list_slice(list_sort(list(DISTINCT v)), 1, 3), ',') AS samples FROM (
  SELECT 'customer' AS check_key, CASE WHEN c_custkey % 9 = 0 THEN 'bad' || CAST(c_nationkey AS VARCHAR) ELSE sha256(c_name) END AS v FROM customer UNION ALL
  SELECT 'supplier', CASE WHEN s_suppkey % 4 = 0 THEN upper(sha256(s_name)) ELSE sha256(s_name) END FROM supplier UNION ALL
  SELECT 'part', sha256(p_name) FROM part) WHERE NOT regexp_full_match(v, '[0-9a-f]{64}') GROUP BY 1""")
def a19(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit("bad"), F.col("c_nationkey").cast("string"))).otherwise(F.sha2("c_name", 256)).alias("h"))
    s = V.table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 4 == 0, F.upper(F.sha2("s_name", 256))).otherwise(F.sha2("s_name", 256)).alias("h"))
    p = V.table(spark, sf_dir, "part").select(F.sha2("p_name", 256).alias("h"))
    out = Q.hash_anomalies({"customer": (c, "h"), "supplier": (s, "h"), "part": (p, "h")})
    return out.select(F.col("check").alias("check_key"), "invalid", F.array_join("samples", ",").alias("samples"))


@query("a18_ordered_sample", "SELECT '[' || string_agg('{\"c_custkey\":' || CAST(c_custkey AS VARCHAR) || ',\"c_name\":\"' || c_name || '\"}', ',' ORDER BY c_custkey) || ']' AS sample FROM (SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 10)")
def a18(spark, sf_dir):
    return Q.ordered_sample(V.table(spark, sf_dir, "customer").where("c_acctbal < 0"), [F.col("c_custkey")], ["c_custkey", "c_name"], 10)


@query("j23_last_observed", over("SELECT s.session_id, epoch_us(greatest((SELECT max(ts) FROM ev e WHERE e.session_id = s.session_id AND e.event_type = 'click'), (SELECT max(ts) FROM ord o WHERE o.session_id = s.session_id), s.last_seen)) AS seen_us FROM sess s"))
def j23(spark, sf_dir):
    s, e = V.sessions(spark, sf_dir), V.events(spark, sf_dir).where("event_type = 'click'")
    return Q.last_observed(s, (e, "ts"), (V.orders(spark, sf_dir), "ts"), (s, "last_seen")).select("session_id", F.unix_micros(F.col("last_observed").cast("timestamp")).alias("seen_us"))


GHOSTS = "ghosts AS (SELECT session_id, first_seen FROM sess UNION ALL SELECT 'ghost:' || CAST(c_custkey AS VARCHAR), TIMESTAMP '2024-01-10' + CAST(c_custkey % 20 AS INTEGER) * INTERVAL 1 DAY FROM customer)"


@query("c23_orphan_sessions", over("SELECT count(*) AS discrepancies, (SELECT string_agg(session_id, ',' ORDER BY session_id) FROM (SELECT session_id FROM ghosts WHERE first_seen < TIMESTAMP '2024-01-21' AND session_id NOT IN (SELECT session_id FROM touch UNION SELECT session_id FROM ord) ORDER BY session_id LIMIT 10)) AS sample FROM ghosts WHERE first_seen < TIMESTAMP '2024-01-21' AND session_id NOT IN (SELECT session_id FROM touch UNION SELECT session_id FROM ord)", GHOSTS))
def c23_orphans(spark, sf_dir):
    ghosts = V.table(spark, sf_dir, "customer").select(F.concat(F.lit("ghost:"), F.col("c_custkey").cast("string")).alias("session_id"), (F.lit("2024-01-10 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((F.col("c_custkey") % 20).cast("int"))).alias("first_seen"))
    sessions = V.sessions(spark, sf_dir).select("session_id", "first_seen").union(ghosts)
    orphans = Q.orphan_sessions(sessions, "first_seen", F.lit("2024-01-21 00:00:00").cast("timestamp_ntz"), V.touches(spark, sf_dir), V.orders(spark, sf_dir))
    return Q.counted_sample(orphans, "session_id", 10)


@query("c23_conflicting_customers", over("SELECT key, CAST(n AS INTEGER) AS n, customers FROM (SELECT key, count(DISTINCT c) AS n, string_agg(DISTINCT c, ',' ORDER BY c) AS customers FROM (SELECT checkout_token AS key, CAST(user_id AS VARCHAR) AS c FROM ord WHERE order_id % 3 = 0 UNION ALL SELECT cart_token, CAST(user_id AS VARCHAR) FROM ord WHERE order_id % 3 = 1 UNION ALL SELECT session_id, CAST(user_id AS VARCHAR) FROM sess) GROUP BY 1) WHERE n > 1"))
def c23_customers(spark, sf_dir):
    orders, who = V.orders(spark, sf_dir), F.col("user_id").cast("string").alias("c")
    rows = orders.where("order_id % 3 = 0").select(F.col("checkout_token").alias("key"), who).union(orders.where("order_id % 3 = 1").select("cart_token", who)).union(V.sessions(spark, sf_dir).select("session_id", who))
    return Q.conflicting(rows, "key", "c").select("key", "n", F.array_join("values", ",").alias("customers"))


HASHED = {"customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name"), "part": ("p_partkey", "p_name"), "nation": ("n_nationkey", "n_name"), "region": ("r_regionkey", "r_name"), "orders": ("o_orderkey", "o_orderpriority"), "lineitem": ("l_orderkey", "l_linestatus")}
BRANCHES = " UNION ALL ".join(f"SELECT '{t}' AS check_key, CASE {k} % 6 WHEN 0 THEN 'x' || {v} WHEN 1 THEN upper(sha256({v})) ELSE sha256({v}) END AS v FROM {t}" for t, (k, v) in HASHED.items())


@query("u06_hash_branches", f"SELECT check_key, count(*) AS invalid, array_to_string(list_slice(list_sort(list(DISTINCT v)), 1, 3), ',') AS samples FROM ({BRANCHES}) WHERE NOT regexp_full_match(v, '[0-9a-f]{{64}}') GROUP BY 1")
def u06(spark, sf_dir):
    def branch(name):
        key, value = HASHED[name]
        hashed = F.sha2(value, 256)
        return V.table(spark, sf_dir, name).select(F.when(F.col(key) % 6 == 0, F.concat(F.lit("x"), value)).when(F.col(key) % 6 == 1, F.upper(hashed)).otherwise(hashed).alias("h")), "h"

    return Q.hash_anomalies({name: branch(name) for name in HASHED}).select(F.col("check").alias("check_key"), "invalid", F.array_join("samples", ",").alias("samples"))


@query("u10_hour_lists", over("SELECT user_id, string_agg(h, ',' ORDER BY h) AS hours FROM (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d %H') AS h FROM ev WHERE event_type = 'error') GROUP BY 1"))
def u10(spark, sf_dir):
    errors = V.events(spark, sf_dir).where("event_type = 'error'").select("user_id", F.date_format("ts", "yyyy-MM-dd HH").alias("h"))
    return errors.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("h")), ",").alias("hours"))


RETAIN = "links AS (SELECT DISTINCT session_id FROM ord WHERE cents > 3000), tg AS (SELECT event_id, session_id FROM touch WHERE ts < TIMESTAMP '2024-01-15' AND session_id NOT IN (SELECT session_id FROM links)), sg AS (SELECT session_id FROM sess s WHERE last_seen < TIMESTAMP '2024-01-15' AND session_id NOT IN (SELECT session_id FROM links) AND NOT EXISTS (SELECT 1 FROM touch t WHERE t.session_id = s.session_id AND t.event_id NOT IN (SELECT event_id FROM tg)))"


def _sweep(spark, sf_dir):
    touches = V.touches(spark, sf_dir).withColumn("retained_until", F.col("ts"))
    sessions = V.sessions(spark, sf_dir).withColumn("retained_until", F.col("last_seen"))
    return Q.retention_sweep(touches, sessions, V.orders(spark, sf_dir).where("cents > 3000"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


@query("j11_expired_touches", over("SELECT event_id FROM tg", RETAIN))
def j11(spark, sf_dir):
    return _sweep(spark, sf_dir)[0].select("event_id")


@query("c24_expired_sessions", over("SELECT session_id FROM sg", RETAIN))
def c24(spark, sf_dir):
    return _sweep(spark, sf_dir)[1].select("session_id")


@query("a24_protected_rows", over("SELECT (SELECT count(*) FROM touch WHERE session_id IN (SELECT session_id FROM links) AND ts < TIMESTAMP '2024-01-15') AS touches, (SELECT count(*) FROM sess WHERE session_id IN (SELECT session_id FROM links) AND last_seen < TIMESTAMP '2024-01-15') AS sessions", RETAIN))
def a24(spark, sf_dir):
    linked = V.orders(spark, sf_dir).where("cents > 3000").select("session_id").distinct()
    count = lambda df, ts, name: df.where(F.col(ts) < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).join(linked, "session_id", "left_semi").agg(F.count("*").alias(name))
    return count(V.touches(spark, sf_dir), "ts", "touches").join(F.broadcast(count(V.sessions(spark, sf_dir), "last_seen", "sessions")))


@query("a23_completeness", over_credits("SELECT count(*) AS total, count(*) FILTER (missing) AS missing, count(*) FILTER (NOT missing) AS with_attribution, CAST(count(*) FILTER (NOT missing) AS DOUBLE) / count(*) AS rate FROM (SELECT o.order_id, r.order_id IS NULL OR (r.session_id IS NULL AND r.source IS NULL AND r.medium IS NULL AND r.campaign IS NULL AND r.click_value IS NULL) AS missing FROM ord o LEFT JOIN cart r USING (order_id) WHERE o.source_name = 'web' AND o.ts >= TIMESTAMP '2024-01-05' AND o.ts <= TIMESTAMP '2024-01-25')"))
def a23(spark, sf_dir):
    orders = V.orders(spark, sf_dir)
    scope = orders.where("source_name = 'web' and ts between timestamp_ntz '2024-01-05 00:00:00' and timestamp_ntz '2024-01-25 00:00:00'")
    return Q.completeness(scope, A.latest_by_token(orders, V.touches(spark, sf_dir, dealt=True), "cart_token"))


JOBS = "jobs AS (SELECT 'order:' || CAST(o_orderkey AS VARCHAR) AS queue_key, 'seed' AS reason, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' ELSE 'completed' END AS status, CAST(o_orderkey % 5 AS INTEGER) AS attempts, o_orderdate AS available_at, o_orderdate + INTERVAL 1 HOUR AS locked_at, o_orderkey FROM orders)"


def _jobs(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "processing").otherwise("completed")
    return V.table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("queue_key"), F.lit("seed").alias("reason"), status.alias("status"), (F.col("o_orderkey") % 5).cast("int").alias("attempts"), F.col("o_orderdate").alias("available_at"), (F.col("o_orderdate") + F.expr("interval 1 hour")).alias("locked_at"), "o_orderkey")


@query("a36_queue_backlog", f"WITH {JOBS} SELECT count(*) FILTER (status = 'pending') AS pending, CAST(coalesce(max(date_diff('second', available_at, TIMESTAMP '{NOW}')) FILTER (status = 'pending'), 0) AS BIGINT) AS oldest_seconds, count(*) FILTER (status = 'processing' AND date_diff('second', locked_at, TIMESTAMP '{NOW}') > 900) AS stale FROM jobs")
def a36(spark, sf_dir):
    return Q.backlog(_jobs(spark, sf_dir), _now(), 900)


@query("k07_enqueue", f"WITH {JOBS}, asked AS (SELECT 'order:' || CAST(l_orderkey AS VARCHAR) AS queue_key, arg_max('r' || CAST(l_linenumber AS VARCHAR), l_linenumber) AS reason FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT coalesce(j.queue_key, a.queue_key) AS queue_key, coalesce(a.reason, j.reason) AS reason, CASE WHEN a.queue_key IS NOT NULL AND coalesce(j.status, '') <> 'processing' THEN 'pending' ELSE j.status END AS status, epoch_us(CASE WHEN a.queue_key IS NOT NULL AND coalesce(j.status, '') <> 'processing' THEN TIMESTAMP '{NOW}' ELSE j.available_at END) AS available_us FROM (SELECT * FROM jobs WHERE o_orderkey % 3 <> 0) j FULL OUTER JOIN asked a ON a.queue_key = j.queue_key")
def k07(spark, sf_dir):
    asked = V.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("queue_key"), F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("reason"), F.col("l_linenumber").alias("ordinal"))
    out = Q.enqueue(_jobs(spark, sf_dir).where("o_orderkey % 3 <> 0"), asked, _now())
    return out.select("queue_key", "reason", "status", F.unix_micros(F.col("available_at").cast("timestamp")).alias("available_us"))


@query("k07_settle", f"WITH {JOBS}, r AS (SELECT *, o_orderkey % 2 = 0 AS ok, attempts + 1 AS tries FROM jobs WHERE status = 'processing') SELECT queue_key, CASE WHEN ok THEN 'completed' WHEN tries >= 5 THEN 'dead_letter' ELSE 'pending' END AS status, tries AS attempts, epoch_us(CASE WHEN NOT ok AND tries < 5 THEN TIMESTAMP '{NOW}' + to_seconds(CAST(least(30 * pow(2, tries - 1), 200) AS BIGINT)) ELSE available_at END) AS available_us FROM r")
def k07_settle(spark, sf_dir):
    jobs = _jobs(spark, sf_dir).where("status = 'processing'")
    out = Q.settled(jobs, jobs.select("queue_key", (F.col("o_orderkey") % 2 == 0).alias("ok")), _now(), 30, 200, 5)
    return out.select("queue_key", "status", "attempts", F.unix_micros(F.col("available_at").cast("timestamp")).alias("available_us"))


@query("k08_dead_letters", over("SELECT CAST(user_id AS VARCHAR) AS identity, count(*) AS failures, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, arg_max('e' || CAST(k AS VARCHAR), (ts, 'e' || CAST(k AS VARCHAR))) AS last_error FROM ev WHERE event_type = 'error' GROUP BY 1"))
def k08(spark, sf_dir):
    rows = V.events(spark, sf_dir).where("event_type = 'error'").select(F.col("user_id").cast("string").alias("identity"), F.col("ts").alias("at"), F.concat(F.lit("e"), F.col("k").cast("string")).alias("error"))
    early = F.col("at") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    none = rows.limit(0).select("identity", F.lit(0).cast("long").alias("failures"), F.col("at").alias("first_failed"), F.col("at").alias("last_failed"), F.col("error").alias("last_error"))
    out = Q.dead_letters(Q.dead_letters(none, rows.where(early)), rows.where(~early))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.select("identity", "failures", us("first_failed").alias("first_us"), us("last_failed").alias("last_us"), "last_error")


@query("t07_claim_batch", f"WITH {JOBS} SELECT queue_key FROM jobs WHERE status = 'pending' ORDER BY available_at, o_orderkey LIMIT 50")
def t07(spark, sf_dir):
    return _jobs(spark, sf_dir).where("status = 'pending'").orderBy("available_at", "o_orderkey").limit(50).select("queue_key")


@query("a34_percentiles", "SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events")
def a34(spark, sf_dir):
    return Q.nearest_rank(V.table(spark, sf_dir, "events"), "value", [0.5, 0.95])
