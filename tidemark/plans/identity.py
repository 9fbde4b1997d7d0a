"""Queries on identity and fallback candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ga4 as G
from tidemark.operators import identity as I
from tidemark.plans.base_sql import over
from tidemark.plans.registry import query
from tidemark.sources import views as V

NODES = """
rec AS (SELECT event_id AS record_id, ts AS seen_at, event_type AS source, user_id, session_id AS visit, CASE WHEN k % 4 = 0 AND user_id % 5 <> 0 THEN CAST(user_id AS VARCHAR) END AS customer_id, CASE WHEN k % 3 = 0 THEN sha256(CAST(user_id % 60 AS VARCHAR)) END AS email_hash, CASE WHEN k % 5 = 0 AND user_id % 3 > 0 THEN 'p' || CAST(user_id AS VARCHAR) END AS phone_hash,
  CASE WHEN k % 50 = 9 THEN 't' || CAST(event_id % 300 AS VARCHAR) WHEN k % 10 < 2 THEN 't' || CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 4 AS VARCHAR) END AS checkout_token, CASE WHEN k % 6 > 0 THEN session_id END AS session_id FROM ev WHERE event_type <> 'error'),
nod AS (SELECT record_id, seen_at, 'customer_id' AS node_type, customer_id AS node_key, 100 AS precedence FROM rec WHERE customer_id IS NOT NULL UNION ALL SELECT record_id, seen_at, 'email_hash', email_hash, 70 FROM rec WHERE email_hash IS NOT NULL
  UNION ALL SELECT record_id, seen_at, 'phone_hash', phone_hash, 60 FROM rec WHERE phone_hash IS NOT NULL UNION ALL SELECT record_id, seen_at, 'checkout_token', checkout_token, 40 FROM rec WHERE checkout_token IS NOT NULL UNION ALL SELECT record_id, seen_at, 'session_id', session_id, 20 FROM rec WHERE session_id IS NOT NULL),
shown AS (SELECT n.node_type, n.node_key, min(r.customer_id) AS owner, count(DISTINCT r.customer_id) AS owners FROM nod n JOIN rec r USING (record_id) WHERE n.node_type <> 'customer_id' AND r.customer_id IS NOT NULL GROUP BY 1, 2),
usable AS (SELECT n.record_id, n.node_type, n.node_key, n.precedence, s.owner FROM nod n LEFT JOIN shown s USING (node_type, node_key) WHERE n.node_type <> 'customer_id' AND coalesce(s.owners, 0) < 2),
near AS (SELECT a.record_id AS x, b.record_id AS y FROM usable a JOIN (SELECT node_type, node_key, min(record_id) AS record_id FROM usable GROUP BY 1, 2) b USING (node_type, node_key)),
both_ways AS (SELECT x, y FROM near UNION SELECT y, x FROM near),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
part AS (SELECT d.record_id, r.seen_at, r.customer_id, coalesce(c.component, d.record_id) AS component FROM (SELECT DISTINCT record_id FROM nod) d JOIN rec r USING (record_id) LEFT JOIN (SELECT x AS record_id, min(y) AS component FROM reach GROUP BY 1) c USING (record_id)),
own AS (SELECT record_id, arg_max(owner, (precedence, node_key)) AS owner FROM usable WHERE owner IS NOT NULL GROUP BY 1),
owners AS (SELECT component, min(customer_id) AS least, max(customer_id) AS most FROM part GROUP BY 1),
named AS (SELECT component, arg_max(node_type || ':' || node_key, (precedence, node_key, node_type)) AS name FROM part JOIN usable USING (record_id) GROUP BY 1),
asg AS (SELECT p.record_id, p.seen_at, CASE WHEN coalesce(p.customer_id, o.owner, CASE WHEN w.least = w.most THEN w.least END) IS NOT NULL THEN 'customer:' || coalesce(p.customer_id, o.owner, w.least) WHEN w.least <> w.most THEN 'conflict:' || CAST(component AS VARCHAR) ELSE n.name END AS journey,
  CASE WHEN p.customer_id IS NOT NULL THEN 'customer_id' WHEN o.owner IS NOT NULL THEN 'owned_key' WHEN w.least = w.most THEN 'chain' WHEN w.least <> w.most THEN 'conflict' WHEN n.name IS NOT NULL THEN 'founded' ELSE 'none' END AS by_kind
  FROM part p LEFT JOIN own o USING (record_id) LEFT JOIN owners w USING (component) LEFT JOIN named n USING (component))
"""


def _us(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def records(spark, sf_dir):
    k, user, event = F.col("k"), F.col("user_id"), F.col("event_id")
    token = F.when(k % 50 == 9, F.concat(F.lit("t"), (event % 300).cast("string"))).when(k % 10 < 2, F.concat(F.lit("t"), user.cast("string"), F.lit("-"), (event % 4).cast("string")))
    return V.events(spark, sf_dir).where("event_type <> 'error'").select(
        event.alias("record_id"), F.col("ts").alias("at"), F.col("event_type").alias("source"), "user_id", F.col("session_id").alias("visit"), F.when((k % 4 == 0) & (user % 5 != 0), user.cast("string")).alias("customer_id"),
        F.when(k % 3 == 0, F.sha2((user % 60).cast("string"), 256)).alias("email_hash"), F.when((k % 5 == 0) & (user % 3 > 0), F.concat(F.lit("p"), user.cast("string"))).alias("phone_hash"),
        token.alias("checkout_token"), F.when(k % 6 > 0, F.col("session_id")).alias("session_id"),
    )


def found(spark, sf_dir):
    return I.nodes(records(spark, sf_dir))


@query("f53_identity_nodes", over("SELECT record_id, node_type, node_key, CAST(precedence AS INTEGER) AS precedence FROM nod", NODES))
def f53(spark, sf_dir):
    return found(spark, sf_dir).select("record_id", "node_type", "node_key", "precedence")


@query("c15_quarantined_keys", over("SELECT node_type, node_key, owners FROM shown WHERE owners > 1 AND node_type IN ('email_hash', 'phone_hash')", NODES))
def c15_quarantined(spark, sf_dir):
    return I.quarantined(found(spark, sf_dir))


@query("c15_identity_journeys", over("SELECT record_id, journey, by_kind FROM asg", NODES))
def c15(spark, sf_dir):
    return I.assigned(found(spark, sf_dir)).withColumnRenamed("by", "by_kind")


@query("k06_node_ranges", over("SELECT node_type, node_key, epoch_us(min(seen_at)) AS first_us, epoch_us(max(seen_at)) AS last_us, count(*) AS seen FROM nod GROUP BY 1, 2", NODES))
def k06(spark, sf_dir):
    return I.node_ranges(found(spark, sf_dir)).select("node_type", "node_key", _us("first_at").alias("first_us"), _us("last_at").alias("last_us"), "seen")


@query("w14_best_journeys", over("SELECT node_type, node_key, journey FROM (SELECT *, row_number() OVER (PARTITION BY node_type, node_key ORDER BY rank DESC, last_at DESC, journey) AS rn FROM (SELECT n.node_type, n.node_key, a.journey, max(n.precedence) AS rank, max(n.seen_at) AS last_at FROM nod n JOIN asg a USING (record_id) WHERE a.journey IS NOT NULL GROUP BY 1, 2, 3)) WHERE rn = 1", NODES))
def w14(spark, sf_dir):
    rows = found(spark, sf_dir)
    return I.best_journeys(rows, I.assigned(rows)).select("node_type", "node_key", "journey")


STITCH = """WITH ids AS (SELECT c_custkey AS identity_id, 'e' || CAST(c_custkey AS VARCHAR) AS email_hash, CASE WHEN c_custkey % 2 = 0 THEN 'c' || CAST(c_custkey AS VARCHAR) END AS customer_id FROM customer),
inc AS (SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 5 <> 0 THEN 'e' || CAST(o_custkey + o_orderkey % 3 * 5000 AS VARCHAR) END AS email_hash, CASE WHEN o_orderkey % 7 < 3 THEN 'c' || CAST(o_custkey + o_orderkey % 2 AS VARCHAR) END AS customer_id FROM orders)
SELECT i.record_id, CASE WHEN i.email_hash IS NULL AND i.customer_id IS NULL THEN 'skipped' WHEN e.identity_id <> c.identity_id THEN 'conflict_two_identities' WHEN e.customer_id <> i.customer_id THEN 'conflict_customer'
  WHEN c.email_hash <> i.email_hash THEN 'conflict_email' WHEN e.identity_id IS NOT NULL OR c.identity_id IS NOT NULL THEN 'reuse' ELSE 'create' END AS decision, coalesce(c.identity_id, e.identity_id) AS identity_id
FROM inc i LEFT JOIN ids e ON i.email_hash = e.email_hash LEFT JOIN ids c ON i.customer_id = c.customer_id"""


@query("c16_stitch_decisions", STITCH)
def c16(spark, sf_dir):
    ids = V.table(spark, sf_dir, "customer").selectExpr("c_custkey as identity_id", "concat('e', c_custkey) as email_hash", "case when c_custkey % 2 = 0 then concat('c', c_custkey) end as customer_id")
    incoming = V.table(spark, sf_dir, "orders").selectExpr("o_orderkey as record_id", "case when o_orderkey % 5 <> 0 then concat('e', o_custkey + o_orderkey % 3 * 5000) end as email_hash", "case when o_orderkey % 7 < 3 then concat('c', o_custkey + o_orderkey % 2) end as customer_id")
    return I.stitch(ids, incoming)


@query("c16b_identity_upserts", STITCH.replace("SELECT i.record_id, CASE", ", st AS (SELECT i.record_id, i.email_hash, i.customer_id, CASE", 1) + """),
ok AS (SELECT *, CASE WHEN decision = 'create' THEN coalesce('e' || email_hash, 'c' || customer_id) END AS k FROM st WHERE decision IN ('reuse', 'create')),
tgt AS (SELECT ok.*, coalesce(identity_id, -min(record_id) OVER (PARTITION BY k)) AS target FROM ok),
fnd AS (SELECT target, arg_min(email_hash, record_id) AS email_hash, arg_min(customer_id, record_id) FILTER (customer_id NOT IN (SELECT customer_id FROM ids WHERE customer_id IS NOT NULL AND identity_id <> target)) AS customer_id FROM tgt GROUP BY 1)
SELECT coalesce(i.identity_id, f.target) AS identity_id, coalesce(i.email_hash, f.email_hash) AS email_hash, coalesce(i.customer_id, f.customer_id) AS customer_id FROM ids i FULL OUTER JOIN fnd f ON i.identity_id = f.target""")
def c16b(spark, sf_dir):
    ids = V.table(spark, sf_dir, "customer").selectExpr("c_custkey as identity_id", "concat('e', c_custkey) as email_hash", "case when c_custkey % 2 = 0 then concat('c', c_custkey) end as customer_id")
    incoming = V.table(spark, sf_dir, "orders").selectExpr("o_orderkey as record_id", "case when o_orderkey % 5 <> 0 then concat('e', o_custkey + o_orderkey % 3 * 5000) end as email_hash", "case when o_orderkey % 7 < 3 then concat('c', o_custkey + o_orderkey % 2) end as customer_id")
    return I.upserted(ids, incoming)


CANDIDATES = """
raw AS (SELECT 's' || CAST(event_id % 700 AS VARCHAR) AS candidate_key, CAST(ts AS DATE) AS day, event_id AS ordinal, source, medium, campaign, content, term, click_type, click_value, time_bucket(INTERVAL 1 HOUR, ts) AS export_hour,
  CASE WHEN k % 2 = 0 THEN 'events' ELSE 'intraday' END AS table_type, CASE WHEN k % 3 > 0 THEN CAST(user_id AS VARCHAR) END AS client_key, CASE WHEN k % 4 = 1 THEN 'x' || CAST(event_id % 90 AS VARCHAR) END AS transaction_key, 'g' || CAST(event_id % 700 AS VARCHAR) AS session_key,
  k % 6 <> 4 AS required, ts + INTERVAL 35 DAY AS retained_until FROM ev WHERE event_type IN ('view', 'click', 'signup')),
dimmed AS (SELECT *, (source IS NOT NULL)::INT + (medium IS NOT NULL)::INT + (campaign IS NOT NULL)::INT + (content IS NOT NULL)::INT + (term IS NOT NULL)::INT AS dims FROM raw),
bun AS (SELECT *, row_number() OVER (PARTITION BY candidate_key, day ORDER BY (dims > 0 OR click_value IS NOT NULL) DESC, click_value IS NOT NULL DESC, dims DESC, export_hour DESC, table_type = 'events' DESC, ordinal) AS rn FROM dimmed),
mrg AS (SELECT b.candidate_key, b.day, b.source, b.medium, b.campaign, b.content, b.term, b.click_type, b.click_value, b.export_hour, b.table_type, s.client_key, s.transaction_key, s.session_key, s.required, s.retained_until, b.dims
  FROM bun b JOIN (SELECT candidate_key, day, arg_max(client_key, ordinal) AS client_key, arg_max(transaction_key, ordinal) AS transaction_key, arg_max(session_key, ordinal) AS session_key, bool_or(required) AS required, max(retained_until) AS retained_until FROM raw GROUP BY 1, 2) s USING (candidate_key, day) WHERE b.rn = 1),
asks AS (SELECT order_id AS ask_id, ts AS asked_at, CAST(user_id AS VARCHAR) AS client_key, 'x' || CAST(order_id % 90 AS VARCHAR) AS transaction_key, 'g' || CAST(order_id % 700 AS VARCHAR) AS session_key FROM ord),
hit AS (SELECT a.ask_id, a.asked_at, m.*, CAST(m.day AS TIMESTAMP) AS occurred_at, 'client_key' AS match_kind FROM asks a JOIN mrg m ON a.client_key = m.client_key UNION ALL SELECT a.ask_id, a.asked_at, m.*, CAST(m.day AS TIMESTAMP), 'transaction_key' FROM asks a JOIN mrg m ON a.transaction_key = m.transaction_key
  UNION ALL SELECT a.ask_id, a.asked_at, m.*, CAST(m.day AS TIMESTAMP), 'session_key' FROM asks a JOIN mrg m ON a.session_key = m.session_key),
lim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ask_id, match_kind ORDER BY occurred_at DESC, candidate_key) AS r FROM hit WHERE occurred_at <= asked_at AND occurred_at >= asked_at - INTERVAL 7 DAY AND required AND (dims > 0 OR click_value IS NOT NULL)) WHERE r <= 25),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ask_id, candidate_key, occurred_at ORDER BY match_kind) AS r2 FROM lim) WHERE r2 = 1),
plc AS (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY occurred_at DESC, click_value IS NOT NULL DESC, export_hour DESC, table_type = 'events' DESC, dims DESC, session_key ASC NULLS LAST, client_key ASC NULLS LAST, transaction_key ASC NULLS LAST, candidate_key) AS place FROM one)
"""


def merged(spark, sf_dir):
    k, e = F.col("k"), F.col("event_id")
    text = lambda letter, n: F.concat(F.lit(letter), (e % n).cast("string"))
    rows = V.touches(spark, sf_dir).select(
        text("s", 700).alias("candidate_key"), F.to_date("ts").alias("day"), e.alias("ordinal"), *G.DIMENSIONS, "click_type", "click_value", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("export_hour"),
        F.when(k % 2 == 0, "events").otherwise("intraday").alias("table_type"), F.when(k % 3 > 0, F.col("user_id").cast("string")).alias("client_key"), F.when(k % 4 == 1, text("x", 90)).alias("transaction_key"),
        text("g", 700).alias("session_key"), (k % 6 != 4).alias("required"), (F.col("ts") + F.expr("interval 35 days")).alias("retained_until"),
    )
    return G.merge_candidates(rows, ["candidate_key", "day"], ["client_key", "transaction_key", "session_key"])


@query("c30_merged_candidates", over("SELECT candidate_key, CAST(day AS VARCHAR) AS day, source, medium, campaign, click_value, table_type, epoch_us(export_hour) AS export_us, client_key, transaction_key, required, epoch_us(retained_until) AS retained_us FROM mrg", CANDIDATES))
def c30(spark, sf_dir):
    return merged(spark, sf_dir).select("candidate_key", F.col("day").cast("string").alias("day"), "source", "medium", "campaign", "click_value", "table_type", _us("export_hour").alias("export_us"), "client_key", "transaction_key", "required", _us("retained_until").alias("retained_us"))


@query("c31_candidate_lookup", over("SELECT ask_id, candidate_key, epoch_us(occurred_at) AS occurred_us, match_kind, CAST(place AS INTEGER) AS place FROM plc", CANDIDATES))
def c31(spark, sf_dir):
    key = lambda letter, n: F.concat(F.lit(letter), (F.col("order_id") % n).cast("string"))
    asks = V.orders(spark, sf_dir).select(F.col("order_id").alias("ask_id"), F.col("ts").alias("asked_at"), F.col("user_id").cast("string").alias("client_key"), key("x", 90).alias("transaction_key"), key("g", 700).alias("session_key"))
    rows = merged(spark, sf_dir).withColumn("occurred_at", F.col("day").cast("timestamp_ntz"))
    return G.lookup(asks, rows, ["client_key", "transaction_key", "session_key"]).select("ask_id", "candidate_key", _us("occurred_at").alias("occurred_us"), "match_kind", "place")


@query("c28_planned_hours", over("SELECT user_id, epoch_us(h) AS hour_us FROM (SELECT user_id, unnest(generate_series(CASE WHEN user_id % 3 > 0 THEN time_bucket(INTERVAL 1 HOUR, mark) - INTERVAL 2 HOUR ELSE TIMESTAMP '2024-01-30 22:00:00' - INTERVAL 5 HOUR END, TIMESTAMP '2024-01-30 22:00:00', INTERVAL 1 HOUR)) AS h FROM (SELECT user_id, max(ts) AS mark FROM ev GROUP BY 1))"))
def c28(spark, sf_dir):
    marks = V.events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("mark")).select("user_id", F.when(F.col("user_id") % 3 > 0, F.col("mark")).alias("mark"), F.lit("2024-01-30 23:40:00").cast("timestamp_ntz").alias("now"))
    return G.planned_hours(marks, "now", "mark", 6, 3).select("user_id", F.unix_micros(F.col("hour").cast("timestamp")).alias("hour_us"))


@query("s12_event_parameters", over("SELECT event_id, key, param FROM (SELECT event_id, unnest(['session', 'value', 'none']) AS key, unnest([session_id, CAST(k AS VARCHAR), NULL]) AS param FROM ev WHERE k % 5 <> 0 UNION ALL SELECT event_id, NULL, NULL FROM ev WHERE k % 5 = 0)"))
def s12(spark, sf_dir):
    value = lambda key, s, i: f"named_struct('key', '{key}', 'string_value', {s}, 'int_value', cast({i} as bigint), 'float_value', cast(null as float), 'double_value', cast(null as double))"
    params = f"case when k % 5 <> 0 then array({value('session', 'session_id', 'k')}, {value('value', 'cast(null as string)', 'k')}, {value('none', 'cast(null as string)', 'null')}) else array() end"
    return G.parameters(V.events(spark, sf_dir).select("event_id", F.expr(params).alias("event_params"))).select("event_id", "key", "param")
