"""Queries on the identity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import identity as I
from tidemark.operators import quality as Q
from tidemark.plans.base_sql import over
from tidemark.plans.identity import NODES, found, records
from tidemark.plans.registry import query
from tidemark.sources import payloads as P
from tidemark.sources import views as V
from tidemark.storage import stage

EDGES = """
bestj AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_type, node_key ORDER BY rank DESC, last_at DESC, journey) AS rn FROM (SELECT n.node_type, n.node_key, a.journey, max(n.precedence) AS rank, max(n.seen_at) AS last_at FROM nod n JOIN asg a USING (record_id) WHERE a.journey IS NOT NULL GROUP BY 1, 2, 3)) WHERE rn = 1),
edg AS (SELECT e.*, CASE WHEN s.owners > 1 THEN 'quarantined' WHEN b.journey <> e.journey THEN 'other_journey' END AS code
  FROM (SELECT a.journey, n.node_type, n.node_key, max(n.precedence) AS precedence, min(n.seen_at) AS first_at, max(n.seen_at) AS last_at, count(*) AS seen FROM nod n JOIN asg a USING (record_id) WHERE a.journey IS NOT NULL GROUP BY 1, 2, 3) e
  LEFT JOIN shown s USING (node_type, node_key) LEFT JOIN bestj b USING (node_type, node_key))
"""
RUNS = """
per AS (SELECT n.record_id, count(*) FILTER (e.code = 'other_journey') AS rehomed, count(*) FILTER (e.code = 'quarantined') AS quarantined FROM nod n JOIN asg a USING (record_id) LEFT JOIN edg e ON e.journey = a.journey AND e.node_type = n.node_type AND e.node_key = n.node_key GROUP BY 1),
runs AS (SELECT r.record_id, r.seen_at, r.source, CASE WHEN a.by_kind = 'conflict' THEN 'conflicted' ELSE 'completed' END AS status, CASE WHEN p.record_id IS NULL THEN 'missing_identifiers' WHEN a.by_kind = 'conflict' THEN 'several_customers' ELSE 'linked' END AS reason,
  coalesce(p.rehomed, 0) AS rehomed, coalesce(p.quarantined, 0) AS quarantined FROM rec r LEFT JOIN per p USING (record_id) LEFT JOIN asg a USING (record_id))
"""
COUNTS = "count(*) AS total, count(*) FILTER (status = 'completed' AND reason <> 'missing_identifiers') AS linked, count(*) FILTER (reason = 'missing_identifiers') AS skipped, count(*) FILTER (status = 'conflicted') AS conflicted, count(*) FILTER (rehomed > 0) AS merges, CAST(coalesce(sum(rehomed), 0) AS BIGINT) AS rehomed, CAST(coalesce(sum(quarantined), 0) AS BIGINT) AS quarantined"


def _us(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def _graph(spark, sf_dir):
    rows = stage(found(spark, sf_dir), "nodes")
    journeys = stage(I.assigned(rows), "journeys")
    return rows, journeys, I.edges(rows, journeys)


def _runs(spark, sf_dir):
    rows, journeys, edged = _graph(spark, sf_dir)
    return I.runs(rows, records(spark, sf_dir), journeys, edged)


@query("c15_identity_edges", over("SELECT journey, node_type, node_key, CAST(precedence AS INTEGER) AS precedence, epoch_us(first_at) AS first_us, epoch_us(last_at) AS last_us, seen, code IS NULL AS is_active, code AS conflict_code FROM edg", NODES, EDGES))
def c15_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[2].select("journey", "node_type", "node_key", "precedence", _us("first_at").alias("first_us"), _us("last_at").alias("last_us"), "seen", "is_active", "conflict_code")


@query("t13_edge_listing", over("SELECT journey, string_agg(node_type || '=' || node_key, ',' ORDER BY code IS NULL DESC, precedence DESC, node_type, node_key, first_at) AS listing FROM edg GROUP BY 1", NODES, EDGES))
def t13(spark, sf_dir):
    edged = _graph(spark, sf_dir)[2]
    place = F.struct((~F.col("is_active")).alias("a"), (-F.col("precedence")).alias("b"), "node_type", "node_key")
    rows = edged.groupBy("journey").agg(F.array_sort(F.collect_list(place)).alias("l"))
    return rows.select("journey", F.array_join(F.transform("l", lambda x: F.concat(x["node_type"], F.lit("="), x["node_key"])), ",").alias("listing"))


@query("j19_journey_of_key", over("SELECT journey, node_type, node_key FROM edg WHERE code IS NULL AND node_type = 'phone_hash' AND node_key = (SELECT min(node_key) FROM edg WHERE code IS NULL AND node_type = 'phone_hash') ORDER BY journey LIMIT 1", NODES, EDGES))
def j19(spark, sf_dir):
    edged = _graph(spark, sf_dir)[2]
    key = edged.where("is_active and node_type = 'phone_hash'").agg(F.min("node_key")).first()[0]
    return I.find_journey(edged, "phone_hash", key)


@query("j20_conflicts", over("SELECT journey, node_type, node_key, code AS conflict_code FROM edg WHERE code IS NOT NULL AND last_at >= TIMESTAMP '2024-01-10' AND last_at < TIMESTAMP '2024-01-26' ORDER BY last_at DESC, journey, node_type, node_key LIMIT 50", NODES, EDGES))
def j20(spark, sf_dir):
    at = lambda d: F.lit(f"{d} 00:00:00").cast("timestamp_ntz")
    return I.conflicts(_graph(spark, sf_dir)[2], at("2024-01-10"), at("2024-01-26"), 50).select("journey", "node_type", "node_key", "conflict_code")


@query("j21_node_candidates", over("SELECT n.node_type, n.node_key, e.journey, CAST(e.precedence AS INTEGER) AS rank FROM (SELECT DISTINCT node_type, node_key FROM nod) n LEFT JOIN edg e ON e.node_type = n.node_type AND e.node_key = n.node_key AND e.code IS NULL", NODES, EDGES))
def j21(spark, sf_dir):
    rows, _, edged = _graph(spark, sf_dir)
    return I.node_candidates(rows, edged).select("node_type", "node_key", "journey", "rank")


@query("p20_composite_keys", over("SELECT record_id, node_type, node_key FROM nod WHERE (node_type, node_key) IN (SELECT node_type, node_key FROM edg WHERE code = 'other_journey')", NODES, EDGES))
def p20(spark, sf_dir):
    rows, _, edged = _graph(spark, sf_dir)
    return rows.join(edged.where("conflict_code = 'other_journey'").select("node_type", "node_key"), ["node_type", "node_key"], "left_semi").select("record_id", "node_type", "node_key")


@query("a13_identity_health", over(f"SELECT {COUNTS}, (SELECT count(*) FROM edg WHERE code IS NOT NULL) AS unresolved FROM runs", NODES, EDGES, RUNS))
def a13(spark, sf_dir):
    rows, journeys, edged = _graph(spark, sf_dir)
    whole = I.health(I.runs(rows, records(spark, sf_dir), journeys, edged))
    return whole.join(F.broadcast(edged.agg(F.count_if(F.col("conflict_code").isNotNull()).alias("unresolved"))))


@query("a14_identity_health_by_day", over(f"SELECT CAST(CAST(seen_at AS DATE) AS VARCHAR) AS day, {COUNTS} FROM runs WHERE seen_at >= TIMESTAMP '2024-01-05' AND seen_at < TIMESTAMP '2024-01-21' GROUP BY 1", NODES, EDGES, RUNS))
def a14(spark, sf_dir):
    rows = _runs(spark, sf_dir).where("at >= timestamp_ntz '2024-01-05 00:00:00' and at < timestamp_ntz '2024-01-21 00:00:00'")
    return I.health(rows, F.to_date("at").cast("string").alias("day")).orderBy("day")


LINKED = """linked AS (SELECT DISTINCT r.visit AS session_id FROM rec r JOIN asg a USING (record_id) WHERE a.journey IS NOT NULL)"""


def _visits(spark, sf_dir, journeys=None):
    """session_id, journey: a session's journey is the smallest of its records'."""
    journeys = (I.assigned(found(spark, sf_dir)) if journeys is None else journeys).where("journey is not null")
    return records(spark, sf_dir).join(journeys, "record_id").groupBy(F.col("visit").alias("session_id")).agg(F.min("journey").alias("journey"))


@query("a15_linked_sessions", over("SELECT count(*) FILTER (l.session_id IS NOT NULL) AS linked, count(*) FILTER (l.session_id IS NULL) AS unlinked FROM sess s LEFT JOIN linked l USING (session_id) WHERE s.first_seen >= TIMESTAMP '2024-01-03' AND s.first_seen < TIMESTAMP '2024-01-25'", NODES, LINKED))
def a15(spark, sf_dir):
    sessions = V.sessions(spark, sf_dir).where("first_seen >= timestamp_ntz '2024-01-03 00:00:00' and first_seen < timestamp_ntz '2024-01-25 00:00:00'")
    out = sessions.join(_visits(spark, sf_dir), "session_id", "left")
    return out.agg(F.count_if(F.col("journey").isNotNull()).alias("linked"), F.count_if(F.col("journey").isNull()).alias("unlinked"))


RUN_COLUMNS = ["o_orderkey AS run_id", "CASE o_orderstatus WHEN 'O' THEN 'processing' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status", "CASE o_orderkey % 3 WHEN 0 THEN '{\"sources\": [\"orders\", \"touches\"], \"batch\": 5}' WHEN 1 THEN '{\"sources\": [\"touches\"]}' ELSE '{}' END AS options"]
BACKFILLS = f"SELECT {', '.join(RUN_COLUMNS)} FROM orders"


@query("a16_backfill_runs", f"SELECT count(*) FILTER (status = 'processing') AS active, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'completed') AS completed FROM ({BACKFILLS}) WHERE run_id % 3 = 0")
def a16(spark, sf_dir):
    runs = V.table(spark, sf_dir, "orders").selectExpr(*RUN_COLUMNS)
    asked = F.array_contains(P.json_texts(F.get_json_object("options", "$.sources")), "orders")
    state = lambda s: F.count_if(F.col("status") == s)
    return runs.where(asked).agg(state("processing").alias("active"), state("failed").alias("failed"), state("completed").alias("completed"))


@query("x04_json_array_elements", f"SELECT run_id, unnest(CASE run_id % 3 WHEN 0 THEN ['orders', 'touches'] WHEN 1 THEN ['touches'] ELSE [] END) AS source FROM ({BACKFILLS})")
def x04(spark, sf_dir):
    runs = V.table(spark, sf_dir, "orders").selectExpr(*RUN_COLUMNS)
    return runs.select("run_id", F.explode(P.json_texts(F.get_json_object("options", "$.sources"))).alias("source"))


@query("a32_backfill_reconciliation", over("SELECT r.source, count(*) AS expected, count(a.record_id) AS processed, greatest(count(*) - count(a.record_id), 0) AS remaining, count(*) = count(a.record_id) AS matches FROM rec r LEFT JOIN (SELECT DISTINCT record_id FROM asg WHERE journey IS NOT NULL) a USING (record_id) GROUP BY 1", NODES))
def a32(spark, sf_dir):
    rows = records(spark, sf_dir)
    done = I.assigned(found(spark, sf_dir)).where("journey is not null").join(rows.select("record_id", "source"), "record_id")
    return Q.processed_counts(rows, done, "source")


@query("u04_sessions_of_evidence", over("SELECT DISTINCT record_id, session_id FROM (SELECT record_id, session_id FROM rec WHERE session_id IS NOT NULL UNION SELECT a.record_id, b.visit FROM rec a JOIN rec b ON a.checkout_token = b.checkout_token)", NODES))
def u04(spark, sf_dir):
    rows = records(spark, sf_dir)
    return I.evidence_sessions(rows)


@query("j17_sessions_with_identity", over("SELECT s.session_id, v.journey, c.email_hash FROM sess s JOIN (SELECT r.visit AS session_id, min(a.journey) AS journey FROM rec r JOIN asg a USING (record_id) WHERE a.journey IS NOT NULL GROUP BY 1) v USING (session_id) LEFT JOIN (SELECT visit AS session_id, arg_min(email_hash, (seen_at, record_id)) AS email_hash FROM rec WHERE email_hash IS NOT NULL GROUP BY 1) c USING (session_id)", NODES))
def j17(spark, sf_dir):
    shown = records(spark, sf_dir).where("email_hash is not null").groupBy(F.col("visit").alias("session_id")).agg(F.min_by("email_hash", F.struct("at", "record_id")).alias("email_hash"))
    return V.sessions(spark, sf_dir).join(_visits(spark, sf_dir), "session_id").join(shown, "session_id", "left").select("session_id", "journey", "email_hash")


DOCUMENTS = """
vis AS (SELECT r.visit AS session_id, min(a.journey) AS journey FROM rec r JOIN asg a USING (record_id) WHERE a.journey IS NOT NULL GROUP BY 1),
js AS (SELECT v.journey, string_agg(s.session_id, ',' ORDER BY s.first_seen, s.session_id) AS sessions FROM sess s JOIN vis v USING (session_id) GROUP BY 1),
jo AS (SELECT a.journey, string_agg(CAST(o.order_id AS VARCHAR), ',' ORDER BY o.ts, CAST(o.order_id AS VARCHAR)) AS orders FROM ord o JOIN asg a ON a.record_id = o.order_id GROUP BY 1),
je AS (SELECT journey, string_agg(node_type || ':' || node_key, ',' ORDER BY code IS NULL DESC, precedence DESC, node_type, node_key) AS edges FROM edg GROUP BY 1)
"""


def _document_parts(spark, sf_dir):
    """The edges, sessions and orders of all journeys; components are built once."""
    _, journeys, edged = _graph(spark, sf_dir)
    sessions = V.sessions(spark, sf_dir).join(_visits(spark, sf_dir, journeys), "session_id").select("journey", F.col("first_seen").alias("at"), F.col("session_id").alias("id"))
    orders = V.orders(spark, sf_dir).join(journeys, F.col("order_id") == F.col("record_id")).select("journey", F.col("ts").alias("at"), F.col("order_id").cast("string").alias("id"))
    return edged, sessions, orders


@query("c32_journey_pages", over("""SELECT journey, section, place // 25 AS page, CAST(ceil(max(n) / 25.0) AS BIGINT) AS pages, string_agg(entry, ',' ORDER BY place) AS entries FROM (SELECT *, row_number() OVER (PARTITION BY journey, section ORDER BY rank, entry) - 1 AS place, count(*) OVER (PARTITION BY journey, section) AS n FROM (
  SELECT journey, 'edges' AS section, CASE WHEN code IS NULL THEN 0 ELSE 1000 END - precedence AS rank, node_type || ':' || node_key AS entry FROM edg UNION ALL SELECT v.journey, 'sessions', epoch_us(s.first_seen), s.session_id FROM sess s JOIN vis v USING (session_id)
  UNION ALL SELECT a.journey, 'orders', epoch_us(o.ts), CAST(o.order_id AS VARCHAR) FROM ord o JOIN asg a ON a.record_id = o.order_id WHERE a.journey IS NOT NULL)) GROUP BY ALL""", NODES, EDGES, DOCUMENTS))
def c32_pages(spark, sf_dir):
    edged, sessions, orders = _document_parts(spark, sf_dir)
    rows = I.journey_pages(edged, sessions, orders.where("journey is not null"), 25)
    return rows.select("journey", "section", "page", "pages", F.array_join("entries", ",").alias("entries"))


@query("u04_evidence_hubs", over("SELECT 'checkout_token:' || checkout_token AS hub, 'record' AS kind, CAST(record_id AS VARCHAR) AS member FROM rec WHERE checkout_token IS NOT NULL UNION SELECT 'checkout_token:' || checkout_token, 'session', visit FROM rec WHERE checkout_token IS NOT NULL UNION SELECT 'session:' || session_id, 'record', CAST(record_id AS VARCHAR) FROM rec WHERE session_id IS NOT NULL UNION SELECT 'session:' || session_id, 'session', session_id FROM rec WHERE session_id IS NOT NULL", NODES))
def u04_hubs(spark, sf_dir):
    return I.evidence_hubs(records(spark, sf_dir))


@query("c32_journey_documents", over("SELECT journey, edges, coalesce(sessions, '') AS sessions, coalesce(orders, '') AS orders FROM je LEFT JOIN js USING (journey) LEFT JOIN jo USING (journey)", NODES, EDGES, DOCUMENTS))
def c32(spark, sf_dir):
    out = I.journey_documents(*_document_parts(spark, sf_dir))
    return out.select("journey", *[F.array_join(c, ",").alias(c) for c in ("edges", "sessions", "orders")])
