"""Queries on identity by arrival (C15): the ordered fold of evidence, with merges, rehomed nodes and hard stops."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import arrivals as A
from tidemark.operators import identity as I
from tidemark.plans.base_sql import over
from tidemark.plans.registry import query
from tidemark.sources import views as V

#: Six users at most share keys here, so their records can be folded apart from all others.
FOLD = """
arr0 AS (SELECT event_id AS record_id, ts AS seen_at, user_id // 6 AS g, CASE WHEN k % 4 = 0 THEN CAST(user_id AS VARCHAR) END AS customer, CASE WHEN k % 3 = 0 THEN 'email_hash:e' || CAST(user_id // 3 AS VARCHAR) END AS n1, CASE WHEN k % 5 = 1 THEN 'phone_hash:p' || CAST(user_id AS VARCHAR) END AS n2,
  CASE WHEN k % 10 < 2 THEN 'checkout_token:t' || CAST(user_id // 2 AS VARCHAR) || '-' || CAST(event_id % 9 AS VARCHAR) END AS n3, CASE WHEN k % 6 > 0 THEN 'session_id:' || session_id END AS n4 FROM ev WHERE event_type <> 'error'),
arr AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY seen_at, record_id) AS step FROM (
  SELECT record_id, seen_at, g, customer, list_filter([{'node': 'customer_id:' || customer, 'prec': 100}, {'node': n1, 'prec': 70}, {'node': n2, 'prec': 60}, {'node': n3, 'prec': 40}, {'node': n4, 'prec': 20}], lambda n: n.node IS NOT NULL) AS nodes FROM arr0) WHERE len(nodes) > 0),
fold AS (
  SELECT g, CAST(0 AS BIGINT) AS step, CAST([] AS STRUCT(node VARCHAR, prec INTEGER, j VARCHAR, q BOOLEAN, seen TIMESTAMP)[]) AS e, CAST([] AS STRUCT(j VARCHAR, customer VARCHAR)[]) AS c, CAST(NULL AS BIGINT) AS record_id, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS winner,
    CAST(0 AS BIGINT) AS attached, CAST([] AS STRUCT(node VARCHAR, j VARCHAR)[]) AS moved, CAST([] AS STRUCT(node VARCHAR, j VARCHAR)[]) AS locked, CAST([] AS VARCHAR[]) AS merged, CAST([] AS VARCHAR[]) AS owners FROM (SELECT DISTINCT g FROM arr)
  UNION ALL
  SELECT g, step, e2, c2, record_id, CASE WHEN stop THEN 'conflict' ELSE 'linked' END, CASE WHEN stop THEN 'several_authorities' WHEN len(js) = 0 THEN 'created_new_journey' WHEN auth IS NOT NULL THEN 'authority' WHEN len(js) = 1 THEN 'reused_journey' WHEN customer IS NULL THEN 'precedence' ELSE 'authority' END, winner,
    CASE WHEN stop THEN 0 ELSE len(new) END, moved, list_transform(q, lambda x: {'node': x.node, 'j': x.j}), CASE WHEN stop THEN [] ELSE list_filter(js, lambda j: j <> winner AND len(list_filter(e2, lambda x: x.j = j)) = 0) END, owners FROM (
  SELECT *, CASE WHEN stop THEN c WHEN len(js) = 0 THEN list_append(c, {'j': winner, 'customer': customer}) ELSE list_transform(c, lambda y: CASE WHEN y.j = winner AND customer IS NOT NULL THEN {'j': y.j, 'customer': customer} ELSE y END) END AS c2,
    CASE WHEN stop THEN [] ELSE list_transform(list_filter(live2, lambda x: x.j <> winner), lambda x: {'node': x.node, 'j': x.j}) END AS moved,
    list_concat(list_transform(e, lambda x: CASE WHEN list_contains(qn, x.node) THEN {'node': x.node, 'prec': x.prec, 'j': x.j, 'q': TRUE, 'seen': seen_at} WHEN stop OR x.q OR NOT list_contains(names, x.node) THEN x
      ELSE {'node': x.node, 'prec': x.prec, 'j': winner, 'q': FALSE, 'seen': CASE WHEN x.j = winner THEN greatest(x.seen, seen_at) ELSE seen_at END} END),
      CASE WHEN stop THEN [] ELSE list_transform(new, lambda n: {'node': n.node, 'prec': n.prec, 'j': winner, 'q': FALSE, 'seen': seen_at}) END) AS e2 FROM (
  SELECT *, CASE WHEN stop THEN NULL WHEN len(js) = 0 THEN 'j' || CAST(record_id AS VARCHAR) WHEN auth IS NOT NULL THEN auth WHEN len(js) = 1 THEN js[1]
      ELSE list_sort(list_transform(js, lambda j: {'r': -list_max(list_transform(list_filter(e, lambda x: x.j = j), lambda x: x.prec)), 't': -epoch_us(list_max(list_transform(list_filter(e, lambda x: x.j = j), lambda x: x.seen))), 'j': j}))[1].j END AS winner FROM (
  SELECT *, len(owners) > 1 AS stop FROM (
  SELECT *, list_sort(list_distinct(list_transform(list_filter(own, lambda y: y.customer IS NOT NULL AND len(list_filter(live2, lambda x: x.j = y.j)) > 0), lambda y: y.customer))) AS owners FROM (
  SELECT *, list_transform(q, lambda x: x.node) AS qn, list_filter(live, lambda x: NOT list_contains(list_transform(q, lambda z: z.node), x.node)) AS live2 FROM (
  SELECT *, CASE WHEN auth IS NOT NULL AND len(list_distinct(list_transform(list_filter(own, lambda y: y.customer IS NOT NULL), lambda y: y.customer))) > 1
      THEN list_filter(live, lambda x: (starts_with(x.node, 'email_hash:') OR starts_with(x.node, 'phone_hash:')) AND len(list_filter(own, lambda y: y.j = x.j AND y.customer <> customer)) > 0) ELSE [] END AS q FROM (
  SELECT *, list_filter(own, lambda y: y.customer = customer)[1].j AS auth FROM (
  SELECT *, list_filter(c, lambda y: list_contains(js, y.j)) AS own FROM (
  SELECT *, list_sort(list_distinct(list_transform(live, lambda x: x.j))) AS js FROM (
  SELECT f.g, a.step, f.e, f.c, a.record_id, a.seen_at, a.customer, a.nodes, list_transform(a.nodes, lambda n: n.node) AS names, list_filter(f.e, lambda x: NOT x.q AND list_contains(list_transform(a.nodes, lambda n: n.node), x.node)) AS live,
    list_filter(a.nodes, lambda n: NOT list_contains(list_transform(f.e, lambda x: x.node), n.node)) AS new FROM fold f JOIN arr a ON a.g = f.g AND a.step = f.step + 1
  ))))))))))
)
"""


def over_fold(sql: str) -> str:
    return over(sql, FOLD)


def records(spark, sf_dir):
    k, user, event = F.col("k"), F.col("user_id"), F.col("event_id")
    share = lambda mark, n: F.concat(F.lit(mark), F.floor(user / n).cast("string"))
    return V.events(spark, sf_dir).where("event_type <> 'error'").select(
        event.alias("record_id"), F.col("ts").alias("at"), F.when(k % 4 == 0, user.cast("string")).alias("customer_id"), F.when(k % 3 == 0, share("e", 3)).alias("email_hash"),
        F.when(k % 5 == 1, share("p", 1)).alias("phone_hash"), F.when(k % 10 < 2, F.concat(share("t", 2), F.lit("-"), (event % 9).cast("string"))).alias("checkout_token"), F.when(k % 6 > 0, F.col("session_id")).alias("session_id"),
    )


def log(spark, sf_dir):
    return A.folded(I.nodes(records(spark, sf_dir)))[0]


@query("c15_fold_log", over_fold("SELECT record_id, outcome, reason, winner AS journey, CAST(attached AS INTEGER) AS attached, CAST(len(moved) AS INTEGER) AS rehomed, CAST(len(locked) AS INTEGER) AS quarantined FROM fold WHERE step > 0"))
def c15_log(spark, sf_dir):
    return log(spark, sf_dir).select("record_id", "outcome", "reason", "journey", "attached", F.size("rehomed").alias("rehomed"), F.size("quarantined").alias("quarantined"))


@query("c15_merge_log", over_fold("SELECT record_id, unnest(merged) AS journey, winner AS into_journey, reason FROM fold WHERE step > 0"))
def c15_merges(spark, sf_dir):
    return A.merges(log(spark, sf_dir)).select("record_id", "journey", F.col("into").alias("into_journey"), "reason")


@query("c15_rehomed_nodes", over_fold("SELECT record_id, m.node AS node, m.j AS from_journey, winner AS to_journey FROM (SELECT record_id, winner, unnest(moved) AS m FROM fold WHERE step > 0)"))
def c15_rehomed(spark, sf_dir):
    return A.rehomed(log(spark, sf_dir)).select("record_id", F.concat("node_type", F.lit(":"), "node_key").alias("node"), "from_journey", "to_journey")


@query("c15_hard_stops", over_fold("SELECT record_id, array_to_string(owners, ',') AS customers FROM fold WHERE outcome = 'conflict'"))
def c15_stops(spark, sf_dir):
    return A.hard_stops(log(spark, sf_dir)).select("record_id", F.array_join("customers", ",").alias("customers"))
