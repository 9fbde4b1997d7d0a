"""Queries on queues as state machines and on dead-letter replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import queues as Q
from tidemark.plans.base_sql import over
from tidemark.plans.registry import query
from tidemark.sources import views as V
from tidemark.storage import stage

RULES = {
    "attribution": Q.Rules(stale_seconds=900, base_seconds=60, cap_seconds=3_600, most_attempts=None),
    "hours": Q.Rules(stale_seconds=7_200, base_seconds=21_600, cap_seconds=86_400, most_attempts=3, revives=False),
    "sync": Q.Rules(stale_seconds=129_600, base_seconds=43_200, cap_seconds=172_800, most_attempts=5),
}
RULE_ROWS = ", ".join(f"('{q}', {r.stale_seconds}, {r.base_seconds}, {r.cap_seconds}, {'NULL' if r.most_attempts is None else r.most_attempts}, {r.revives})" for q, r in RULES.items())
FOLD = f"""
rules(queue, stale, base, cap, most, revives) AS (VALUES {RULE_ROWS}),
act AS (SELECT ['attribution', 'hours', 'sync'][user_id % 3 + 1] AS queue, CAST(user_id AS VARCHAR) AS job_key, ts, event_id AS ordinal,
  CASE WHEN event_type IN ('view', 'purchase') THEN 'claim' WHEN event_type = 'click' THEN CASE WHEN k % 4 = 0 THEN 'complete' ELSE 'fail' END WHEN event_type = 'error' THEN 'sweep' ELSE 'enqueue' END AS action, 'd' || CAST(k AS VARCHAR) AS detail, k % 7 = 0 AS revive,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM ev),
fold AS (
  SELECT DISTINCT a.queue, a.job_key, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS ordinal, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS was, CAST(NULL AS VARCHAR) AS status, 0 AS attempts, CAST(NULL AS TIMESTAMP) AS available_at, CAST(NULL AS TIMESTAMP) AS locked_at, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS last_error, FALSE AS applied FROM act a
  UNION ALL
  SELECT queue, job_key, step, ordinal, action, status,
    CASE WHEN NOT ok THEN status ELSE CASE action WHEN 'enqueue' THEN 'pending' WHEN 'claim' THEN 'processing' WHEN 'complete' THEN 'completed' WHEN 'sweep' THEN 'retry' ELSE CASE WHEN dead THEN 'dead_lettered' ELSE 'retry' END END END,
    CASE WHEN ok AND action = 'claim' THEN attempts + 1 ELSE attempts END,
    CASE WHEN ok AND action IN ('enqueue', 'sweep') THEN ts WHEN ok AND action = 'fail' AND NOT dead THEN ts + to_seconds(CAST(least(base * pow(2, attempts - 1), cap) AS BIGINT)) ELSE available_at END,
    CASE WHEN ok THEN CASE WHEN action = 'claim' THEN ts END ELSE locked_at END, CASE WHEN action = 'enqueue' THEN detail ELSE reason END,
    CASE WHEN NOT ok OR action = 'claim' THEN last_error WHEN action = 'fail' THEN detail WHEN action = 'sweep' THEN coalesce(last_error, 'requeued_after_stale_lock') END, ok
  FROM (SELECT f.queue, f.job_key, a.step, a.ordinal, a.action, a.ts, a.detail, f.status, f.attempts, f.available_at, f.locked_at, f.reason, f.last_error, r.base, r.cap, coalesce(f.attempts >= r.most, FALSE) AS dead,
      CASE a.action WHEN 'enqueue' THEN coalesce(f.status, '') <> 'processing' AND (coalesce(f.status, '') <> 'dead_lettered' OR a.revive OR r.revives)
        WHEN 'claim' THEN coalesce(f.status IN ('pending', 'retry') AND f.available_at <= a.ts, FALSE) WHEN 'sweep' THEN coalesce(f.status = 'processing' AND f.locked_at < a.ts - to_seconds(r.stale), FALSE) ELSE coalesce(f.status = 'processing', FALSE) END AS ok
    FROM fold f JOIN act a ON a.queue = f.queue AND a.job_key = f.job_key AND a.step = f.step + 1 JOIN rules r ON r.queue = f.queue))
"""
NOW = "2024-01-25 00:00:00"


def actions(spark, sf_dir):
    kind, k = F.col("event_type"), F.col("k")
    action = F.when(kind.isin("view", "purchase"), "claim").when(kind == "click", F.when(k % 4 == 0, "complete").otherwise("fail")).when(kind == "error", "sweep").otherwise("enqueue")
    queue = F.element_at(F.array(*[F.lit(q) for q in RULES]), (F.col("user_id") % 3 + 1).cast("int"))
    return V.events(spark, sf_dir).select(queue.alias("queue"), F.col("user_id").cast("string").alias("job_key"), F.col("ts").alias("at"), F.col("event_id").alias("ordinal"), action.alias("action"), F.concat(F.lit("d"), k.cast("string")).alias("detail"), (k % 7 == 0).alias("revive"))


def jobs(spark, sf_dir):
    return Q.jobs_of(Q.folded(actions(spark, sf_dir), RULES))


def _us(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


@query("k07_folded_jobs", over("SELECT queue, job_key, status, attempts, epoch_us(available_at) AS available_us, epoch_us(locked_at) AS locked_us, reason, last_error FROM fold WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY queue, job_key ORDER BY step DESC) = 1", FOLD))
def k07_jobs(spark, sf_dir):
    return jobs(spark, sf_dir).select("queue", "job_key", "status", "attempts", _us("available_at").alias("available_us"), _us("locked_at").alias("locked_us"), "reason", "last_error")


@query("k07_transitions", over("SELECT queue, action, was, status AS became, applied, count(*) AS n FROM fold WHERE step > 0 GROUP BY ALL", FOLD))
def k07_transitions(spark, sf_dir):
    return Q.steps_of(Q.folded(actions(spark, sf_dir), RULES)).groupBy("queue", "action", "was", "became", "applied").agg(F.count("*").alias("n"))


@query("k07_swept_and_claimed", over(f"""SELECT queue, job_key, CASE WHEN mine THEN 'processing' ELSE status END AS status, CASE WHEN mine THEN attempts + 1 ELSE attempts END AS attempts, last_error FROM (SELECT *, ready AND row_number() OVER (PARTITION BY ready ORDER BY available_at, queue, job_key) <= 40 AS mine FROM (
  SELECT *, status IN ('pending', 'retry') AND available_at <= TIMESTAMP '{NOW}' AS ready FROM (SELECT queue, job_key, attempts, CASE WHEN old THEN 'retry' ELSE status END AS status, CASE WHEN old THEN TIMESTAMP '{NOW}' ELSE available_at END AS available_at, CASE WHEN old THEN coalesce(last_error, 'requeued_after_stale_lock') ELSE last_error END AS last_error
  FROM (SELECT f.*, coalesce(f.status = 'processing' AND date_diff('second', locked_at, TIMESTAMP '{NOW}') > r.stale, FALSE) AS old FROM (SELECT * FROM fold WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY queue, job_key ORDER BY step DESC) = 1) f JOIN rules r USING (queue)))))""", FOLD))
def k07_claimed(spark, sf_dir):
    now = F.lit(NOW).cast("timestamp_ntz")
    rows = stage(jobs(spark, sf_dir), "jobs")
    return Q.claimed(Q.swept(rows, RULES, now), "w1", now, 40).select("queue", "job_key", "status", "attempts", "last_error")


LETTERS = """letters AS (SELECT event_id AS id, CASE WHEN k % 2 = 0 THEN 'order' ELSE 'touch' END AS event_type, CASE WHEN k % 3 = 0 THEN 'orders' ELSE 'events' END AS source_table, CAST(user_id * 10 + k % 10 AS VARCHAR) AS source_record_id, CASE WHEN k % 5 = 0 THEN 'replayed' ELSE 'pending_replay' END AS status, ts AS last_failed_at FROM ev WHERE event_type = 'error'),
srcs AS (SELECT 'orders' AS source_table, CAST(o_orderkey AS VARCHAR) AS source_record_id FROM orders),
pick AS (SELECT l.*, s.source_record_id IS NOT NULL AS known FROM (SELECT * FROM letters WHERE status = 'pending_replay' AND last_failed_at >= TIMESTAMP '2024-01-10' AND last_failed_at <= TIMESTAMP '2024-01-28' AND event_type = 'order' ORDER BY last_failed_at, id LIMIT 60) l LEFT JOIN (SELECT DISTINCT * FROM srcs) s USING (source_table, source_record_id))"""


def replay_fixture(spark, sf_dir):
    k = F.col("k")
    letters = V.events(spark, sf_dir).where("event_type = 'error'").select(F.col("event_id").alias("id"), F.when(k % 2 == 0, "order").otherwise("touch").alias("event_type"), F.when(k % 3 == 0, "orders").otherwise("events").alias("source_table"), (F.col("user_id") * 10 + k % 10).cast("string").alias("source_record_id"), F.when(k % 5 == 0, "replayed").otherwise("pending_replay").alias("status"), F.col("ts").alias("last_failed_at"))
    sources = V.table(spark, sf_dir, "orders").select(F.lit("orders").alias("source_table"), F.col("o_orderkey").cast("string").alias("source_record_id"))
    return letters, sources


def replay_runs(spark, sf_dir):
    """The items of a dry run, of the run, of the same run again, and the letters after it."""
    letters, sources = replay_fixture(spark, sf_dir)
    none = spark.createDataFrame([], "run string, id long, outcome string, planned string, source_table string, source_record_id string")
    real = Q.Replay("r1", event_type="order", first="2024-01-10 00:00:00", last="2024-01-28 00:00:00", limit=60)
    dry = Q.replay_items(letters, sources, none, Q.Replay("r0", "order", None, real.first, real.last, real.limit, True))
    done = stage(Q.replay_items(letters, sources, none, real), "items")
    after = Q.replayed_letters(letters, done)
    again = Q.replay_items(after, sources, done, real)
    return stage(dry, "items").unionByName(done).unionByName(again), after


@query("k08_replay_counters", over("SELECT run, count(*) AS candidates, count(*) FILTER (known AND run = 'r1') AS replayed, count(*) FILTER (NOT known AND run = 'r1') AS skipped, count(*) FILTER (run = 'r0') AS dry_runs, count(*) FILTER (known) AS to_replay, count(*) FILTER (NOT known) AS to_skip FROM pick CROSS JOIN (SELECT unnest(['r0', 'r1']) AS run) GROUP BY run", LETTERS))
def k08_counters(spark, sf_dir):
    return Q.replay_counters(replay_runs(spark, sf_dir)[0])


@query("k08_replayed_letters", over("SELECT l.id, CASE WHEN p.known THEN 'replayed' ELSE l.status END AS status, CASE WHEN p.known THEN 'r1' END AS last_run FROM letters l LEFT JOIN pick p USING (id)", LETTERS))
def k08_letters(spark, sf_dir):
    return replay_runs(spark, sf_dir)[1].select("id", "status", "last_run")


@query("k08_replay_requests", over("SELECT DISTINCT source_table AS queue, source_record_id AS job_key, 'replay:r1' AS detail FROM pick WHERE known", LETTERS))
def k08_requests(spark, sf_dir):
    return Q.replay_requests(replay_runs(spark, sf_dir)[0]).select("queue", "job_key", "detail")
