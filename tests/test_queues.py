"""Queues as state machines, replay, pruned shards, exact percentiles and syncs that brought nothing."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality, queues, spend
from tidemark.sources import shards

AT = dt.datetime(2024, 3, 1)
ACTIONS = "queue string, job_key string, at timestamp_ntz, ordinal long, action string, detail string, revive boolean"
RULES = {"a": queues.Rules(stale_seconds=100, base_seconds=10, cap_seconds=60, most_attempts=3, revives=False)}


def told(spark, *actions, jobs=None, queue="a"):
    """actions: (seconds, action, detail, revive)."""
    rows = [(queue, "k", AT + dt.timedelta(seconds=s), i, *rest, *([None, False][len(rest) - 1 :])) for i, (s, *rest) in enumerate(actions)]
    fold = queues.folded(spark.createDataFrame(rows, ACTIONS), RULES, jobs).cache()
    return queues.jobs_of(fold).first(), [r["applied"] for r in queues.steps_of(fold).orderBy("at", "ordinal").collect()], queues.jobs_of(fold)


def test_a_job_through_all_its_states(spark):
    job, applied, jobs = told(spark, (0, "claim"), (1, "enqueue", "new"), (1, "claim", "w"), (2, "enqueue", "later"), (3, "fail", "x"), (5, "claim", "w"), (13, "claim", "w"), (100, "sweep"), (200, "sweep"), (201, "claim"), (202, "fail", "y"), (203, "enqueue", "again"))
    assert applied == [False, True, True, False, True, False, True, False, True, True, True, False]
    assert (job["status"], job["attempts"], job["last_error"], job["reason"]) == ("dead_lettered", 3, "y", "again")
    job, applied, _ = told(spark, (300, "enqueue", "revived", True), (301, "claim", "v"), (302, "complete"), (303, "complete"), jobs=jobs)
    assert applied == [True, True, True, False] and (job["status"], job["attempts"], job["last_error"]) == ("completed", 4, None)
    assert told(spark, (0, "enqueue"), (1, "claim"), (2, "fail"), (400, "enqueue"), queue="other")[0]["status"] == "pending"


def test_waits_double_up_to_the_cap():
    assert [queues.Rules(base_seconds=10, cap_seconds=60).wait(n) for n in (0, 1, 2, 3, 4, 99)] == [10, 10, 20, 40, 60, 60]


def test_folding_in_two_parts_is_folding_once(spark):
    pick = random.Random(5)
    rows = [(q, f"k{pick.randrange(9)}", AT + dt.timedelta(seconds=pick.randrange(900)), i, pick.choice(["enqueue", "claim", "complete", "fail", "sweep"]), f"d{i}", pick.random() < 0.3) for i, q in enumerate("ab" * 150)]
    rows += [(None, "k", AT, 0, "enqueue", "x", None), ("a", None, AT, 0, "enqueue", "x", None), ("a", "k1", None, 0, "enqueue", "x", None)]
    df = spark.createDataFrame(rows, ACTIONS)
    cut = F.lit(str(AT + dt.timedelta(seconds=400))).cast("timestamp_ntz")
    first = queues.jobs_of(queues.folded(df.where(F.col("at") < cut), RULES))
    twice = queues.jobs_of(queues.folded(df.where(F.col("at") >= cut), RULES, first))
    assert sorted(map(tuple, twice.collect()), key=str) == sorted(map(tuple, queues.jobs_of(queues.folded(df, RULES)).collect()), key=str)
    assert queues.folded(df.limit(0), RULES).count() == 0


def test_claims_go_by_age_and_stale_locks_come_back(spark):
    at = lambda s: AT + dt.timedelta(seconds=s)
    jobs = spark.createDataFrame([("a", "1", "pending", 0, at(5), None, None, None, None), ("a", "2", "retry", 1, at(3), None, None, None, "e"), ("a", "3", "pending", 0, at(5000), None, None, None, None), ("a", "4", "processing", 1, at(0), at(0), "w", None, None), ("a", "5", "processing", 1, at(0), at(950), "w", None, None)], queues.JOB)
    now = F.lit(str(at(1000))).cast("timestamp_ntz")
    out = {r["job_key"]: r for r in queues.claimed(queues.swept(jobs, RULES, now), "me", now, 2).collect()}
    assert {k: r["status"] for k, r in out.items()} == {"1": "processing", "2": "processing", "3": "pending", "4": "retry", "5": "processing"}
    assert out["2"]["attempts"] == 2 and out["2"]["locked_by"] == "me" and out["4"]["last_error"] == queues.STALE_ERROR and out["5"]["locked_by"] == "w"


def test_dry_and_real_runs_plan_the_same_and_a_run_is_made_once(spark):
    letters = spark.createDataFrame([(i, "order" if i % 2 else "touch", "orders", str(i), "pending_replay" if i % 5 else "replayed", AT + dt.timedelta(hours=i // 3)) for i in range(40)], "id long, event_type string, source_table string, source_record_id string, status string, last_failed_at timestamp_ntz")
    sources = spark.createDataFrame([("orders", str(i)) for i in range(0, 40, 3)] * 2, "source_table string, source_record_id string")
    none = spark.createDataFrame([], "run string, id long, outcome string, planned string, source_table string, source_record_id string")
    dry = queues.replay_items(letters, sources, none, queues.Replay("r", "order", limit=10, dry_run=True))
    real = queues.replay_items(letters, sources, dry, queues.Replay("r", "order", limit=10)).cache()
    plan = lambda items: sorted((r["id"], r["planned"]) for r in items.collect())
    assert plan(dry) == plan(real) and len(plan(real)) == 10 and {r["outcome"] for r in dry.collect()} == {"dry_run"}
    assert queues.replay_items(letters, sources, real, queues.Replay("r", "order", limit=10)).count() == 0
    last = letters.join(real, "id").orderBy(F.desc("last_failed_at"), F.desc("id")).first()
    following = queues.replay_items(letters, sources, real, queues.Replay("r2", "order", limit=10), (str(last["last_failed_at"]), last["id"]))
    want = [i for i in range(40) if i % 2 and i % 5]
    assert [i for i, _ in plan(real)] + [i for i, _ in plan(following)] == want
    after = queues.replayed_letters(letters, real)
    assert {r["id"] for r in after.where("last_run = 'r'").collect()} == {i for i in want[:10] if i % 3 == 0}
    assert queues.replay_requests(real).count() == len([i for i in want[:10] if i % 3 == 0])


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shards") / "t")
    rows = spark.range(300).select("id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 30).cast("int")).alias("day"))
    shards.write_shards(rows, path, F.when(F.col("id") % 2 == 0, "events").otherwise("intraday"), F.col("day"))
    return shards.read_shards(spark, path, "id long, day date")


def files_read(df):
    plan = df._jdf.queryExecution().executedPlan()
    df.write.format("noop").mode("overwrite").save()
    return plan.toString()


def test_a_range_of_shards_is_a_partition_filter(laid_out):
    found = shards.between(laid_out, "20240110", "20240112")
    plan = files_read(found)
    own = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "table_suffix" in own and "20240110" in own
    paths = {r[0].split("table_suffix=")[1][:8] for r in found.select(F.input_file_name()).distinct().collect()}
    assert paths == {"20240110", "20240111", "20240112"} and found.count() == 30


def test_shards_since_a_watermark_are_pruned_while_it_runs(spark, laid_out):
    marks = spark.createDataFrame([("events", dt.date(2024, 1, 29)), ("intraday", dt.date(2024, 2, 5))], "table_type string, watermark date").where("watermark is not null")
    found = shards.since(laid_out, marks, "20240130", 1)
    assert "dynamicpruning" in files_read(found).lower()
    days = {(r["table_type"], r["table_suffix"]) for r in found.select("table_type", "table_suffix").distinct().collect()}
    assert {d for t, d in days if t == "events"} == {"20240128", "20240129", "20240130"} & {d for t, d in days if t == "events"} and not any(t == "intraday" for t, _ in days)


def test_shards_are_replaced_one_by_one(spark, tmp_path):
    path, day = str(tmp_path / "t"), F.lit("2024-01-02").cast("date")
    for ids, at in (((1, 2), day), ((3,), day), ((4,), F.lit("2024-01-03").cast("date"))):
        shards.write_shards(spark.createDataFrame([(i,) for i in ids], "id long"), path, F.lit("events"), at)
    shards.write_shards(spark.createDataFrame([(5,)], "id long"), path, F.lit("intraday"), day)
    every = shards.read_shards(spark, path, "id long")
    assert sorted(r["id"] for r in every.collect()) == [3, 4, 5]
    assert sorted(r["id"] for r in shards.one_kind_a_day(every).collect()) == [3, 4]


@pytest.mark.parametrize("bin_rows", [1_000_000, 20, 2])
def test_percentiles_in_ranges(spark, bin_rows):
    pick = random.Random(1)
    values = [pick.choice([7.0, pick.random() * 100, float(pick.randrange(20))]) for _ in range(700)] + [None] * 9
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    known = sorted(v for v in values if v is not None)
    got = quality.nearest_rank(df, "v", [0.01, 0.3, 0.5, 0.95, 1.0], bins=8, bin_rows=bin_rows).first()
    assert list(got) == [known[math.ceil(p * len(known)) - 1] for p in (0.01, 0.3, 0.5, 0.95, 1.0)]


def test_percentiles_of_nothing_and_of_one_value(spark):
    assert quality.nearest_rank(spark.createDataFrame([(None,)], "v long"), "v", [0.5]).first()["p50"] is None
    assert list(quality.nearest_rank(spark.createDataFrame([(4,)] * 50, "v long"), "v", [0.5, 0.95], bin_rows=1).first()) == [4, 4]


def test_syncs_that_brought_nothing(spark):
    ran = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1)], "account string, day int")
    rows = spark.createDataFrame([("a", 1, True), ("a", 1, False), ("b", 1, False), ("c", 1, False)], "account string, day int, is_normalised boolean")
    assert sorted(map(tuple, spend.zero_row_anomalies(rows, ran, ["account", "day"]).collect())) == [("a", 2, 0, 0), ("b", 1, 1, 0)]
