"""Job queues as state machines: what a log of actions makes of each job, claims of a batch, and replay of dead letters.

A job is a key of a queue.  Its actions, in order of (time, ordinal), are folded one by one; Spark brings a
key's actions together and sorts them, and a task keeps one job's state at a time, so a key may have any number of actions.

Statuses: pending, processing, retry, completed, dead_lettered.  Actions that don't fit a job's status change nothing and are
reported as ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship

JOB = "queue string, job_key string, status string, attempts int, available_at timestamp_ntz, locked_at timestamp_ntz, locked_by string, reason string, last_error string"
STEP = "queue string, job_key string, at timestamp_ntz, ordinal long, action string, was string, became string, applied boolean"
#: Fixed value: the error of a job that was taken back from a worker.
STALE_ERROR = "requeued_after_stale_lock"


@dataclass(frozen=True)
class Rules:
    """What differs among queues: when a lock is stale, how failures wait, when they are dead, and whether a request revives the dead."""

    stale_seconds: int = 900
    base_seconds: int = 60
    cap_seconds: int = 3_600
    most_attempts: int | None = None
    revives: bool = True

    def wait(self, attempts: int) -> int:
        return min(self.base_seconds * 2 ** min(max(attempts, 1) - 1, 40), self.cap_seconds)


@dataclass
class Job:
    """A job's state; status None is a job that isn't there."""

    status: str | None = None
    attempts: int = 0
    available_at: datetime | None = None
    locked_at: datetime | None = None
    locked_by: str | None = None
    reason: str | None = None
    last_error: str | None = None

    def apply(self, action: str, at: datetime, detail: str | None, revive: bool, rules: Rules) -> bool:
        """One action; whether it changed the job."""
        if action == "enqueue":
            if self.status is None:
                self.attempts = 0
            self.reason = detail
            if self.status == "processing" or self.status == "dead_lettered" and not (revive or rules.revives):
                return False
            self.status, self.available_at, self.locked_at, self.locked_by, self.last_error = "pending", at, None, None, None
        elif action == "claim":
            if self.status not in ("pending", "retry") or self.available_at > at:
                return False
            self.status, self.locked_at, self.locked_by, self.attempts = "processing", at, detail, self.attempts + 1
        elif self.status != "processing":
            return False
        elif action == "complete":
            self.status, self.locked_at, self.locked_by, self.last_error = "completed", None, None, None
        elif action == "fail":
            dead = rules.most_attempts is not None and self.attempts >= rules.most_attempts
            self.available_at = self.available_at if dead else at + timedelta(seconds=rules.wait(self.attempts))
            self.status, self.locked_at, self.locked_by, self.last_error = "dead_lettered" if dead else "retry", None, None, detail
        elif action == "sweep":
            if at - self.locked_at <= timedelta(seconds=rules.stale_seconds):
                return False
            self.status, self.locked_at, self.locked_by, self.available_at, self.last_error = "retry", None, None, at, self.last_error or STALE_ERROR
        else:
            return False
        return True


def folded(actions: DataFrame, rules: dict[str, Rules], jobs: DataFrame | None = None) -> DataFrame:
    """job (after all actions) and step (each action and what it did) as two nullable columns, from ``jobs`` as they were.

    actions: queue, job_key, at, ordinal, action, detail, revive.  A queue without rules has the default ones.  Null times, queues or
    keys take no part.
    """
    ship(actions.sparkSession)
    none = lambda kind: F.lit(None).cast(kind)
    new = actions.where("at is not null and queue is not null and job_key is not null").select("queue", "job_key", F.lit(1).alias("kind"), F.col("at").cast("timestamp_ntz").alias("at"), F.col("ordinal").cast("long").alias("ordinal"), "action", "detail", F.coalesce("revive", F.lit(False)).alias("revive"), none(f"struct<{JOB}>").alias("job"))
    rows = new if jobs is None else new.unionByName(jobs.select("queue", "job_key", F.lit(0).alias("kind"), none("timestamp_ntz").alias("at"), none("long").alias("ordinal"), none("string").alias("action"), none("string").alias("detail"), F.lit(False).alias("revive"), F.struct(*[F.col(c.split()[0]) for c in JOB.split(", ")]).alias("job")))
    ts = pa.timestamp("us")
    job = pa.struct([("queue", pa.string()), ("job_key", pa.string()), ("status", pa.string()), ("attempts", pa.int32()), ("available_at", ts), ("locked_at", ts), ("locked_by", pa.string()), ("reason", pa.string()), ("last_error", pa.string())])
    step = pa.struct([("queue", pa.string()), ("job_key", pa.string()), ("at", ts), ("ordinal", pa.int64()), ("action", pa.string()), ("was", pa.string()), ("became", pa.string()), ("applied", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state, jobs_out, steps = None, Job(), [], []

        def flush() -> pa.RecordBatch:
            listed = [*[(j, None) for j in jobs_out], *[(None, s) for s in steps]]
            jobs_out.clear()
            steps.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in listed], job), pa.array([x for _, x in listed], step)], names=["job", "step"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["queue"], r["job_key"]) != here:
                    if here and state.status:
                        jobs_out.append({"queue": here[0], "job_key": here[1], **asdict(state)})
                    here, state = (r["queue"], r["job_key"]), Job()
                if r["kind"] == 0:
                    state = Job(**{k: v for k, v in r["job"].items() if k not in ("queue", "job_key")})
                    continue
                was = state.status
                did = state.apply(r["action"], r["at"], r["detail"], r["revive"], rules.get(r["queue"], Rules()))
                steps.append({"queue": here[0], "job_key": here[1], "at": r["at"], "ordinal": r["ordinal"], "action": r["action"], "was": was, "became": state.status, "applied": did})
            yield flush()
        if here and state.status:
            jobs_out.append({"queue": here[0], "job_key": here[1], **asdict(state)})
        yield flush()

    ordered = rows.repartition("queue", "job_key").sortWithinPartitions("queue", "job_key", "kind", "at", "ordinal")
    return ordered.mapInArrow(run, f"job struct<{JOB}>, step struct<{STEP}>")


def jobs_of(fold: DataFrame) -> DataFrame:
    return fold.where("job is not null").select("job.*")


def steps_of(fold: DataFrame) -> DataFrame:
    return fold.where("step is not null").select("step.*")


def rule(rules: dict[str, Rules], name: str) -> Column:
    """A rule's value for the queue of a row."""
    out = F.lit(getattr(Rules(), name))
    for queue, own in rules.items():
        out = F.when(F.col("queue") == queue, F.lit(getattr(own, name))).otherwise(out)
    return out


def swept(jobs: DataFrame, rules: dict[str, Rules], as_of: Column) -> DataFrame:
    """Jobs whose lock is stale go back to retry, at once available."""
    stale = F.coalesce((F.col("status") == "processing") & (F.timestamp_diff("SECOND", F.col("locked_at"), as_of) > rule(rules, "stale_seconds")), F.lit(False))
    keep = lambda c, new: F.when(stale, new).otherwise(F.col(c)).alias(c)
    changed = {"status": F.lit("retry"), "available_at": as_of, "locked_at": F.lit(None), "locked_by": F.lit(None), "last_error": F.coalesce("last_error", F.lit(STALE_ERROR))}
    return jobs.select(*[keep(c, changed[c]) if c in changed else F.col(c) for c in jobs.columns])


def claimed(jobs: DataFrame, worker: str, as_of: Column, limit: int) -> DataFrame:
    """The queue after a worker has claimed the first ``limit`` available jobs, oldest first, then by key."""
    ready = jobs.where(F.col("status").isin("pending", "retry") & (F.col("available_at") <= as_of))
    mine = ready.orderBy("available_at", "queue", "job_key").limit(limit).select("queue", "job_key", F.lit(True).alias("__mine"))
    out = jobs.join(F.broadcast(mine), ["queue", "job_key"], "left")  # limit rows
    changed = {"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "locked_at": as_of, "locked_by": F.lit(worker)}
    return out.select(*[F.when(F.col("__mine"), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in jobs.columns])


@dataclass(frozen=True)
class Replay:
    """A replay run: its name, filters (None: any), and whether it only says what it would do."""

    run: str
    event_type: str | None = None
    source_table: str | None = None
    first: str | None = None
    last: str | None = None
    limit: int = 100
    dry_run: bool = False


def replay_candidates(letters: DataFrame, replay: Replay, after: tuple[str, int] | None = None) -> DataFrame:
    """The first ``limit`` pending letters that fit the filters, by (last_failed_at, id), after a cursor."""
    rows = letters.where("status = 'pending_replay'")
    for c, value in (("event_type", replay.event_type), ("source_table", replay.source_table)):
        rows = rows if value is None else rows.where(F.col(c) == value)
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    rows = rows if replay.first is None else rows.where(F.col("last_failed_at") >= at(replay.first))
    rows = rows if replay.last is None else rows.where(F.col("last_failed_at") <= at(replay.last))
    if after is not None:
        rows = rows.where(F.struct("last_failed_at", "id") > F.struct(at(after[0]).alias("last_failed_at"), F.lit(after[1]).cast("long").alias("id")))
    return rows.orderBy("last_failed_at", "id").limit(replay.limit)


def replay_items(letters: DataFrame, sources: DataFrame, items: DataFrame, replay: Replay, after: tuple[str, int] | None = None) -> DataFrame:
    """run, id, outcome, planned, source_table, source_record_id of a run's letters.

    ``planned`` is replayed where the source record (source_table, source_record_id) is known, else skipped; a dry run
    has the same plan and the outcome dry_run.  A run that ``items`` already has adds nothing; further batches
    are runs of their own, after the last one's cursor.
    """
    known_run = items.where((F.col("run") == replay.run) & (F.col("outcome") != "dry_run")).limit(1).count()
    found = replay_candidates(letters.limit(0) if known_run else letters, replay, after)
    known = sources.select("source_table", "source_record_id", F.lit(True).alias("__known")).distinct()
    rows = found.join(known, ["source_table", "source_record_id"], "left")
    planned = F.when(F.col("__known"), "replayed").otherwise("skipped")
    return rows.select(F.lit(replay.run).alias("run"), "id", (F.lit("dry_run") if replay.dry_run else planned).alias("outcome"), planned.alias("planned"), "source_table", "source_record_id")


def replayed_letters(letters: DataFrame, items: DataFrame) -> DataFrame:
    """The letters after a run's items: those replayed say so, and by which run."""
    done = items.where("outcome = 'replayed'").groupBy("id").agg(F.max("run").alias("__run"))
    return letters.join(done, "id", "left").withColumns({"status": F.when(F.col("__run").isNotNull(), "replayed").otherwise(F.col("status")), "last_run": F.col("__run")}).drop("__run")


def replay_requests(items: DataFrame) -> DataFrame:
    """The actions that put replayed records back into their queue, each once."""
    return items.where("outcome = 'replayed'").select(F.col("source_table").alias("queue"), F.col("source_record_id").alias("job_key"), F.lit("enqueue").alias("action"), F.concat(F.lit("replay:"), "run").alias("detail"), F.lit(True).alias("revive")).distinct()


def replay_counters(items: DataFrame) -> DataFrame:
    """One row a run: candidates, replayed, skipped, dry_run, and what was planned."""
    count = lambda c, v: F.count_if(F.col(c) == v)
    return items.groupBy("run").agg(F.count("*").alias("candidates"), count("outcome", "replayed").alias("replayed"), count("outcome", "skipped").alias("skipped"), count("outcome", "dry_run").alias("dry_runs"), count("planned", "replayed").alias("to_replay"), count("planned", "skipped").alias("to_skip"))
