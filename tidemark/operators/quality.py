"""Data quality checks, retention, backfill scope and job queues."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

# An anomaly is a drop by this share of a mean that is at least so large.
DROP_RATIO, LEAST_BASELINE = 0.35, 5


def anomalies(daily: DataFrame, run_date: str, metrics: list[str]) -> DataFrame:
    """metric, current_value, baseline_value, relative_delta of metrics that fell under the mean of all other days."""
    names = ", ".join(f"'{m}', coalesce(cast({m} as double), 0.0D)" for m in metrics)
    long = daily.selectExpr("metric_date", f"stack({len(metrics)}, {names}) as (metric, v)")
    today = F.col("metric_date") == F.lit(run_date).cast("date")
    by = long.groupBy("metric").agg(F.max(F.when(today, F.col("v"))).alias("current_value"), F.sum(F.when(~today, F.col("v"))).alias("s"), F.count(F.when(~today, F.col("v"))).alias("n"))
    out = by.where("current_value is not null and n > 0").withColumn("baseline_value", F.col("s") / F.col("n"))
    out = out.withColumn("relative_delta", F.when(F.col("baseline_value") > 0, (F.col("baseline_value") - F.col("current_value")) / F.col("baseline_value")))
    return out.where((F.col("baseline_value") >= LEAST_BASELINE) & (F.col("relative_delta") >= DROP_RATIO)).select("metric", "current_value", "baseline_value", "relative_delta")


def evaluated(found: DataFrame, threshold: Column, severity: Column) -> DataFrame:
    """Adds status, severity and alert to rows with discrepancies: healthy at none, warning up to the threshold, then an alert."""
    n = F.greatest(F.col("discrepancies"), F.lit(0))
    alert = n > F.greatest(threshold, F.lit(0))
    status = F.when(n == 0, "healthy").when(alert & (severity == "critical"), "failed").otherwise("warning")
    return found.withColumns({"status": status, "severity": F.when(n == 0, "info").when(alert, severity).otherwise("warning"), "alert": (n > 0) & alert})


def conflicting(assignments: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value, and these values in order."""
    return assignments.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values")).where(F.size("values") > 1).withColumn("n", F.size("values"))


def ordered_sample(rows: DataFrame, keys: list[Column], columns: list[str], n: int) -> DataFrame:
    """One row: a JSON array of the first n rows."""
    top = rows.orderBy(*keys).limit(n).select(*columns)
    return top.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))).alias("sample"))


def hash_anomalies(tables: dict[str, tuple[DataFrame, str]], samples: int = 3) -> DataFrame:
    """check, invalid, samples: values that should be 64 hex digits and aren't, by named (table, column)."""
    out = None
    for name, (df, column) in tables.items():
        part = df.where(F.col(column).isNotNull() & ~F.col(column).rlike("^[0-9a-f]{64}$")).select(F.lit(name).alias("check"), F.col(column).alias("v"))
        out = part if out is None else out.unionByName(part)
    # a rank with a limit is cut down before the shuffle, so no task sees all values of a check
    first = out.distinct().withColumn("r", F.row_number().over(Window.partitionBy("check").orderBy("v"))).where(F.col("r") <= samples)
    return out.groupBy("check").agg(F.count("*").alias("invalid")).join(first.groupBy("check").agg(F.array_sort(F.collect_list("v")).alias("samples")), "check")


def orphan_sessions(sessions: DataFrame, ts: str, before: Column, *evidence: DataFrame) -> DataFrame:
    """session_id of sessions up to a time for which no evidence (tables with session_id) exists."""
    known = reduce(DataFrame.union, [e.select("session_id") for e in evidence]).where("session_id is not null").distinct()
    return sessions.where(F.col(ts) < before).join(known, "session_id", "left_anti").select("session_id")


def counted_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """One row: the number of rows and the first n keys in order."""
    first = rows.orderBy(key).limit(n).agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("sample"))
    return rows.agg(F.count("*").alias("discrepancies")).join(F.broadcast(first))


def last_observed(session: DataFrame, *sources: tuple[DataFrame, str]) -> DataFrame:
    """session_id, last_observed: the latest time that any source has for a session."""
    out = session.select("session_id")
    names = []
    for i, (df, ts) in enumerate(sources):
        names.append(f"__t{i}")
        out = out.join(df.groupBy("session_id").agg(F.max(ts).alias(names[-1])), "session_id", "left")
    return out.select("session_id", (F.greatest(*names) if len(names) > 1 else F.col(names[0])).alias("last_observed"))


def retention_sweep(touches: DataFrame, sessions: DataFrame, links: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Touches and sessions that go: retained until before the cutoff and not linked to an order.

    A session goes only when none of its touches is left.
    """
    linked = links.select("session_id").distinct()
    gone = touches.where(F.col("retained_until") < cutoff).join(linked, "session_id", "left_anti")
    left = touches.where(~(F.col("retained_until") < cutoff)).select("session_id").union(touches.join(linked, "session_id", "left_semi").select("session_id")).distinct()
    sessions_gone = sessions.where(F.col("retained_until") < cutoff).join(linked, "session_id", "left_anti").join(left, "session_id", "left_anti")
    return gone, sessions_gone


def completeness(scope: DataFrame, results: DataFrame) -> DataFrame:
    """total, missing, with_attribution, rate over the orders in scope; an empty scope is complete."""
    fields = ["session_id", "source", "medium", "campaign", "content", "term", "click_value"]
    none = F.lit(True)
    for f in fields:
        none = none & F.col(f).isNull()
    out = scope.select("order_id").join(results.select("order_id", *fields, F.lit(True).alias("__has")), "order_id", "left")
    counted = out.agg(F.count("*").alias("total"), F.count_if(F.col("__has").isNull() | none).alias("missing"))
    have = F.col("total") - F.col("missing")
    return counted.select("total", "missing", have.alias("with_attribution"), F.when(F.col("total") > 0, have / F.col("total")).otherwise(1.0).alias("rate"))


def processed_counts(expected: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """key, expected, processed, remaining, matches of a backfill's sources."""
    done = processed.groupBy(key).agg(F.count("*").alias("processed"))
    out = expected.groupBy(key).agg(F.count("*").alias("expected")).join(done, key, "left").withColumn("processed", F.coalesce("processed", F.lit(0).cast("long")))
    return out.select(key, "expected", "processed", F.greatest(F.col("expected") - F.col("processed"), F.lit(0)).alias("remaining"), (F.col("expected") == F.col("processed")).alias("matches"))


def backlog(jobs: DataFrame, as_of: Column, stale_seconds: int) -> DataFrame:
    """pending, oldest_seconds, stale: of a queue at a time."""
    age = F.timestamp_diff("SECOND", F.col("available_at"), as_of)
    pending = F.col("status") == "pending"
    held = F.timestamp_diff("SECOND", F.col("locked_at"), as_of) > stale_seconds
    return jobs.agg(F.count_if(pending).alias("pending"), F.coalesce(F.max(F.when(pending, age)), F.lit(0).cast("long")).alias("oldest_seconds"), F.count_if((F.col("status") == "processing") & held).alias("stale"))


def enqueue(jobs: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """The queue after requests: a key has one job; one that is being processed stays so, any other becomes pending."""
    asked = requests.groupBy("queue_key").agg(F.max_by("reason", "ordinal").alias("new_reason"))
    out = jobs.join(asked, "queue_key", "full_outer")
    wanted, busy = F.col("new_reason").isNotNull(), F.coalesce(F.col("status") == "processing", F.lit(False))
    return out.select(
        "queue_key", F.coalesce("new_reason", "reason").alias("reason"), F.when(wanted & ~busy, "pending").otherwise(F.col("status")).alias("status"),
        F.when(wanted & ~busy, as_of).otherwise(F.col("available_at")).alias("available_at"), F.coalesce("attempts", F.lit(0)).alias("attempts"), "locked_at",
    )


def settled(jobs: DataFrame, outcomes: DataFrame, as_of: Column, base_seconds: int, cap_seconds: int, most_attempts: int) -> DataFrame:
    """The queue after outcomes (queue_key, ok): completed, pending again after a backoff that doubles, or dead after too many attempts."""
    out = jobs.join(outcomes, "queue_key", "left")
    tries = F.col("attempts") + F.col("ok").isNotNull().cast("int")
    wait = F.least(F.lit(float(base_seconds)) * F.pow(F.lit(2.0), tries - 1), F.lit(float(cap_seconds)))
    failed = ~F.col("ok")
    status = F.when(F.col("ok").isNull(), F.col("status")).when(F.col("ok"), "completed").when(tries >= most_attempts, "dead_letter").otherwise("pending")
    later = as_of + F.make_dt_interval(secs=wait)
    return out.select("queue_key", "reason", status.alias("status"), F.when(failed & (tries < most_attempts), later).otherwise(F.col("available_at")).alias("available_at"), tries.alias("attempts"))


def dead_letters(old: DataFrame, failures: DataFrame) -> DataFrame:
    """identity, failures, first_failed, last_failed, last_error after further failures (identity, at, error)."""
    rows = failures.select("identity", F.lit(1).cast("long").alias("failures"), F.col("at").alias("first_failed"), F.col("at").alias("last_failed"), F.col("error").alias("last_error"))
    both = old.select(rows.columns).unionByName(rows)
    return both.groupBy("identity").agg(F.sum("failures").alias("failures"), F.min("first_failed").alias("first_failed"), F.max("last_failed").alias("last_failed"), F.max_by("last_error", F.struct("last_failed", "last_error")).alias("last_error"))


def splits(values: DataFrame, column: str, bins: int) -> list:
    """At most ``bins`` - 1 ascending values that part the column into ranges of about equal numbers; from a sketch of bounded size."""
    found = values.agg(F.percentile_approx(column, [i / bins for i in range(1, bins)], 10 * bins)).first()[0]
    return sorted(set(found or []))


def nearest_rank(values: DataFrame, column: str, shares: list[float], bins: int = 1_000, bin_rows: int = 1_000_000) -> DataFrame:
    """One row with the nearest-rank percentiles p50, p95, ...: the smallest value that at least that share of the values doesn't exceed.

    A sketch parts the values into ranges, whose exact counts tell the range of each rank; only that range
    is looked at, parted anew while it has more than ``bin_rows`` different values.  So no task holds more than a range, and values that
    are equal count as one.  Nulls are left out; without values all are null.
    """
    rows = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    total = values.agg(F.count(column)).first()[0]
    kind, out = values.schema[column].dataType, {}
    for share in shares:
        name, inside, before = f"p{round(share * 100)}", rows, 0
        rank = max(1, math.ceil(share * total - 1e-9))
        while total and inside.count() > bin_rows:
            cuts = splits(inside, column, bins)
            bin_of = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(column)))
            counts = sorted((r["bin"], r["n"]) for r in inside.groupBy(bin_of.alias("bin")).agg(F.sum("__n").alias("n")).collect())
            for number, n in counts:
                if before + n >= rank:
                    break
                before += n
            if len(counts) == 1:
                break  # the sketch tells no two values apart
            low, high = cuts[number - 1] if number else None, cuts[number] if number < len(cuts) else None
            inside = inside.where((F.lit(True) if low is None else F.col(column) > F.lit(low)) & (F.lit(True) if high is None else F.col(column) <= F.lit(high)))
        ranked = inside.withColumn("__upto", F.sum("__n").over(Window.orderBy(column)) + before)  # a range of at most bin_rows
        out[name] = ranked.where(F.col("__upto") >= rank).agg(F.min(column)).first()[0] if total else None
    return values.sparkSession.createDataFrame([tuple(out.values())], StructType([StructField(name, kind) for name in out]))
