"""Tables kept up to date: versions, crashes, repeated runs, change sets against full rebuilds, and a stream that is killed."""

import datetime as dt
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import identity as I
from tidemark.operators import refresh as U
from tidemark.operators import reporting as R
from tidemark.sources.versions import Versioned, exists
from tidemark.streaming import ingest as N

AT = dt.datetime(2024, 1, 10)


def table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], "id long, day string, v string")
    out = Versioned(spark, str(tmp_path / "t"), rows.schema, "day")
    out.replace(rows, None, "first")
    return out


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_parts_are_replaced_as_a_unit(spark, tmp_path):
    t = table(spark, tmp_path)
    new = spark.createDataFrame([(1, "a", "new")], t.schema)
    assert t.merge(new, spark.createDataFrame([(1,)], "id long"), ["a"], "second") == 2
    assert rows(t.read()) == [(1, "a", "new"), (2, "a", "y"), (3, "b", "z")] and rows(t.read(version=1))[0] == (1, "a", "x")
    assert t.replace(new, ["a"], "second") == 2 and t.version() == 2  # the run is known
    assert t.replace(new.limit(0), ["a"], "third") == 3 and rows(t.read()) == [(3, "b", "z")]
    assert t.replace(new.limit(0), None, "fourth") == 4 and not rows(t.read()) and rows(t.history())[-1] == (4, "fourth", 0)
    with pytest.raises(ValueError, match="outside"):
        t.replace(new, ["b"], "fifth")


def test_writer_that_dies_before_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)

    def dies(self):
        raise RuntimeError("killed")

    monkeypatch.setattr(Versioned, "version", dies)
    with pytest.raises(RuntimeError):
        t.replace(spark.createDataFrame([(9, "b", "new")], t.schema), ["b"], "second")
    monkeypatch.undo()
    assert t.version() == 1 and (3, "b", "z") in rows(t.read())


def test_manifest_that_was_broken_off_is_passed_over(spark, tmp_path):
    t = table(spark, tmp_path)
    (tmp_path / "t/manifests/version=2/_temporary").mkdir(parents=True)
    assert t.version() == 1 and t.replace(spark.createDataFrame([(9, "b", "new")], t.schema), ["b"], "second") == 3
    assert rows(t.read()) == [(1, "a", "x"), (2, "a", "y"), (9, "b", "new")]
    stale = Versioned(spark, t.path, t.schema, t.part)
    stale.version = lambda real=t.version, seen=iter([1]): next(seen, None) or real()
    with pytest.raises(RuntimeError, match="another writer"):
        stale.replace(spark.createDataFrame([(8, "b", "late")], t.schema), ["b"], "late")


def test_only_wanted_parts_are_read(spark, tmp_path):
    t = table(spark, tmp_path)
    files = t.read(["b"]).inputFiles()
    plan = t.read(["b"])._jdf.queryExecution().toString()
    assert len(files) >= 1 and "PartitionFilters: [" in plan and "day#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_broken_path_is_not_an_empty_table(spark, tmp_path):
    assert not exists(spark, str(tmp_path / "none"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/part-0.parquet").write_text("no parquet")
    assert exists(spark, str(tmp_path / "bad"))


def world(spark, seed, batches):
    """Random touches, orders and spend, each with the batch it arrives with."""
    pick = random.Random(seed)
    at = lambda: AT + dt.timedelta(minutes=pick.randrange(12 * 1440))
    touches, orders = [], []
    for k in range(160):
        user, ts = pick.randrange(12), at()
        source = pick.choice(["google", "meta", None])
        touches.append((k, user, ts, f"{user}:{ts.date()}", source, source and "cpc", source and f"c{k % 3}", None, None, None, None, f"t{pick.randrange(25)}", f"k{pick.randrange(25)}", pick.randrange(batches)))
    for k in range(60):
        user, ts = pick.randrange(12), at()
        orders.append((k, user, ts, pick.randrange(500, 9000), pick.choice(["web", "web", "pos"]), f"t{pick.randrange(25)}", f"k{pick.randrange(25)}", f"{user}:{ts.date()}", ts.date(), pick.randrange(batches)))
    spend = [(dt.date(2024, 1, 10 + k % 12), k % 2, f"g{k % 3}", f"e{k}", pick.choice(["google", "meta"]), pick.choice(["creative", "campaign"]), "google", "cpc", f"c{k % 3}", pick.randrange(900), 3, 50, pick.randrange(batches)) for k in range(40)]
    kinds = (
        "event_id long, user_id long, ts timestamp_ntz, session_id string, source string, medium string, campaign string, content string, term string, click_type string, click_value string, checkout_token string, cart_token string, batch int",
        "order_id long, user_id long, ts timestamp_ntz, cents long, source_name string, checkout_token string, cart_token string, session_id string, order_date date, batch int",
        "report_date date, connection_id int, campaign_id string, entity_id string, platform string, granularity string, source string, medium string, campaign string, cents long, clicks long, impressions long, batch int",
    )
    return [spark.createDataFrame(r, k).cache() for r, k in zip((touches, orders, spend), kinds, strict=True)]


def sessions(touches):
    first = F.min_by(F.struct("event_id", *R.DIMENSIONS, "click_type", "click_value"), F.struct("ts", "event_id"))
    return touches.groupBy("session_id", "user_id").agg(first.alias("first"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")).select("session_id", "user_id", "first_seen", "last_seen", "first.*")


def test_change_sets_give_the_cube_of_a_full_rebuild(spark, tmp_path):
    batches = 5
    touches, orders, spend = world(spark, 7, batches)
    upto = lambda df, b: df.where(F.col("batch") <= b).drop("batch")
    data = lambda b: U.Data(upto(touches, b), sessions(upto(touches, b)), upto(orders, b), upto(spend, b))
    tables = U.tables_for(spark, data(0), str(tmp_path))
    U.create(tables, data(0), "first")
    for b in range(1, batches):
        new = [df.where(F.col("batch") == b).drop("batch") for df in (touches, orders, spend)]
        if b == batches - 1:
            new = [new[0].limit(1), new[1].limit(0), new[2].limit(0)]
            now = U.Data(upto(touches, b - 1).union(new[0]), sessions(upto(touches, b - 1).union(new[0])), upto(orders, b - 1), upto(spend, b - 1))
        else:
            now = data(b)
        days = U.refresh(tables, now, data(b - 1).sessions, *new, f"batch {b}")
        want = R.cube(now.sessions, now.credits(now.orders), now.orders, now.spend)
        assert rows(tables.cube.read().select(want.columns)) == rows(want)
    assert 0 < len(days) < 12  # the last change set is one touch
    was = tables.cube.version()
    U.refresh(tables, now, data(batches - 2).sessions, *new, f"batch {batches - 1}")
    assert tables.cube.version() == was


EVENT = "event_id long, client_event_id string, session_id string, ts timestamp_ntz, page string, received_at timestamp_ntz"


def test_a_copy_that_is_too_old_does_not_block_a_good_one(spark):
    day = dt.timedelta(days=1)
    events = spark.createDataFrame([(1, "x", "s", AT - 2 * day, "/", AT), (2, "x", "s", AT, "/", AT), (3, "x", "s", AT, "/", AT), (4, "x", "s", AT + day, "/", AT)], EVENT)
    judged = N.judged_batch(N.identified(events, ["page"]), N.identified(events.limit(0), ["page"]), F.col("received_at"), "event_id")
    assert {r["event_id"]: r["outcome"] for r in judged.collect()} == {1: "too_old", 2: "accepted", 3: "duplicate", 4: "in_future"}


def test_known_events_stay_bounded_over_a_month(spark, tmp_path):
    path, seen = str(tmp_path), []
    for number in range(30):
        now = AT + dt.timedelta(days=number)
        batch = spark.createDataFrame([(k, f"e{number - k % 2}-{k % 8}", "s", now - dt.timedelta(hours=k % 20), "/", now) for k in range(16)], EVENT)
        if number % 6 == 0 or number > 26:
            seen.append(N.known_events(spark, path, batch, F.col("received_at"), number).count())
        N.ingest(batch, path, number, ["page"], F.col("received_at"))
    assert max(seen) <= 4 * 16
    ids = [r[0] for r in spark.read.parquet(f"{path}/events").select("event_key").collect()]
    assert len(ids) == len(set(ids)) and len(ids) >= 30 * 4


SCRIPT = """
import os, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import functions as F
from tidemark.session import local_session
from tidemark.streaming import ingest as N
spark = local_session(2, 2, "1g")
source, out, dies = sys.argv[2:]
def put(batch, number):
    N.ingest(batch, out, number, ["page"], F.col("received_at"))
    if dies == f"{number}+":  # after all is written, before the stream commits the batch
        os._exit(9)
stream = spark.readStream.schema("%s").option("maxFilesPerTrigger", 1).parquet(source)
stream.writeStream.foreachBatch(put).option("checkpointLocation", out + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
""" % EVENT


def test_stream_that_is_killed_gives_the_rows_of_one_that_is_not(spark, tmp_path):
    for k in range(3):
        batch = [(100 * k + i, f"e{(i + 5 * k) % 12}", f"s{i % 3}", AT + dt.timedelta(minutes=i), "/", AT + dt.timedelta(hours=k)) for i in range(10)]
        spark.createDataFrame(batch, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    root = str(Path(__file__).resolve().parents[1])
    run = lambda out, dies: subprocess.run([sys.executable, str(script), root, str(tmp_path / "in"), str(tmp_path / out), dies], capture_output=True, timeout=300).returncode
    assert run("whole", "-") == 0
    assert run("killed", "1+") == 9 and run("killed", "-") == 0
    of = lambda out: [rows(spark.read.parquet(f"{tmp_path / out}/{name}").drop("batch")) for name in ("events", "seen", "sessions", "rejected")]
    assert of("whole") == of("killed")
    ids = [r["event_key"] for r in spark.read.parquet(str(tmp_path / "killed/events")).collect()]
    assert sorted(ids) == sorted({f"e{k}" for k in range(12)})


def test_changed_customers_give_the_journeys_of_a_full_rebuild(spark, tmp_path):
    batches = 4
    touches, orders, _ = world(spark, 11, batches)
    touches = touches.withColumn("event_type", F.element_at(F.array(*[F.lit(x) for x in ("view", "click", "signup")]), (F.col("event_id") % 3 + 1).cast("int")))
    upto = lambda df, b: df.where(F.col("batch") <= b).drop("batch")
    data = lambda b: (sessions(upto(touches, b)), upto(touches, b), upto(orders, b))
    first = U.facts_of(*data(0))
    table = U.facts_table(spark, first, str(tmp_path))
    table.replace(first, None, "first")
    for b in range(1, batches):
        one = F.col("user_id") == 3 if b == batches - 1 else F.lit(True)  # the last change set is one customer's
        touches, orders = (df.where((F.col("batch") < batches - 1) | one) for df in (touches, orders)) if b == batches - 1 else (touches, orders)
        new = touches.where(F.col("batch") == b).select("user_id").union(orders.where(F.col("batch") == b).select("user_id"))
        parts = U.refresh_facts(table, *data(b), new, f"batch {b}")
        want = U.facts_of(*data(b))
        assert rows(table.read().select(want.columns)) == rows(want)
    assert len(parts) == 1


def test_hubs_and_pages_grow_with_rows_not_with_pairs(spark):
    n = 20_000
    records = spark.range(n).select(F.col("id").alias("record_id"), F.lit("hot").alias("checkout_token"), F.concat(F.lit("s"), (F.col("id") % 5_000).cast("string")).alias("visit"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("x"), F.col("id").cast("string"))).alias("session_id"))
    hubs = I.evidence_hubs(records)
    assert hubs.count() == n + 5_000 + 2 * (n // 2)
    edged = records.select(F.lit("one").alias("journey"), (F.col("record_id") % 3 > 0).alias("is_active"), F.lit(20).alias("precedence"), F.lit("session_id").alias("node_type"), F.col("record_id").cast("string").alias("node_key"))
    timed = records.select(F.lit("one").alias("journey"), F.lit(AT).cast("timestamp_ntz").alias("at"), F.col("record_id").cast("string").alias("id"))
    pages = I.journey_pages(edged, timed.limit(7), timed.limit(0), 500).collect()
    by = {(r["section"], r["page"]): r for r in pages}
    assert sorted(by) == sorted([("edges", p) for p in range(40)] + [("sessions", 0)]) and all(len(r["entries"]) <= 500 and r["pages"] == (40 if r["section"] == "edges" else 1) for r in pages)
    order = [e for p in range(40) for e in by["edges", p]["entries"]]
    assert order == [f"session_id:{k}" for k in sorted(range(n), key=lambda k: (k % 3 == 0, f"session_id:{k}"))]
