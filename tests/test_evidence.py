"""As-of joins, hints, identity chains, sources, backfill and the ingested stream against plain versions."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark import storage
from tidemark.functions import text as T
from tidemark.operators import attribution as A
from tidemark.operators import backfill as B
from tidemark.operators import hints as H
from tidemark.operators import identity as I
from tidemark.sources import payloads as P
from tidemark.sources import views as V
from tidemark.streaming import ingest as N

AT = dt.datetime(2024, 1, 10)
TOUCH = "event_id long, session_id string, ts timestamp_ntz, token string, source string, medium string, campaign string, content string, term string, click_type string, click_value string"


def touch(event, hours, token, session="s"):
    return (event, session, AT + dt.timedelta(hours=hours), token, "google", None, None, None, None, None, None)


def test_as_of_join_like_brute_force(spark):
    rng = random.Random(3)
    touches = [touch(i, rng.randint(-400, 50), rng.choice("ab")) for i in range(200)] + [touch(900, -168, "edge"), touch(901, -169, "late"), touch(902, 0, "now"), touch(903, 0, "now"), touch(904, 1, "after")]
    orders = [(k, AT + dt.timedelta(hours=rng.randint(-100, 50)), rng.choice("ab")) for k in range(60)] + [(100 + k, AT, t) for k, t in enumerate(("edge", "late", "now", "after", None, "never"))]
    got = A.latest_by_token(spark.createDataFrame(orders, "order_id long, ts timestamp_ntz, token string"), spark.createDataFrame(touches, TOUCH), "token")
    want = {}
    for k, ts, token in orders:
        met = [t for t in touches if t[3] == token and ts - dt.timedelta(days=7) <= t[2] <= ts]
        if met:
            want[k] = max(met, key=lambda t: (t[2], t[0]))[0]
    assert {r["order_id"]: r["event_id"] for r in got.collect()} == want and 100 in want and 101 not in want and want[102] == 903


def test_as_of_join_makes_no_pairs(spark, capsys):
    sf = "/root/testdata/sf0.001"
    A.latest_by_token(V.orders(spark, sf), V.touches(spark, sf), "checkout_token").explain("formatted")
    plan = capsys.readouterr().out
    assert "Join" not in plan and "Window" in plan
    A.identity_sessions(V.orders(spark, sf), V.sessions(spark, sf)).explain("formatted")
    assert "__slot" in capsys.readouterr().out


def test_credits_of_all_models_keep_every_cent(spark):
    rng = random.Random(9)
    rows = []
    for order in range(40):
        n = rng.randint(1, 6)
        rows += [(order, rng.choice([0, 1, 99, 12345]), AT, AT - dt.timedelta(hours=10 * (n - i)), "x" if rng.random() < 0.3 else None, rng.random() < 0.3, i, n, i == n - 1) for i in range(n)]
    cents = {}
    rows = [(o, cents.setdefault(o, c), *rest) for o, c, *rest in rows]
    got = A.credits(spark.createDataFrame(rows, "order_id long, cents long, order_ts timestamp_ntz, ts timestamp_ntz, click_value string, is_direct boolean, position int, n int, is_winner boolean"))
    by = got.groupBy("order_id", "model").agg(F.sum("credit_cents").alias("c"), F.sum("weight").alias("w"), F.count_if("is_primary").alias("p"), F.min("credit_cents").alias("least")).collect()
    assert len(by) == 240 and all(r["c"] == cents[r["order_id"]] and r["p"] == 1 and r["least"] >= 0 and r["w"] == pytest.approx(1) for r in by)


def identity(spark, rows):
    schema = "record_id long, at timestamp_ntz, customer_id string, email_hash string, checkout_token string, cart_token string"
    found = I.nodes(spark.createDataFrame([(i, AT + dt.timedelta(hours=i), *keys) for i, keys in rows.items()], schema))
    return found, {r["record_id"]: (r["journey"], r["by"]) for r in I.assigned(found).collect()}


def test_chains_reach_their_customer(spark):
    _, got = identity(spark, {1: ("c1", None, "t1", None), 2: (None, None, "t1", "k1"), 3: (None, None, "t3", "k1"), 4: (None, None, "t9", None), 5: (None, None, "t9", "k9")})
    assert [got[i][0] for i in (1, 2, 3)] == ["customer:c1"] * 3 and got[3][1] == "chain"
    assert got[4] == got[5] == ("checkout_token:t9", "founded")


def test_shared_keys_are_quarantined_and_chains_of_two_customers_conflict(spark):
    found, got = identity(spark, {1: ("c1", "e", "t1", None), 2: ("c2", "e", "t2", None), 3: (None, "e", None, None), 4: (None, None, "t1", "k1"), 5: (None, None, "t2", "k2"), 6: (None, None, "t6", "k1"), 7: (None, None, "t6", "k2")})
    assert got[3] == (None, "none") and got[4][0] == "customer:c1" and got[5][0] == "customer:c2"
    assert got[6] == got[7] and got[6][1] == "conflict"
    journeys = I.assigned(found)
    edged = I.edges(found, journeys)
    bad = edged.where("conflict_code = 'quarantined'").select("node_key", "is_active").distinct().collect()
    assert [(r["node_key"], r["is_active"]) for r in bad] == [("e", False)]
    assert I.find_journey(edged, "checkout_token", "t1").first()["journey"] == "customer:c1"


def test_identity_ignores_the_order_of_arrival(spark):
    rng = random.Random(4)
    rows = {i: (rng.choice(["c1", "c2", None, None, None]), rng.choice(["e1", "e2", None]), rng.choice(["t1", "t2", "t3", "t4", None]), rng.choice(["k1", "k2", "k3", None])) for i in range(25)}
    rows = {i: k for i, k in rows.items() if any(k)}
    one = identity(spark, rows)[1]
    assert one == identity(spark, dict(reversed(rows.items())))[1]


def test_hint_sources_in_order(spark):
    pair = lambda **kv: [(k, v) for k, v in kv.items()]
    rows = [
        (1, pair(utm_source="fb"), pair(utm_source="google"), "https://x.example/?utm_source=bing&utm_medium=cpc"), (2, pair(app_utm_source=" "), pair(utm_source="Google"), None), (3, None, None, "/landing?gclid=abc#x"),
        (4, None, pair(page_url="https://x.example/?fbclid=q&utm_campaign=A%20b"), "https://x.example/?utm_term=T"), (5, pair(color="red"), None, "not a url at all"), (6, None, None, None),
    ]
    entries = "array<struct<name:string,value:string>>"
    got = {r["order_id"]: r for r in H.hints(spark.createDataFrame(rows, f"order_id long, note_attributes {entries}, attributes {entries}, landing_site string")).collect()}
    assert (got[1]["source"], got[1]["medium"], got[1]["confidence"]) == ("meta", "cpc", 0.4) and got[2]["source"] == "google"
    assert (got[3]["source"], got[3]["click_type"], got[3]["click_value"], got[3]["confidence"]) == ("google", "gclid", "abc", 0.55)
    assert (got[4]["source"], got[4]["campaign"], got[4]["term"]) == ("meta", "a b", "t") and set(got) == {1, 2, 3, 4}


def test_stable_json_and_maps(spark):
    body = {"b": [{"y": 1, "x": [None, True]}], "a": {"é": "ü", "c": -1.5}, "": ""}
    row = spark.createDataFrame([(json.dumps(body), '{"attributes": [{"name": "a", "value": 1}, {"name": "a", "value": "2"}, 5]}')], "j string, m string").select(P.stable_json(F.col("j")).alias("j"), P.stable_json(F.lit("{")).alias("bad"), H.attribute_map(F.lit('{"note_attributes": {"x": "1", "y": " "}, "attributes": []}')).alias("m")).first()
    assert json.loads(row["j"]) == body and row["j"] == json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False) and row["bad"] is None and row["m"] == {"x": "1"}


def test_strict_sources_name_the_problem(spark):
    good = {"eventType": "page_view", "occurredAt": "2024-01-01T00:00:00Z", "sessionId": "00000000-0000-4000-8000-000000000001", "pageUrl": "https://x.example/#a"}
    cases = {None: good, "unknown_field": good | {"z": 1}, "event_type": good | {"eventType": None}, "occurred_at": good | {"occurredAt": "2024-01-01T00:00:00"}, "session_id": good | {"sessionId": "1"}, "page_url": good | {"pageUrl": ""}, "referrer_url": good | {"referrerUrl": "data:x"}}
    rows = [(k or "good", json.dumps(v)) for k, v in cases.items()] + [("not_json", "{"), ("not_json", None), ("not_json", "[1]")]
    got = P.browser_events(spark.createDataFrame(rows, "want string, body string")).collect()
    assert all((r["problem"] or "good") == r["want"] for r in got)
    assert next(r for r in got if r["problem"] is None)["page_url"] == "https://x.example/"


def test_backfill_adds_only_what_is_missing(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "order_id long, source string")
    new = spark.createDataFrame([(2, "x"), (3, "c")], "order_id long, source string")
    assert sorted(map(tuple, B.backfilled(old, new).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert B.backfilled(old, new, dry_run=True).count() == 2
    assert sorted(map(tuple, B.replaced(old, new, ["order_id"]).collect())) == [(1, "a"), (2, "x"), (3, "c")]


def test_stream_of_batches_is_idempotent(spark, tmp_path):
    schema = "event_id long, client_event_id string, session_id string, ts timestamp_ntz, page string"
    at = lambda m: AT + dt.timedelta(minutes=m)
    one = spark.createDataFrame([(1, "x", "s", at(0), "/"), (2, "x", "s", at(1), "/"), (3, None, "s", at(2), "/p"), (4, None, "t", at(-3000), "/old"), (5, None, "t", at(60), "/soon")], schema)
    two = spark.createDataFrame([(6, "x", "s", at(3), "/"), (7, None, "s", at(2), "/p"), (8, "y", "u", at(4), "/")], schema)
    path, columns = str(tmp_path / "out"), ["session_id", "ts", "page"]
    as_of = F.lit(AT).cast("timestamp_ntz")
    for number, batch in ((0, one), (1, two), (1, two)):
        N.ingest(batch, path, number, columns, as_of)
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{path}/events").collect()) == [1, 3, 8]
    assert {r["event_id"]: r["outcome"] for r in spark.read.parquet(f"{path}/rejected").collect()} == {2: "duplicate", 4: "too_old", 5: "in_future", 6: "duplicate", 7: "duplicate"}
    assert {r["session_id"]: r["events"] for r in N.read_sessions(spark, f"{path}/sessions").collect()} == {"s": 2, "u": 1}


def test_text_functions(spark):
    row = spark.range(1).select(T.cents_text(F.lit(-5)).alias("a"), T.cents_text(F.lit(123456)).alias("b"), T.rate4(F.lit(1), F.lit(3)).alias("c"), T.rate4(F.lit(1), F.lit(0)).alias("d"), T.resolved_url(F.lit("../x"), "https://a.example/b/c").alias("e")).first()
    assert row["a"] == "-0.05" and row["b"] == "1234.56" and row["c"] == 0.3333 and row["d"] is None and row["e"] == "https://a.example/b/../x"


def test_shared_folder_is_needed_on_a_cluster():
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext = Context

        class conf:  # noqa: N801
            get = staticmethod(lambda key, other: None)

    with pytest.raises(ValueError, match="share"):
        storage.shared_dir(Session)


def test_records_without_a_key_are_dealt_out(spark):
    """a join by a key that is null sent all records without it to one task."""
    ids = spark.createDataFrame([(k, f"e{k}", f"c{k}") for k in range(50)], "identity_id long, email_hash string, customer_id string")
    rows = [(k, f"e{k % 90}" if k % 4 == 0 else None, f"c{k % 80}" if k % 9 == 0 else None) for k in range(4_000)]
    incoming = spark.createDataFrame(rows, "record_id long, email_hash string, customer_id string")
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    was = [spark.conf.get(n) for n in names]
    try:
        for name, value in zip(names, ("false", "-1"), strict=True):
            spark.conf.set(name, value)
        sizes = [r["count"] for r in I.stitch(ids, incoming).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name, value in zip(names, was, strict=True):
            spark.conf.set(name, value)
    assert sum(sizes) == 4_000 and max(sizes) < 2_000
