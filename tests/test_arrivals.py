"""The ordered fold of identity evidence: cases whose outcome depends on order, and cuts that must not change it."""

import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators import arrivals as A
from tidemark.operators import identity as I

DAY = datetime(2026, 4, 22)
KINDS = "record_id long, at timestamp_ntz, customer_id string, email_hash string, phone_hash string, checkout_token string, cart_token string, session_id string"


def found(spark, *records):
    """records: (hour, keys...), numbered from 1."""
    names = KINDS.replace(",", "").split()[4::2]
    rows = [(k, DAY + timedelta(hours=hour) if hour is not None else None, *[keys.get(n) for n in names]) for k, (hour, keys) in enumerate(records, 1)]
    return I.nodes(spark.createDataFrame(rows, KINDS))


def logged(spark, *records, **more):
    log, state = A.folded(found(spark, *records), **more)
    return {r["record_id"]: r for r in log.collect()}, {(r["node_type"], r["node_key"]): r for r in state.edges.collect()}, {r["journey"]: r for r in state.journeys.collect()}


def test_authority_takes_over_what_was_anonymous(spark):
    log, edges, journeys = logged(spark, (9, {"session_id": "s", "checkout_token": "t"}), (10, {"customer_id": "c", "checkout_token": "t"}))
    assert [log[k]["journey"] for k in (1, 2)] == ["j1", "j1"] and log[2]["reason"] == "reused_journey" and log[2]["attached"] == 1
    assert journeys["j1"]["customer"] == "c" and edges["customer_id", "c"]["kind"] == "authoritative"


def test_authority_rehomes_weaker_keys_and_merges_the_emptied_journey(spark):
    log, edges, journeys = logged(spark, (9, {"customer_id": "c"}), (10, {"checkout_token": "t"}), (11, {"customer_id": "c", "checkout_token": "t"}))
    assert log[3]["journey"] == "j1" and log[3]["reason"] == "authority" and log[3]["merged"] == ["j2"]
    assert journeys["j2"]["merged_into"] == "j1" and edges["checkout_token", "t"]["kind"] == "promoted"


def test_strongest_key_wins_without_authority_and_order_decides(spark):
    log, _, _ = logged(spark, (9, {"email_hash": "e"}), (10, {"checkout_token": "t"}), (11, {"email_hash": "e", "checkout_token": "t"}))
    assert log[3]["journey"] == "j1" and log[3]["reason"] == "precedence" and [x["from_journey"] for x in log[3]["rehomed"]] == ["j2"]
    log, _, _ = logged(spark, (11, {"email_hash": "e"}), (10, {"checkout_token": "t"}), (9, {"email_hash": "e", "checkout_token": "t"}))
    assert {log[k]["journey"] for k in (1, 2, 3)} == {"j3"} and not log[1]["rehomed"]


@pytest.mark.parametrize("kind", ["phone_hash", "email_hash"])
def test_shared_hash_is_quarantined_from_then_on(spark, kind):
    log, edges, _ = logged(spark, (9, {"customer_id": "a", kind: "h"}), (10, {"customer_id": "b"}), (11, {"customer_id": "b", kind: "h"}), (12, {"customer_id": "d", kind: "h"}))
    assert log[3]["journey"] == "j2" and [x["node_key"] for x in log[3]["quarantined"]] == ["h"] and not log[3]["merged"]
    assert edges[kind, "h"]["kind"] == "quarantined" and edges[kind, "h"]["journey"] == "j1"
    assert log[4]["journey"] == "j4" and log[4]["reason"] == "created_new_journey" and log[4]["attached"] == 1


def test_two_authorities_stop_a_record(spark):
    log, edges, _ = logged(spark, (9, {"customer_id": "a", "checkout_token": "t"}), (10, {"customer_id": "b", "cart_token": "k"}), (11, {"customer_id": "b", "checkout_token": "t"}), (12, {"checkout_token": "t", "cart_token": "k"}))
    for k in (3, 4):
        assert log[k]["outcome"] == "conflict" and log[k]["customers"] == ["a", "b"] and log[k]["journey"] is None
    assert edges["checkout_token", "t"]["journey"] == "j1"


def test_late_times_widen_an_edge(spark):
    _, edges, _ = logged(spark, (50, {"session_id": "s"}))
    log, state = A.folded(found(spark, (50, {"session_id": "s"})))
    _, state = A.folded(found(spark, (50, {"session_id": "x"}), (3, {"session_id": "s", "cart_token": "k"})), state)
    edge = {r["node_key"]: r for r in state.edges.collect()}["s"]
    assert edge["first_at"] == DAY + timedelta(hours=3) and edge["last_at"] == DAY + timedelta(hours=50)


def random_records(n, seed):
    pick = random.Random(seed)
    sizes = {"customer_id": 6, "email_hash": 8, "phone_hash": 8, "checkout_token": 20, "cart_token": 20, "session_id": 30}
    return [(pick.randrange(500) if pick.random() < 0.95 else None, {k: f"{k[0]}{pick.randrange(n)}" for k, n in sizes.items() if pick.random() < 0.35}) for _ in range(n)]


def plain(records):
    """One fold over everything in order, without parts."""
    rows = sorted(((k, hour, keys) for k, (hour, keys) in enumerate(records, 1) if keys), key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    fold = A.Fold()
    return {k: fold.take(k, DAY + timedelta(hours=h) if h is not None else None, sorted((t, v, I.PRECEDENCE[t]) for t, v in keys.items())) for k, h, keys in rows}, fold


@pytest.mark.parametrize("part_rows", [1_000_000, 45])
def test_parts_and_cuts_of_time_change_nothing(spark, part_rows):
    records = random_records(120, 3)
    want, fold = plain(records)
    log, edges, journeys = logged(spark, *records, part_rows=part_rows)
    assert {k: (r["outcome"], r["reason"], r["journey"], r["attached"], r["merged"], [x["node_key"] for x in r["rehomed"]], [x["node_key"] for x in r["quarantined"]]) for k, r in log.items()} == {
        k: (r["outcome"], r["reason"], r["journey"], r["attached"], r["merged"], [x["node_key"] for x in r["rehomed"]], [x["node_key"] for x in r["quarantined"]]) for k, r in want.items()
    }
    assert {n: (e["journey"], e["kind"], e["last_at"]) for n, e in edges.items()} == {n: (e.journey, e.kind, e.last_at) for n, e in fold.edges.items()}
    assert {j: (r["customer"], r["merged_into"], r["version"]) for j, r in journeys.items()} == {j: (c, fold.merged_into.get(j), fold.version[j]) for j, c in fold.customer.items()}
    assert {r["outcome"] for r in want.values()} == {"linked", "conflict"} and any(r["quarantined"] for r in want.values()) and any(r["merged"] for r in want.values())


def test_nothing_and_records_without_keys(spark):
    assert logged(spark, (1, {})) == ({}, {}, {})
