"""Golden vectors, invariants, upserts and the stream."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import attribution as A
from tidemark.operators import quality as Q
from tidemark.operators import reporting as R
from tidemark.operators import spend as S
from tidemark.sources import sinks as K
from tidemark.sources import views as V
from tidemark.streaming import ingest as N

DAY = dt.timedelta(days=1)
ORDER_AT = dt.datetime(2024, 1, 10)
TOUCHED = "order_id long, cents long, order_ts timestamp_ntz, ts timestamp_ntz, click_value string, is_direct boolean, position int, n int, is_winner boolean"


def touches(spark, cents, ages, clicks=(), directs=()):
    n = len(ages)
    rows = [(1, cents, ORDER_AT, ORDER_AT - a * DAY, "x" if i in clicks else None, i in directs, i, n, i == n - 1) for i, a in enumerate(ages)]
    return spark.createDataFrame(rows, TOUCHED)


@pytest.mark.parametrize(
    "model, cents, ages, options, want",
    [
        ("linear", 10_000, [2, 1, 0], {}, [3334, 3333, 3333]),
        ("time_decay", 10_000, [2, 1, 0], {"half_life_days": 1}, [1429, 2857, 5714]),
        ("position_based", 10_000, [3, 2, 1, 0], {}, [4000, 1000, 1000, 4000]),
        ("first_touch", 10_000, [3, 2], {}, [10_000, 0]),
        ("last_touch", 10_000, [3, 2], {}, [0, 10_000]),
    ],
)
def test_credit_vectors(spark, model, cents, ages, options, want):
    rows = A.credits(touches(spark, cents, ages), [model], **options).orderBy("position").collect()
    assert [r["credit_cents"] for r in rows] == want
    assert sum(r["is_primary"] for r in rows) == 1


def test_rule_based_vector(spark):
    rows = A.credits(touches(spark, 9_000, [2, 1, 0], clicks=(2,), directs=(1,)), ["rule_based_weighted"], rule=(0.2, 0.3, 0.5), click_bonus=2.0, direct_discount=0.5)
    assert [r["credit_cents"] for r in rows.orderBy("position").collect()] == [1333, 1000, 6667]


def test_kpi_vector(spark):
    row = dict.fromkeys(R.MEASURES, 0) | {"visits": 240, "orders_e8": 1_200_000_000, "revenue_cents": 138_000, "spend_cents": 36_000, "clicks": 96, "impressions": 4800, "new_orders_e8": 900_000_000, "returning_orders_e8": 300_000_000}
    got = R.kpis(spark.createDataFrame([row], ", ".join(f"{m} long" for m in R.MEASURES))).first()
    assert (got["conversion_rate"], got["cac"], got["blended_cac"], got["average_order_value"], got["click_through_rate"], got["new_customer_rate"]) == (0.05, 40.0, 30.0, 115.0, 0.02, 0.75)
    assert got["roas"] == pytest.approx(3.8333333333333335)


def test_window_edges_are_inclusive(spark):
    rows = spark.createDataFrame([(ORDER_AT - 7 * DAY,), (ORDER_AT,), (ORDER_AT - 7 * DAY - dt.timedelta(microseconds=1),)], "ts timestamp_ntz")
    assert [r[0] for r in rows.select(A.within_days(F.col("ts"), F.lit(ORDER_AT).cast("timestamp_ntz"))).collect()] == [True, True, False]


def test_campaign_rows_count_only_without_creatives(spark):
    d = dt.date(2024, 1, 1)
    rows = [(d, 1, "google", "campaign", "pmax", 3520), (d, 1, "google", "campaign", "search", 1000), (d, 1, "google", "creative", "search", 1000)]
    got = R.counted_spend(spark.createDataFrame(rows, "report_date date, connection_id int, platform string, granularity string, campaign_id string, cents long"))
    assert {r["campaign_id"]: r["cents"] for r in got.collect()} == {"pmax": 3520, "search": 1000}


def test_anomalies(spark):
    rows = [(dt.date(2024, 1, i), 100, 10) for i in range(1, 5)] + [(dt.date(2024, 1, 5), 42, 10)]
    got = Q.anomalies(spark.createDataFrame(rows, "metric_date date, visits long, orders long"), "2024-01-05", ["visits", "orders"]).collect()
    assert [(r["metric"], r["relative_delta"]) for r in got] == [("visits", pytest.approx(0.58))]


def test_order_values_choose_action_type(spark):
    rows = [(1, 1, "actions", "x_purchase", "2"), (1, 2, "action_values", "omni_purchase", "1.50"), (1, 3, "action_values", "omni_purchase", "bad"), (2, 1, "actions", "y_purchase", "3"), (3, 1, "actions", "click", "9")]
    got = {r["k"]: (r["action_type_used"], r["selection"], r["value_cents"], r["purchases"]) for r in S.order_values(spark.createDataFrame(rows, "k int, at int, kind string, action_type string, value string"), ["k"]).collect()}
    assert got == {1: ("omni_purchase", "priority", 150, None), 2: ("y_purchase", "fallback", None, 3), 3: (None, "none", None, None)}


def test_replace_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    K.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "d int, v string"), path, ["d"])
    K.replace_partitions(spark.createDataFrame([(2, "c")], "d int, v string"), path, ["d"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("d", "v").collect()) == [(1, "a"), (2, "c")]


def test_stream_drops_repeats_and_merges_sessions(spark, tmp_path):
    schema = "event_id long, session_id string, ts timestamp"
    rows = [(1, "s", ORDER_AT), (1, "s", ORDER_AT), (2, "s", ORDER_AT + dt.timedelta(minutes=5)), (3, "t", ORDER_AT)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = N.deduplicated(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["event_id"])
    N.write_sessions(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert {r["session_id"]: r["events"] for r in N.read_sessions(spark, str(tmp_path / "out")).collect()} == {"s": 2, "t": 1}


def test_credits_sort_no_rows_for_windows(spark, capsys):
    """A window for each model's order held the rows of a task in one more sort each."""
    rows = touches(spark, 10_000, [2, 1, 0])
    A.credits(rows).explain()
    plan = capsys.readouterr().out
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_credits_of_nulls_and_remainders(spark):
    assert [r["credit_cents"] for r in A.credits(touches(spark, None, [2, 1]), ["linear"]).collect()] == [None, None]
    got = A.credits(touches(spark, -5, [3, 2, 1, 0]), ["linear"]).orderBy("position").collect()
    assert [r["credit_cents"] for r in got] == [-1, -1, -1, -2] and [r["is_primary"] for r in got] == [True, False, False, False]
    assert [r["credit_cents"] for r in A.credits(touches(spark, 8, [3, 2, 1, 0]), ["linear"]).collect()] == [2, 2, 2, 2]


def test_tokens_are_met_by_numbers(spark, capsys):
    """Whole touches were put in order with the orders, twice for each token."""
    sf = "/root/testdata/sf0.001"
    found = A.latest_by_tokens(V.orders(spark, sf), V.touches(spark, sf), ["checkout_token", "cart_token"])
    found.explain("formatted")
    windows = [x for x in capsys.readouterr().out.split("\n\n") if x.strip().split("\n")[0].endswith(") Window")]
    assert len(windows) == 2 and not any(c in w for w in windows for c in ("campaign", "click_value", "session_id"))
    for token in ("checkout_token", "cart_token"):
        whole = A.latest_by_token(V.orders(spark, sf), V.touches(spark, sf), token)
        assert sorted(map(str, whole.collect())) == sorted(map(str, found.where(F.col("evidence") == token).drop("evidence").collect()))


def test_tokens_of_touches_that_share_an_event_or_have_none(spark):
    at = ORDER_AT.isoformat()
    rows = [(1, 5, "a", 2), (1, 5, "b", 1), (2, None, "c", 1), (3, 7, "d", 0)]
    touched = spark.createDataFrame(rows, "t int, event_id long, session_id string, days int").selectExpr("event_id", "session_id", f"timestamp_ntz '{at}' - make_dt_interval(days) as ts", *[f"cast(null as string) as {c}" for c in ("source", "medium", "campaign", "content", "term", "click_type", "click_value")], "cast(t as string) as checkout_token", "cast(null as string) as cart_token")
    orders = spark.createDataFrame([(10, "1"), (11, "2"), (12, "3"), (13, None)], "order_id long, checkout_token string").selectExpr("*", f"timestamp_ntz '{at}' as ts", "cast(null as string) as cart_token")
    got = A.latest_by_tokens(orders, touched, ["checkout_token", "cart_token"]).collect()
    assert sorted((r["order_id"], r["session_id"], r["evidence"]) for r in got) == [(10, "b", "checkout_token"), (11, "c", "checkout_token"), (12, "d", "checkout_token")]


def test_cube_of_one_model_credits_that_model_alone(spark, capsys):
    """All six models were credited and five of them dropped."""
    from tidemark.plans import QUERIES

    QUERIES["a05_summary"](spark, "/root/testdata/sf0.001").explain("formatted")
    assert "position_based" not in capsys.readouterr().out


def steps(df, capsys):
    """The sorts, aggregates, exchanges and scans of a plan, last step first."""
    capsys.readouterr()
    df.explain()
    return re.findall(r"^[ :+\-*()\d]*(Sort|SortAggregate|HashAggregate|Exchange|FileScan)\b", capsys.readouterr().out, re.M)


def test_sessions_are_dealt_out_before_they_are_put_in_order(spark, capsys):
    """The task that read a row group put all its touches in order."""
    from tidemark.plans.journey import sessions_of

    sf = "/root/testdata/sf0.001"
    got = V.sessions(spark, sf)
    assert steps(got, capsys)[-2:] == ["Exchange", "FileScan"] and steps(sessions_of(V.touches(spark, sf)), capsys)[-2:] == ["Sort", "FileScan"]
    plain = sessions_of(V.touches(spark, sf))
    assert sorted(map(str, got.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("name", ["a09_timeseries_by_day", "f26_model_deltas", "j06_as_of_cart_token", "c10_candidates"])
def test_touches_met_by_token_are_dealt_out(spark, capsys, monkeypatch, name):
    """Touches of one row group were written as one, and one task made and dealt out the copies of all of them."""
    from tidemark.plans import QUERIES

    staged, stage = [], A.stage
    monkeypatch.setattr(A, "stage", lambda df, label: staged.append(df) or stage(df, label))
    out = QUERIES[name](spark, "/root/testdata/sf0.001")
    if staged:
        assert steps(staged[0], capsys) == ["Exchange", "FileScan"]
    else:
        out.explain()
        assert "hashpartitioning(user_id" in capsys.readouterr().out


@pytest.mark.parametrize("name", ["a09_timeseries_by_source", "a07_spend_details", "a08_channel_groups", "a37_revenue_share", "a38_source_mix", "t02_lowest_buckets", "t04_sorted_page", "t12_top_slices", "a06_campaigns", "f25_kpis_by_source", "a02_new_and_returning", "j01_credits_orders_ranks", "j03_primary_credit", "c03_linear"])
def test_orders_of_credits_are_dealt_out_and_written_once(spark, capsys, monkeypatch, name):
    """Each use of the orders read events again, a row group as one task, which dealt out what it held."""
    from tidemark.plans import QUERIES
    from tidemark.plans import attribution as P

    sf, staged, stage = "/root/testdata/sf0.001", {}, P.stage
    monkeypatch.setattr(P, "stage", lambda df, label: staged.setdefault(label, df) and stage(df, label))
    assert not any(f.endswith("events.parquet") for f in QUERIES[name](spark, sf).inputFiles())
    assert steps(staged["orders"], capsys) == ["Exchange", "FileScan"]
    assert sorted(map(str, staged["orders"].collect())) == sorted(map(str, V.orders(spark, sf).collect()))
