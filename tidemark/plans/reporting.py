"""Queries on the cube and the read API."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.time import in_local_days
from tidemark.operators import reporting as R
from tidemark.plans.attribution import credited, dealt_orders
from tidemark.plans.base_sql import over, over_credits, over_cube
from tidemark.plans.registry import query
from tidemark.sources import views as V
from tidemark.storage import stage

M = ", ".join(R.MEASURES)
SUMS = ", ".join(f"CAST(coalesce(sum({m}), 0) AS BIGINT) AS {m}" for m in R.MEASURES)
RATES = """coalesce(CASE WHEN visits <> 0 THEN (orders_e8 / 1e8::DOUBLE) / CAST(visits AS DOUBLE) END, 0.0::DOUBLE) AS conversion_rate,
  CASE WHEN spend_cents <> 0 THEN (revenue_cents / 100.0::DOUBLE) / (spend_cents / 100.0::DOUBLE) END AS roas,
  CASE WHEN orders_e8 <> 0 THEN (spend_cents / 100.0::DOUBLE) / (orders_e8 / 1e8::DOUBLE) END AS blended_cac,
  CASE WHEN impressions <> 0 THEN CAST(clicks AS DOUBLE) / CAST(impressions AS DOUBLE) END AS click_through_rate,
  coalesce(CASE WHEN orders_e8 <> 0 THEN CAST(new_orders_e8 AS DOUBLE) / CAST(orders_e8 AS DOUBLE) END, 0.0::DOUBLE) AS new_customer_rate"""


def cube(spark, sf_dir, models=R.MODELS):
    orders, sessions = dealt_orders(spark, sf_dir), stage(V.sessions(spark, sf_dir), "sessions")
    return R.cube(sessions, credited(spark, sf_dir, models, sessions=sessions, orders=orders), orders, V.spend(spark, sf_dir), models)


def _text_date(df):
    return df.withColumn("metric_date", F.col("metric_date").cast("string"))


@query("entry_roas_by_day_and_model", over_cube(f"SELECT metric_date, model, {M}, {RATES} FROM (SELECT CAST(metric_date AS VARCHAR) AS metric_date, model, {SUMS} FROM cube GROUP BY ALL)"))
def entry(spark, sf_dir):
    return _text_date(R.kpis(R.totals(cube(spark, sf_dir), "metric_date", "model"))).select("metric_date", "model", *R.MEASURES, "conversion_rate", "roas", "blended_cac", "click_through_rate", "new_customer_rate")


@query("c13_cube", over_cube(f"SELECT CAST(metric_date AS VARCHAR) AS metric_date, model, source, medium, campaign, content, term, {M} FROM cube"))
def c13(spark, sf_dir):
    return _text_date(cube(spark, sf_dir))


@query("a01_visits", over_cube("SELECT CAST(metric_date AS VARCHAR) AS metric_date, model, source, campaign, CAST(sum(visits) AS BIGINT) AS visits FROM parts WHERE visits > 0 GROUP BY ALL"))
def a01(spark, sf_dir):
    return _text_date(R.visit_part(V.sessions(spark, sf_dir))).groupBy("metric_date", "model", "source", "campaign").agg(F.sum("visits").alias("visits"))


@query("a02_new_and_returning", over_cube("SELECT model, CAST(sum(new_revenue_cents) AS BIGINT) AS new_cents, CAST(sum(returning_revenue_cents) AS BIGINT) AS returning_cents, CAST(sum(orders_e8) AS BIGINT) AS orders_e8 FROM cube GROUP BY 1"))
def a02(spark, sf_dir):
    orders = dealt_orders(spark, sf_dir)
    part = R.order_part(credited(spark, sf_dir, orders=orders), orders)
    return part.groupBy("model").agg(F.sum("new_revenue_cents").alias("new_cents"), F.sum("returning_revenue_cents").alias("returning_cents"), F.sum("orders_e8").alias("orders_e8"))


@query("a03_spend", over_cube("SELECT CAST(report_date AS VARCHAR) AS metric_date, source, medium, campaign, CAST(sum(cents) AS BIGINT) AS spend_cents, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks FROM counted GROUP BY ALL"))
def a03(spark, sf_dir):
    return _text_date(R.spend_part(V.spend(spark, sf_dir), ["linear"])).select("metric_date", "source", "medium", "campaign", "spend_cents", "impressions", "clicks")


@query("j10_campaigns_without_creatives", over_cube("SELECT CAST(report_date AS VARCHAR) AS report_date, connection_id, campaign_id, CAST(sum(cents) AS BIGINT) AS cents FROM lone GROUP BY ALL"))
def j10(spark, sf_dir):
    rows = R.counted_spend(V.spend(spark, sf_dir)).where("granularity = 'campaign'")
    return rows.groupBy(F.col("report_date").cast("string").alias("report_date"), "connection_id", "campaign_id").agg(F.sum("cents").alias("cents"))


@query("w01_customer_rank", over_cube("SELECT order_id, CAST(customer_rank AS INTEGER) AS customer_rank FROM ranks"))
def w01(spark, sf_dir):
    return R.customer_rank(V.orders(spark, sf_dir))


@query("w01_customer_rank_history", over("SELECT order_id, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY ts, order_id) AS INTEGER) AS customer_rank FROM hist"))
def w01_history(spark, sf_dir):
    rows = V.order_history(spark, sf_dir).withColumn("source_name", F.lit("web")).withColumnRenamed("customer_id", "user_id")
    return R.customer_rank(rows)


@query("j01_credits_orders_ranks", over_cube("SELECT c.order_id, c.model, CAST(c.position AS INTEGER) AS position, c.credit_cents, CAST(r.customer_rank AS INTEGER) AS customer_rank FROM cred c JOIN ranks r USING (order_id)"))
def j01(spark, sf_dir):
    orders = dealt_orders(spark, sf_dir)
    return credited(spark, sf_dir, orders=orders).join(R.customer_rank(orders).hint("shuffle_hash"), "order_id").select("order_id", "model", "position", "credit_cents", "customer_rank")


@query("j03_primary_credit", over_credits("SELECT o.order_id, o.cents, c.source, c.medium, c.campaign, c.credit_cents FROM ord o LEFT JOIN cred c ON c.order_id = o.order_id AND c.model = 'linear' AND c.is_primary"))
def j03(spark, sf_dir):
    orders = dealt_orders(spark, sf_dir)
    return R.primary_credit(orders, credited(spark, sf_dir, ["linear"], orders=orders), "linear").select("order_id", "cents", "source", "medium", "campaign", "credit_cents")


@query("p03_local_dates", over("SELECT CAST(order_date AS VARCHAR) AS order_date, count(*) AS orders, CAST(sum(cents) AS BIGINT) AS cents FROM ord GROUP BY 1"))
def p03(spark, sf_dir):
    return V.orders(spark, sf_dir).groupBy(F.col("order_date").cast("string").alias("order_date")).agg(F.count("*").alias("orders"), F.sum("cents").alias("cents"))


@query("p04_local_day_range", over("SELECT order_id, cents FROM ord WHERE order_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' AND source_name = 'web'"))
def p04(spark, sf_dir):
    rows = V.orders(spark, sf_dir)
    return rows.where(in_local_days(F.col("ts"), "2024-01-05", "2024-01-12") & (F.coalesce("source_name", F.lit("")) == "web")).select("order_id", "cents")


@query("p07_optional_filters", over_cube(f"SELECT {SUMS} FROM cube WHERE model = 'linear' AND source = 'google' AND metric_date >= DATE '2024-01-03'"))
def p07(spark, sf_dir):
    return R.totals(R.filtered(cube(spark, sf_dir, ["linear"]), model="linear", source="google", first="2024-01-03"))


@query("a05_summary", over_cube(f"SELECT {SUMS} FROM cube WHERE model = 'last_touch'"))
def a05(spark, sf_dir):
    return R.totals(R.filtered(cube(spark, sf_dir, ["last_touch"]), model="last_touch"))


@query("a06_campaigns", over_cube(f"SELECT source, medium, campaign, content, {SUMS} FROM cube WHERE model = 'linear' GROUP BY ALL ORDER BY sum(revenue_cents) DESC, sum(orders_e8) DESC, sum(visits) DESC, source, campaign, medium, content LIMIT 50"))
def a06(spark, sf_dir):
    return R.campaign_table(R.filtered(cube(spark, sf_dir, ["linear"]), model="linear"), 50)


@query("a07_spend_details", over_cube("SELECT source, medium, campaign, CAST(sum(spend_cents) AS BIGINT) AS spend_cents, CAST(sum(clicks) AS BIGINT) AS clicks FROM cube WHERE model = 'linear' GROUP BY ALL HAVING sum(spend_cents) > 0"))
def a07(spark, sf_dir):
    return R.totals(R.filtered(cube(spark, sf_dir, ["linear"]), model="linear"), "source", "medium", "campaign").where("spend_cents > 0").select("source", "medium", "campaign", "spend_cents", "clicks")


@query("a08_channel_groups", over_cube("SELECT source, medium, CAST(sum(s) AS BIGINT) AS spend_cents, count(*) AS campaigns, string_agg(campaign, ',' ORDER BY s DESC, campaign) AS campaign_names, CAST(sum(sum(s)) OVER () AS BIGINT) AS grand_cents, row_number() OVER (ORDER BY sum(s) DESC, source, medium) = 1 AS is_top FROM (SELECT source, medium, campaign, sum(spend_cents) AS s FROM cube WHERE model = 'linear' GROUP BY ALL HAVING sum(spend_cents) > 0) GROUP BY 1, 2"))
def a08(spark, sf_dir):
    return R.channel_groups(R.filtered(cube(spark, sf_dir, ["linear"]), model="linear")).withColumn("campaign_names", F.array_join("campaign_names", ","))


for _bucket, _sql in (("day", "CAST(metric_date AS VARCHAR)"), ("source", "source"), ("campaign", "campaign")):

    @query(f"a09_timeseries_by_{_bucket}", over_cube(f"SELECT {_sql} AS bucket, {SUMS} FROM cube WHERE model = 'time_decay' GROUP BY 1"))
    def a09(spark, sf_dir, bucket=_bucket):
        return R.timeseries(R.filtered(cube(spark, sf_dir, ["time_decay"]), model="time_decay"), bucket)


@query("f25_kpis_by_source", over_cube(f"SELECT source, {M}, {RATES} FROM (SELECT source, {SUMS} FROM cube WHERE model = 'linear' GROUP BY 1)"))
def f25(spark, sf_dir):
    return R.kpis(R.totals(R.filtered(cube(spark, sf_dir, ["linear"]), model="linear"), "source")).select("source", *R.MEASURES, "conversion_rate", "roas", "blended_cac", "click_through_rate", "new_customer_rate")


DELTA_METRICS = {
    "visits": "CAST(visits AS DOUBLE)", "orders_e8": "CAST(orders_e8 AS DOUBLE)", "revenue_cents": "CAST(revenue_cents AS DOUBLE)", "spend_cents": "CAST(spend_cents AS DOUBLE)", "impressions": "CAST(impressions AS DOUBLE)", "clicks": "CAST(clicks AS DOUBLE)",
    "conversion_rate": "conversion_rate", "roas": "roas", "new_customer_rate": "new_customer_rate",
}
DELTAS = " UNION ALL ".join(f"SELECT model, '{m}' AS metric, {c} AS v FROM rated" for m, c in DELTA_METRICS.items())


@query("f26_model_deltas", over_cube("").rstrip() + f""", rated AS (SELECT model, {M}, {RATES} FROM (SELECT model, {SUMS} FROM cube WHERE source = 'google' GROUP BY 1))
  SELECT metric, baseline, comparison, comparison - baseline AS absolute_delta, CASE WHEN baseline <> 0 THEN (comparison - baseline) / baseline END AS relative_delta FROM (SELECT metric, max(CASE WHEN model = 'first_touch' THEN v END) AS baseline, max(CASE WHEN model = 'linear' THEN v END) AS comparison FROM ({DELTAS}) GROUP BY 1)""")
def f26(spark, sf_dir):
    return R.compare_models(R.filtered(cube(spark, sf_dir, ["first_touch", "linear"]), source="google"), "first_touch", "linear", list(DELTA_METRICS))


@query("a37_revenue_share", over_cube("SELECT campaign, CAST(r AS BIGINT) AS revenue_cents, CASE WHEN t > 0 THEN floor(CAST(r AS DOUBLE) * 10000 / t + 0.5) / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS share FROM (SELECT campaign, sum(revenue_cents) AS r, CAST(sum(sum(revenue_cents)) OVER () AS DOUBLE) AS t FROM cube WHERE model = 'linear' GROUP BY 1)"))
def a37(spark, sf_dir):
    return R.revenue_share(R.filtered(cube(spark, sf_dir, ["linear"]), model="linear"))


@query("a38_source_mix", over_cube("SELECT coalesce(nullif(source, ''), 'Unknown') AS source, CAST(sum(revenue_cents) AS BIGINT) AS revenue_cents, CAST(sum(orders_e8) AS BIGINT) AS orders_e8 FROM cube WHERE model = 'linear' GROUP BY 1"))
def a38(spark, sf_dir):
    rows = R.filtered(cube(spark, sf_dir, ["linear"]), model="linear").withColumn("source", F.coalesce(F.nullif("source", F.lit("")), F.lit("Unknown")))
    return R.totals(rows, "source").select("source", "revenue_cents", "orders_e8").orderBy(F.desc("revenue_cents"), "source")


@query("t02_lowest_buckets", over_cube("SELECT bucket, revenue_cents FROM (SELECT campaign AS bucket, CAST(sum(revenue_cents) AS BIGINT) AS revenue_cents, sum(orders_e8) AS o, sum(visits) AS v FROM cube WHERE model = 'linear' GROUP BY 1) ORDER BY revenue_cents, o, v, bucket LIMIT 3"))
def t02(spark, sf_dir):
    rows = R.timeseries(R.filtered(cube(spark, sf_dir, ["linear"]), model="linear"), "campaign")
    return rows.orderBy("revenue_cents", "orders_e8", "visits", "bucket").limit(3).select("bucket", "revenue_cents")


@query("t03_recent_orders", over("SELECT order_id, user_id, cents FROM ord WHERE source_name = 'web' ORDER BY ts DESC, order_id DESC LIMIT 50"))
def t03(spark, sf_dir):
    return V.orders(spark, sf_dir).where("source_name = 'web'").orderBy(F.desc("ts"), F.desc("order_id")).limit(50).select("order_id", "user_id", "cents")


@query("t04_sorted_page", over_cube("SELECT source, campaign, s AS spend_cents, true AS has_more FROM (SELECT source, campaign, CAST(sum(spend_cents) AS BIGINT) AS s FROM cube WHERE model = 'linear' GROUP BY 1, 2) ORDER BY s DESC NULLS LAST, campaign, source LIMIT 20 OFFSET 10"))
def t04(spark, sf_dir):
    rows = R.totals(R.filtered(cube(spark, sf_dir, ["linear"]), model="linear"), "source", "campaign").select("source", "campaign", "spend_cents")
    return R.page(rows, [F.col("spend_cents").desc_nulls_last(), F.col("campaign"), F.col("source")], 20, 10)


@query("u03_candidate_dates", over("SELECT DISTINCT CAST(d AS VARCHAR) AS day FROM (SELECT order_date AS d FROM ord UNION ALL SELECT report_date FROM spend UNION ALL SELECT CAST((first_seen AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS DATE) FROM sess)"))
def u03(spark, sf_dir):
    days = V.orders(spark, sf_dir).select(F.col("order_date").alias("day")).union(V.spend(spark, sf_dir).select("report_date"))
    days = days.union(R.visit_part(V.sessions(spark, sf_dir), ["linear"]).select("metric_date"))
    return days.distinct().select(F.col("day").cast("string").alias("day"))
