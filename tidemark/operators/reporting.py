"""The daily reporting cube and what is read from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import or_unknown, safe_divide
from tidemark.functions.time import local_date
from tidemark.operators.attribution import MODELS

DIMENSIONS = ["source", "medium", "campaign", "content", "term"]
KEYS = ["metric_date", "model", *DIMENSIONS]
MEASURES = ["visits", "orders_e8", "revenue_cents", "spend_cents", "impressions", "clicks", "new_orders_e8", "returning_orders_e8", "new_revenue_cents", "returning_revenue_cents"]


def weight_e8(weight: Column) -> Column:
    """A weight as an integer of eight decimals, so that sums don't depend on their order."""
    return F.floor(weight * 100_000_000 + 0.5).cast("long")


def customer_rank(orders: DataFrame) -> DataFrame:
    """order_id, customer_rank over all web orders: by identity, or by the order itself for guests."""
    web = orders.where(F.coalesce("source_name", F.lit("")) == "web")
    who = F.coalesce(F.nullif(F.trim(F.col("user_id").cast("string")), F.lit("")), F.concat(F.lit("guest:"), F.col("order_id").cast("string")))
    return web.select("order_id", F.row_number().over(Window.partitionBy(who).orderBy("ts", "order_id")).alias("customer_rank"))


def _part(df: DataFrame, **measures: Column) -> DataFrame:
    zero = F.lit(0).cast("long")
    return df.groupBy(*KEYS).agg(*[measures.get(m, F.max(zero)).cast("long").alias(m) for m in MEASURES])


def visit_part(sessions: DataFrame, models: list[str] = MODELS) -> DataFrame:
    """Visits by local first date and dimensions, the same for each model."""
    rows = sessions.select(local_date(F.col("first_seen")).alias("metric_date"), F.explode(F.array(*[F.lit(m) for m in models])).alias("model"), *[or_unknown(F.col(d)).alias(d) for d in DIMENSIONS])
    return _part(rows, visits=F.count("*"))


def order_part(credited: DataFrame, orders: DataFrame) -> DataFrame:
    """Attributed orders and revenue of web orders, parted into new and returning customers."""
    rows = credited.where(F.coalesce("source_name", F.lit("")) == "web").join(customer_rank(orders).hint("shuffle_hash"), "order_id")
    rows = rows.select(F.col("order_date").alias("metric_date"), "model", *[or_unknown(F.col(d)).alias(d) for d in DIMENSIONS], weight_e8(F.col("weight")).alias("w"), "credit_cents", (F.col("customer_rank") == 1).alias("new"))
    only = lambda c, new: F.sum(F.when(F.col("new") == new, F.col(c)).otherwise(0))
    return _part(
        rows, orders_e8=F.sum("w"), revenue_cents=F.sum("credit_cents"), new_orders_e8=only("w", True), returning_orders_e8=only("w", False),
        new_revenue_cents=only("credit_cents", True), returning_revenue_cents=only("credit_cents", False),
    )


def counted_spend(spend: DataFrame) -> DataFrame:
    """Creative rows of all platforms, and google campaign rows of days and campaigns without any creative row."""
    creative = spend.where("granularity = 'creative'")
    google = spend.where("platform = 'google'")
    have = google.where("granularity = 'creative'").select("report_date", "connection_id", "campaign_id").distinct().alias("have")
    lone = google.where("granularity = 'campaign'").alias("c")
    same = (F.col("c.report_date") == F.col("have.report_date")) & (F.col("c.connection_id") == F.col("have.connection_id")) & F.col("c.campaign_id").eqNullSafe(F.col("have.campaign_id"))
    return creative.unionByName(lone.join(have, same, "left_anti"))


def spend_part(spend: DataFrame, models: list[str] = MODELS) -> DataFrame:
    rows = counted_spend(spend)
    for d in ("content", "term"):
        rows = rows if d in rows.columns else rows.withColumn(d, F.lit(None).cast("string"))
    summed = rows.groupBy(F.col("report_date").alias("metric_date"), *[or_unknown(F.col(d)).alias(d) for d in DIMENSIONS]).agg(*[F.sum(c).alias(c) for c in ("cents", "impressions", "clicks")])
    return _part(summed.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models]))), spend_cents=F.sum("cents"), impressions=F.sum("impressions"), clicks=F.sum("clicks"))


def cube(sessions: DataFrame, credited: DataFrame, orders: DataFrame, spend: DataFrame, models: list[str] = MODELS) -> DataFrame:
    """Each source is summed up before the union, which is then small."""
    parts = visit_part(sessions, models).unionByName(order_part(credited, orders)).unionByName(spend_part(spend, models))
    return parts.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])


def filtered(rows: DataFrame, model: str | None = None, source: str | None = None, campaign: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Optional filters; one that is None is no filter."""
    for name, value in (("model", model), ("source", source), ("campaign", campaign)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    if first is not None:
        rows = rows.where(F.col("metric_date") >= F.lit(first).cast("date"))
    return rows if last is None else rows.where(F.col("metric_date") <= F.lit(last).cast("date"))


def matches_or_null(c: Column, wanted: Column) -> Column:
    """Whether a column has the wanted value; a wanted value of null is no condition."""
    return wanted.isNull() | (c == wanted)


def conversion_mode(rows: DataFrame) -> DataFrame:
    """Order-value rows that are counted at conversion under the account's own attribution setting."""
    return rows.where((F.col("action_report_time") == "conversion") & F.col("use_account_attribution_setting"))


def by_status(status: Column, first: list[str]) -> Column:
    """The place of a status in a list, the others after it."""
    place = F.array_position(F.array(*[F.lit(s) for s in first]), status)
    return F.when(place > 0, place).otherwise(len(first) + 1).asc()


def top_slices(rows: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """slice, name, cents: the first few values of each dimension by revenue."""
    parts = [totals(rows, c).orderBy(F.desc("revenue_cents"), c).limit(n).select(F.lit(c).alias("slice"), F.col(c).alias("name"), F.col("revenue_cents").alias("cents")) for c, n in sizes.items()]
    return reduce(DataFrame.unionByName, parts)


def totals(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in MEASURES])


def kpis(rows: DataFrame) -> DataFrame:
    """Ratios of summed measures; null where the divisor is zero, rates 0."""
    orders, revenue, spend = F.col("orders_e8") / 1e8, F.col("revenue_cents") / 100.0, F.col("spend_cents") / 100.0
    zero = F.lit(0.0)
    return rows.withColumns({
        "conversion_rate": F.coalesce(safe_divide(orders, F.col("visits")), zero), "roas": safe_divide(revenue, spend),
        "cac": safe_divide(spend, F.col("new_orders_e8") / 1e8), "blended_cac": safe_divide(spend, orders),
        "average_order_value": safe_divide(revenue, orders), "click_through_rate": safe_divide(F.col("clicks"), F.col("impressions")),
        "new_customer_rate": F.coalesce(safe_divide(F.col("new_orders_e8"), F.col("orders_e8")), zero),
        "returning_customer_rate": F.coalesce(safe_divide(F.col("returning_orders_e8"), F.col("orders_e8")), zero),
    })


def campaign_table(rows: DataFrame, limit: int = 200) -> DataFrame:
    """Campaigns by revenue, orders and visits, the first ``limit``."""
    summed = totals(rows, "source", "medium", "campaign", "content")
    return summed.orderBy(F.desc("revenue_cents"), F.desc("orders_e8"), F.desc("visits"), "source", "campaign", "medium", "content").limit(min(limit, 200))


def channel_groups(rows: DataFrame) -> DataFrame:
    """Spend by source and medium with its campaigns as a nested list, the largest first; each row has the grand total and whether it is the top channel."""
    spent = totals(rows, "source", "medium", "campaign").where("spend_cents > 0")
    nested = spent.groupBy("source", "medium").agg(F.sum("spend_cents").alias("spend_cents"), F.count("*").alias("campaigns"), F.array_sort(F.collect_list(F.struct((-F.col("spend_cents")).alias("less"), "campaign"))).alias("list"))
    whole = spent.groupBy("source", "medium").agg(F.sum("spend_cents").alias("c")).agg(F.sum("c").alias("grand_cents"), F.min(F.struct((-F.col("c")).alias("less"), "source", "medium")).alias("top"))
    out = nested.join(F.broadcast(whole))  # one row
    top = (F.col("source") == F.col("top.source")) & (F.col("medium") == F.col("top.medium"))
    named = out.select("source", "medium", "spend_cents", "campaigns", F.transform("list", lambda x: x["campaign"]).alias("campaign_names"), "grand_cents", top.alias("is_top"))
    return named.orderBy(F.desc("spend_cents"), "source", "medium")


def timeseries(rows: DataFrame, bucket: str = "day") -> DataFrame:
    """Points by day, source or campaign."""
    key = {"day": F.col("metric_date").cast("string"), "source": F.col("source"), "campaign": F.col("campaign")}[bucket]
    return totals(rows.withColumn("bucket", key), "bucket")


def revenue_share(rows: DataFrame) -> DataFrame:
    """Campaigns' percent of all revenue to two decimals, 0 where there is none; totals meet by a one-row join."""
    summed = totals(rows, "campaign").select("campaign", "revenue_cents")
    whole = summed.agg(F.sum("revenue_cents").alias("all_cents"))
    share = F.when(F.col("all_cents") > 0, F.floor(F.col("revenue_cents") * 10_000 / F.col("all_cents") + 0.5) / 100.0).otherwise(0.0)
    return summed.join(F.broadcast(whole)).select("campaign", "revenue_cents", share.alias("share"))


def compare_models(rows: DataFrame, baseline: str, comparison: str, metrics: list[str]) -> DataFrame:
    """metric, baseline, comparison, absolute and relative delta."""
    summed = kpis(totals(rows, "model"))
    names = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
    long = summed.where(F.col("model").isin(baseline, comparison)).selectExpr("model", f"stack({len(metrics)}, {names}) as (metric, v)")
    out = long.groupBy("metric").agg(F.max(F.when(F.col("model") == baseline, F.col("v"))).alias("baseline"), F.max(F.when(F.col("model") == comparison, F.col("v"))).alias("comparison"))
    delta = F.col("comparison") - F.col("baseline")
    return out.select("metric", "baseline", "comparison", delta.alias("absolute_delta"), F.when(F.col("baseline") != 0, delta / F.col("baseline")).alias("relative_delta"))


def primary_credit(orders: DataFrame, credited: DataFrame, model: str) -> DataFrame:
    """Each order with its primary touch under a model, if it has one."""
    best = credited.where((F.col("model") == model) & F.col("is_primary")).select("order_id", "source", "medium", "campaign", "credit_cents")
    return orders.join(best, "order_id", "left")


def page(rows: DataFrame, keys: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of ordered rows; ``has_more`` tells whether a further row exists."""
    taken = rows.orderBy(*keys).offset(offset).limit(limit + 1)  # limit + 1 rows, so that one window over them is small
    placed = taken.withColumn("__at", F.row_number().over(Window.orderBy(*keys))).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit)
    return placed.where(F.col("__at") <= limit).drop("__at")
