"""Queries on ad spend and reported order values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import cents
from tidemark.functions.time import days
from tidemark.operators import backfill as B
from tidemark.operators import spend as S
from tidemark.plans.base_sql import over
from tidemark.plans.registry import query
from tidemark.sources import views as V

AD = """
ad AS (SELECT l_orderkey * 10 + l_linenumber AS ordinal, CAST(DATE '2024-01-01' + CAST(dayofyear(l_shipdate) % 30 AS INTEGER) AS DATE) AS report_date, 'a' || CAST(l_suppkey % 5 AS VARCHAR) AS account_id,
  'c' || CAST(l_partkey % 40 AS VARCHAR) AS campaign_id, CASE WHEN l_partkey % 7 <> 0 THEN 's' || CAST(l_partkey % 80 AS VARCHAR) END AS adset_id, 'd' || CAST(l_partkey % 400 AS VARCHAR) AS ad_id,
  CASE WHEN l_partkey % 3 = 0 THEN 'r' || CAST(l_partkey % 90 AS VARCHAR) END AS creative_id, 'Campaign  ' || CAST(l_partkey % 40 AS VARCHAR) || CASE WHEN l_partkey % 40 > 30 AND l_linenumber = 1 THEN ' b' ELSE '' END AS campaign_name,
  CAST(floor(l_extendedprice * l_discount * 100 + 0.5) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS clicks, CAST(l_quantity AS BIGINT) * 20 AS impressions, l_linenumber, l_quantity FROM lineitem),
grains AS (SELECT ad.*, g.granularity, CASE g.granularity WHEN 'account' THEN account_id WHEN 'campaign' THEN campaign_id WHEN 'adset' THEN adset_id WHEN 'ad' THEN ad_id ELSE creative_id END AS entity_key
  FROM ad CROSS JOIN (SELECT unnest(['account', 'campaign', 'adset', 'ad', 'creative']) AS granularity) g),
norm AS (SELECT * FROM grains WHERE coalesce(entity_key, '') <> '')
"""
ENTRIES = """
ent AS (SELECT report_date, campaign_id, ordinal AS pos, CASE l_linenumber % 3 WHEN 0 THEN 'action_values' WHEN 1 THEN 'actions' ELSE 'purchase_roas' END AS kind,
  CASE ordinal % 23 WHEN 0 THEN 'purchase' WHEN 1 THEN 'omni_purchase' WHEN 2 THEN 'Web_Purchase' WHEN 3 THEN 'app_purchase' ELSE 'link_click' END AS action_type,
  CASE WHEN ordinal % 17 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS value FROM ad),
byt AS (SELECT report_date, campaign_id, action_type, min(pos) AS first, sum(CASE WHEN kind = 'action_values' THEN CAST(floor(TRY_CAST(value AS DOUBLE) * 100 + 0.5) AS BIGINT) END) AS value_cents,
  sum(CASE WHEN kind = 'actions' THEN CAST(TRY_CAST(value AS DOUBLE) AS BIGINT) END) AS purchases, arg_min(TRY_CAST(value AS DOUBLE), (pos, TRY_CAST(value AS DOUBLE))) FILTER (kind = 'purchase_roas' AND TRY_CAST(value AS DOUBLE) IS NOT NULL) AS roas
  FROM ent WHERE lower(action_type) LIKE '%purchase%' GROUP BY ALL),
bestt AS (SELECT *, row_number() OVER (PARTITION BY report_date, campaign_id ORDER BY rank, first) AS rn FROM (SELECT *, CASE action_type WHEN 'purchase' THEN 1 WHEN 'omni_purchase' THEN 2 WHEN 'offsite_conversion.fb_pixel_purchase' THEN 3 ELSE 4 END AS rank FROM byt)),
vals AS (SELECT k.report_date, k.campaign_id, b.action_type AS action_type_used, CASE WHEN b.rank IS NULL THEN 'none' WHEN b.rank <= 3 THEN 'priority' ELSE 'fallback' END AS selection,
  CAST(b.value_cents AS BIGINT) AS value_cents, CAST(b.purchases AS BIGINT) AS purchases, b.roas FROM (SELECT DISTINCT report_date, campaign_id FROM ent) k LEFT JOIN (SELECT * FROM bestt WHERE rn = 1) b USING (report_date, campaign_id))
"""
META = """
found AS (SELECT 'campaign' AS kind, campaign_id AS entity, arg_max(trim(campaign_name), ordinal) AS latest_name, max(report_date) AS last_seen FROM (SELECT * FROM ad) GROUP BY 2),
byname AS (SELECT campaign_id, arg_max(trim(campaign_name), (report_date, ordinal)) AS latest_name, max(report_date) AS last_seen FROM ad GROUP BY 1)
"""


def ads(spark, sf_dir):
    r = V.table(spark, sf_dir, "lineitem")
    part = lambda letter, n: F.concat(F.lit(letter), (F.col("l_partkey") % n).cast("string"))
    second = F.when((F.col("l_partkey") % 40 > 30) & (F.col("l_linenumber") == 1), " b").otherwise("")
    return r.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.date_add(F.lit("2024-01-01").cast("date"), F.dayofyear("l_shipdate") % 30).alias("report_date"),
        F.concat(F.lit("a"), (F.col("l_suppkey") % 5).cast("string")).alias("account_id"), part("c", 40).alias("campaign_id"), F.when(F.col("l_partkey") % 7 != 0, part("s", 80)).alias("adset_id"), part("d", 400).alias("ad_id"),
        F.when(F.col("l_partkey") % 3 == 0, part("r", 90)).alias("creative_id"), F.concat(F.lit("Campaign  "), (F.col("l_partkey") % 40).cast("string"), second).alias("campaign_name"),
        cents(F.col("l_extendedprice") * F.col("l_discount")).alias("cents"), F.col("l_quantity").cast("long").alias("clicks"), (F.col("l_quantity").cast("long") * 20).alias("impressions"), "l_linenumber", "l_quantity",
    )


def entries(spark, sf_dir):
    o, n = F.col("ordinal"), F.col("l_linenumber")
    kind = F.when(n % 3 == 0, "action_values").when(n % 3 == 1, "actions").otherwise("purchase_roas")
    r = o % 23
    action = F.when(r == 0, "purchase").when(r == 1, "omni_purchase").when(r == 2, "Web_Purchase").when(r == 3, "app_purchase").otherwise("link_click")
    value = F.when(o % 17 == 0, "n/a").otherwise(F.col("l_quantity").cast("long").cast("string"))
    return ads(spark, sf_dir).select("report_date", "campaign_id", o.alias("at"), kind.alias("kind"), action.alias("action_type"), value.alias("value"))


def values(spark, sf_dir):
    return S.order_values(entries(spark, sf_dir), ["report_date", "campaign_id"])


def _day(df, name="report_date"):
    return df.withColumn(name, F.col(name).cast("string"))


@query("c17_order_values", over("SELECT CAST(report_date AS VARCHAR) AS report_date, campaign_id, action_type_used, selection, value_cents, purchases, roas FROM vals", AD, ENTRIES))
def c17(spark, sf_dir):
    return _day(values(spark, sf_dir))


@query("a21_order_value_totals", over("SELECT CAST(coalesce(sum(value_cents), 0) AS BIGINT) AS value_cents, CAST(coalesce(sum(purchases), 0) AS BIGINT) AS purchases, count(*) AS rows FROM vals", AD, ENTRIES))
def a21(spark, sf_dir):
    return values(spark, sf_dir).agg(F.coalesce(F.sum("value_cents"), F.lit(0).cast("long")).alias("value_cents"), F.coalesce(F.sum("purchases"), F.lit(0).cast("long")).alias("purchases"), F.count("*").alias("rows"))


@query("a31_order_value_modes", over("SELECT selection, count(*) AS rows, count(*) FILTER (value_cents IS NULL) AS null_values, count(*) FILTER (purchases IS NULL) AS null_purchases, count(*) FILTER (roas IS NULL) AS null_roas FROM vals GROUP BY 1", AD, ENTRIES))
def a31(spark, sf_dir):
    null = lambda c: F.count_if(F.col(c).isNull())
    return values(spark, sf_dir).groupBy("selection").agg(F.count("*").alias("rows"), null("value_cents").alias("null_values"), null("purchases").alias("null_purchases"), null("roas").alias("null_roas"))


PLANTED = ", gappy AS (SELECT report_date, CASE WHEN day(report_date) % 9 = 0 AND campaign_id NOT LIKE '%1' THEN NULL ELSE coalesce(value_cents, 1) END AS value_cents FROM vals)"


@query("c18_null_rate_anomalies", over("""SELECT CAST(report_date AS VARCHAR) AS report_date, rows, nulls FROM (SELECT report_date, count(*) AS rows, count(*) FILTER (value_cents IS NULL) AS nulls, sum(count(*)) OVER () AS ar, sum(count(*) FILTER (value_cents IS NULL)) OVER () AS an FROM gappy GROUP BY 1)
  WHERE rows >= 5 AND nulls / CAST(rows AS DOUBLE) >= 0.5 AND nulls / CAST(rows AS DOUBLE) - CASE WHEN ar > rows THEN CAST(an - nulls AS DOUBLE) / CAST(ar - rows AS DOUBLE) ELSE 0.0 END >= 0.3""", AD, ENTRIES.rstrip() + PLANTED))
def c18(spark, sf_dir):
    gap = (F.dayofmonth("report_date") % 9 == 0) & ~F.col("campaign_id").endswith("1")
    rows = values(spark, sf_dir).withColumn("value_cents", F.when(~gap, F.coalesce("value_cents", F.lit(1).cast("long"))))
    return _day(S.null_rate_anomalies(rows, "report_date", "value_cents"))


SYNCED = ", syncs AS (SELECT * FROM (SELECT DISTINCT account_id FROM ad) CROSS JOIN (SELECT unnest(['account', 'campaign', 'adset', 'ad']) AS level) CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS report_date))"


@query("c18_zero_row_anomalies", over("""SELECT account_id, level, CAST(report_date AS VARCHAR) AS report_date, count(v.level) AS fetched, count(*) FILTER (v.ok) AS normalised
  FROM syncs LEFT JOIN (SELECT account_id, ['account', 'campaign', 'adset', 'ad'][CAST(substr(campaign_id, 2) AS INTEGER) % 4 + 1] AS level, report_date, day(report_date) % 11 <> 5 AS ok FROM ad WHERE (day(report_date) + CAST(substr(account_id, 2) AS INTEGER)) % 7 > 0) v USING (account_id, level, report_date) GROUP BY 1, 2, 3 HAVING count(v.level) = 0 OR count(*) FILTER (v.ok) = 0""", AD, SYNCED.lstrip(", ")))
def c18_zero(spark, sf_dir):
    """Of every account, level and day of a month that were synced, those that brought no row, or none that could be used."""
    level = F.element_at(F.array(*[F.lit(x) for x in ("account", "campaign", "adset", "ad")]), (F.substring("campaign_id", 2, 9).cast("int") % 4 + 1))
    rows = ads(spark, sf_dir).where((F.dayofmonth("report_date") + F.substring("account_id", 2, 9).cast("int")) % 7 > 0).select("account_id", level.alias("level"), "report_date", (F.dayofmonth("report_date") % 11 != 5).alias("is_normalised"))
    month = F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))
    ran = ads(spark, sf_dir).select("account_id").distinct().withColumn("level", F.explode(F.array(*[F.lit(x) for x in ("account", "campaign", "adset", "ad")]))).withColumn("report_date", F.explode(month))
    return _day(S.zero_row_anomalies(rows, ran, ["account_id", "level", "report_date"]))


STATUSES = """newest AS (SELECT *, 'k' || CAST(CAST(substr(campaign_id, 2) AS INTEGER) % 30 AS VARCHAR) AS campaign, row_number() OVER (PARTITION BY account_id, campaign_id ORDER BY report_date DESC, ordinal DESC, campaign_name) AS rn FROM ad),
stated AS (SELECT account_id, campaign_id, CASE WHEN campaign_id NOT LIKE '%7' AND campaign_id NOT LIKE '%3' THEN 'resolved' WHEN campaign_id NOT LIKE '%3' THEN 'fallback_name' ELSE 'unresolved' END AS status FROM newest WHERE rn = 1)"""


def _statuses(spark, sf_dir):
    blank = F.when(F.col("campaign_id").endswith("3"), "  ").otherwise(F.col("campaign_name"))
    rows = ads(spark, sf_dir).withColumns({"platform": F.lit("meta"), "campaign_name": blank})
    newest = S.newest_per_scope(rows, ["account_id", "campaign_id"], [F.desc("report_date"), F.desc("ordinal"), F.asc("campaign_name")])
    known = _metadata(spark, sf_dir).where(~F.col("campaign_id").rlike("[37]$")).withColumn("platform", F.lit("meta"))
    return S.campaign_names(newest, known, ["account_id", "campaign_id"])


@query("f54_resolution_statuses", over("SELECT account_id, campaign_id, status FROM stated", AD, STATUSES))
def f54(spark, sf_dir):
    return _statuses(spark, sf_dir).select("account_id", "campaign_id", "status")


@query("a35_resolution_coverage", over("SELECT account_id, count(*) AS requested, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'fallback_name') AS fallback, count(*) FILTER (status = 'unresolved') AS unresolved, count(*) FILTER (status = 'resolved') / CAST(count(*) AS DOUBLE) AS resolved_rate, count(*) FILTER (status = 'fallback_name') / CAST(count(*) AS DOUBLE) AS fallback_rate, count(*) FILTER (status = 'unresolved') / CAST(count(*) AS DOUBLE) AS unresolved_rate FROM stated GROUP BY 1", AD, STATUSES))
def a35(spark, sf_dir):
    return B.coverage(_statuses(spark, sf_dir), "account_id")


@query("c19_spend_granularities", over("SELECT CAST(report_date AS VARCHAR) AS report_date, granularity, entity_key, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, arg_min(campaign_name, ordinal) AS campaign_name, arg_min(account_id, ordinal) AS account_id FROM norm GROUP BY ALL", AD))
def c19(spark, sf_dir):
    return _day(S.granular(ads(spark, sf_dir), ["campaign_name", "account_id"], "ordinal"))


@query("a26_account_totals", over("SELECT CAST(report_date AS VARCHAR) AS report_date, account_id, CAST(coalesce(sum(cents) FILTER (granularity = 'campaign'), sum(cents) FILTER (granularity = 'ad'), 0) AS BIGINT) AS cents FROM norm GROUP BY ALL", AD))
def a26(spark, sf_dir):
    return _day(S.account_totals(S.normalise(ads(spark, sf_dir))))


def _metadata(spark, sf_dir):
    rows = ads(spark, sf_dir).select("campaign_id", F.col("campaign_name").alias("name"), F.col("report_date").alias("seen"), "ordinal")
    return S.collapse_metadata(rows, ["campaign_id"])


@query("a27_metadata", over("SELECT campaign_id, latest_name, CAST(last_seen AS VARCHAR) AS last_seen FROM byname", AD, META))
def a27(spark, sf_dir):
    return _day(_metadata(spark, sf_dir), "last_seen")


OLD = ", old AS (SELECT campaign_id, CASE WHEN campaign_id LIKE '%5' THEN 'renamed' ELSE latest_name END AS latest_name, last_seen FROM byname WHERE campaign_id NOT LIKE '%7')"


@query("c33_metadata_plan", over("SELECT f.campaign_id, CASE WHEN o.campaign_id IS NULL THEN 'insert' WHEN f.latest_name IS NOT DISTINCT FROM o.latest_name AND f.last_seen IS NOT DISTINCT FROM o.last_seen THEN 'keep' ELSE 'update' END AS action FROM byname f LEFT JOIN old o USING (campaign_id)", AD, META.rstrip() + OLD))
def c33(spark, sf_dir):
    found = _metadata(spark, sf_dir)
    old = found.where(~F.col("campaign_id").endswith("7")).withColumn("latest_name", F.when(F.col("campaign_id").endswith("5"), "renamed").otherwise(F.col("latest_name")))
    return S.metadata_plan(found, old, ["campaign_id"]).select("campaign_id", "action")


@query("a28_freshness", over("SELECT CASE WHEN campaign_id < 'c2' THEN 'google' ELSE 'meta' END AS platform, count(*) AS entities, count(*) FILTER (last_seen < DATE '2024-02-01' - INTERVAL 48 HOUR) AS stale, count(*) FILTER (last_seen >= DATE '2024-02-01' - INTERVAL 48 HOUR) AS fresh, CAST(min(last_seen) AS VARCHAR) AS oldest, CAST(max(last_seen) AS VARCHAR) AS newest FROM byname GROUP BY 1", AD, META))
def a28(spark, sf_dir):
    rows = _metadata(spark, sf_dir).withColumn("platform", F.when(F.col("campaign_id") < "c2", "google").otherwise("meta"))
    out = S.freshness(rows, ["platform"], F.lit("2024-02-01").cast("timestamp_ntz"))
    return out.withColumns({c: F.col(c).cast("string") for c in ("oldest", "newest")})


@query("w06_newest_spend", over("SELECT account_id, campaign_id, ordinal, cents FROM (SELECT *, row_number() OVER (PARTITION BY account_id, campaign_id ORDER BY report_date DESC, ordinal DESC) AS rn FROM ad) WHERE rn = 1", AD))
def w06(spark, sf_dir):
    return S.newest_per_scope(ads(spark, sf_dir), ["account_id", "campaign_id"], [F.desc("report_date"), F.desc("ordinal")]).select("account_id", "campaign_id", "ordinal", "cents")


@query("c20_campaign_names", over("""SELECT campaign, any_value(name) AS name, any_value(campaign_id) AS entity_id, any_value(status) AS status FROM (
  SELECT n.campaign, n.campaign_id, coalesce(nullif(regexp_replace(trim(b.latest_name), '\\s+', ' ', 'g'), ''), nullif(regexp_replace(trim(n.campaign_name), '\\s+', ' ', 'g'), ''), n.campaign_id) AS name, CASE WHEN b.latest_name IS NOT NULL THEN 'resolved' ELSE 'fallback_name' END AS status
  FROM (SELECT *, 'k' || CAST(CAST(substr(campaign_id, 2) AS INTEGER) % 30 AS VARCHAR) AS campaign, row_number() OVER (PARTITION BY account_id, campaign_id ORDER BY report_date DESC, ordinal DESC) AS rn FROM ad) n
  LEFT JOIN (SELECT * FROM byname WHERE campaign_id NOT LIKE '%7') b USING (campaign_id) WHERE n.rn = 1) GROUP BY 1 HAVING count(DISTINCT (name, campaign_id, status)) = 1""", AD, META))
def c20(spark, sf_dir):
    rows = ads(spark, sf_dir).withColumn("platform", F.lit("meta")).withColumn("campaign", F.concat(F.lit("k"), (F.substring("campaign_id", 2, 9).cast("int") % 30).cast("string")))
    newest = S.newest_per_scope(rows, ["account_id", "campaign_id"], [F.desc("report_date"), F.desc("ordinal")])
    known = _metadata(spark, sf_dir).where(~F.col("campaign_id").endswith("7")).withColumn("platform", F.lit("meta"))
    return S.campaign_names(newest, known, ["campaign"])


CALENDAR = "cal AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-04', INTERVAL 1 DAY)) AS DATE) AS day), conn AS (SELECT DISTINCT account_id FROM ad), have AS (SELECT DISTINCT account_id, report_date AS day FROM ad WHERE NOT (account_id = 'a1' AND day(report_date) % 4 = 0)), gaps AS (SELECT account_id, day FROM conn CROSS JOIN cal EXCEPT SELECT account_id, day FROM have)"


def _gaps(spark, sf_dir):
    have = ads(spark, sf_dir).where("not (account_id = 'a1' and day(report_date) % 4 = 0)").select("account_id", F.col("report_date").alias("day"))
    return have, S.missing_dates(days(spark, "2024-01-01", "2024-02-04"), have, "account_id")


@query("j26_missing_dates", over("SELECT account_id, CAST(day AS VARCHAR) AS day FROM gaps", AD, CALENDAR))
def j26(spark, sf_dir):
    return _day(_gaps(spark, sf_dir)[1], "day")


@query("c29_spend_reconciliation", over("SELECT c.account_id, count(g.day) AS missing, CASE WHEN count(g.day) > 0 THEN 'missing' ELSE 'healthy' END AS status FROM conn c LEFT JOIN gaps g USING (account_id) GROUP BY 1", AD, CALENDAR))
def c29(spark, sf_dir):
    have, gaps = _gaps(spark, sf_dir)
    return S.reconciled(have, gaps, "account_id")
