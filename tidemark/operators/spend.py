"""Ad spend: granularities, order values that platforms report, entity names, and gaps between both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Action types that stand for an order, best first.
ORDER_ACTIONS = ["purchase", "omni_purchase", "offsite_conversion.fb_pixel_purchase"]
# Limits of the null-rate anomaly.
NULL_RATE, NULL_RATE_OVER_BASELINE, LEAST_ROWS = 0.5, 0.3, 5
GRANULARITIES = ["account", "campaign", "adset", "ad", "creative"]


def normalise(rows: DataFrame) -> DataFrame:
    """One ad row to a row for each granularity whose entity id it has; needs <granularity>_id columns and measures."""
    parts = F.array(*[F.struct(F.lit(g).alias("granularity"), F.col(f"{g}_id").alias("entity_key")) for g in GRANULARITIES])
    return rows.withColumn("__e", F.explode(F.filter(parts, lambda x: F.coalesce(x["entity_key"], F.lit("")) != ""))).select("*", "__e.granularity", "__e.entity_key").drop("__e")


def rollup(rows: DataFrame, first_seen: list[str], ordinal: Column) -> DataFrame:
    """Sums by day and entity, with the attributes of the entity's first row."""
    firsts = F.min_by(F.struct(*first_seen), ordinal)
    out = rows.groupBy("report_date", "granularity", "entity_key").agg(F.sum("cents").alias("cents"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), firsts.alias("__f"))
    return out.select("report_date", "granularity", "entity_key", "cents", "clicks", "impressions", "__f.*")


def granular(rows: DataFrame, first_seen: list[str], ordinal: str) -> DataFrame:
    """Sums by day, granularity and entity, with the attributes of the entity's row of the least ordinal (of equal ones, the smallest).

    Only numbers are summed up, on the map side already; the attributes are looked up for the few groups that are left.
    """
    ids = [f"{g}_id" for g in GRANULARITIES]
    narrow = normalise(rows.select("report_date", *ids, "cents", "clicks", "impressions", F.col(ordinal).alias("__ordinal"))).drop(*ids)
    keys = ["report_date", "granularity", "entity_key"]
    sums = narrow.groupBy(*keys).agg(F.sum("cents").alias("cents"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.min("__ordinal").alias("__ordinal"))
    named = rows.select("report_date", F.col(ordinal).alias("__ordinal"), F.create_map(*[x for g in GRANULARITIES for x in (F.lit(g), F.col(f"{g}_id"))]).alias("__ids"), F.struct(*first_seen).alias("__f"))
    met = sums.join(named, ["report_date", "__ordinal"]).where(F.col("entity_key") == F.element_at("__ids", F.col("granularity")))
    return met.groupBy(*keys, "cents", "clicks", "impressions").agg(F.min("__f").alias("__f")).select(*keys, "cents", "clicks", "impressions", "__f.*")


def account_totals(rows: DataFrame) -> DataFrame:
    """Per day and account the sum of its campaign rows, or of its ad rows where it has no campaign row."""
    by = rows.groupBy("report_date", "account_id").agg(F.sum(F.when(F.col("granularity") == "campaign", F.col("cents"))).alias("c"), F.sum(F.when(F.col("granularity") == "ad", F.col("cents"))).alias("a"))
    return by.select("report_date", "account_id", F.coalesce("c", "a", F.lit(0).cast("long")).alias("cents"))


def order_values(entries: DataFrame, keys: list[str]) -> DataFrame:
    """keys, action_type_used, selection, value_cents, purchases, roas.

    ``entries`` are (keys, at, kind, action_type, value): kind is action_values, actions or
    purchase_roas; at orders what was met first.  Of the types whose name holds "purchase" the best
    of ORDER_ACTIONS is used, else the one that was met first.  Values that are no numbers are skipped.
    """
    number = F.trim("value").try_cast("double")
    entries = entries.withColumn("__v", number)
    kind = lambda name: (F.col("kind") == name) & F.col("__v").isNotNull()
    by_type = entries.where(F.lower(F.trim("action_type")).contains("purchase")).groupBy(*keys, "action_type").agg(
        F.min("at").alias("first"), F.sum(F.when(kind("action_values"), F.floor(F.col("__v") * 100 + 0.5).cast("long"))).alias("value_cents"),
        F.sum(F.when(kind("actions"), F.col("__v").cast("long"))).alias("purchases"), F.min_by(F.when(kind("purchase_roas"), F.col("__v")), F.when(kind("purchase_roas"), F.struct("at", "__v"))).alias("roas"),
    )
    place = F.array_position(F.array(*[F.lit(a) for a in ORDER_ACTIONS]), F.col("action_type"))
    ranked = by_type.withColumn("rank", F.when(place > 0, place).otherwise(len(ORDER_ACTIONS) + 1))
    best = ranked.groupBy(*keys).agg(F.min(F.struct("rank", "first", "action_type", "value_cents", "purchases", "roas")).alias("b"))
    out = entries.select(*keys).distinct().join(best, keys, "left")
    selection = F.when(F.col("b").isNull(), "none").when(F.col("b.rank") <= len(ORDER_ACTIONS), "priority").otherwise("fallback")
    return out.select(*keys, F.col("b.action_type").alias("action_type_used"), selection.alias("selection"), "b.value_cents", "b.purchases", "b.roas")


def null_rate_anomalies(values: DataFrame, day: str, column: str) -> DataFrame:
    """Days of at least LEAST_ROWS rows whose share of nulls is high, and far above that of all other days together."""
    by = values.groupBy(day).agg(F.count("*").alias("rows"), F.count_if(F.col(column).isNull()).alias("nulls"))
    whole = by.agg(F.sum("rows").alias("all_rows"), F.sum("nulls").alias("all_nulls"))
    out = by.join(F.broadcast(whole))
    rate, rest = F.col("nulls") / F.col("rows"), F.col("all_rows") - F.col("rows")
    base = F.when(rest > 0, (F.col("all_nulls") - F.col("nulls")) / rest).otherwise(0.0)
    return out.where((F.col("rows") >= LEAST_ROWS) & (rate >= NULL_RATE) & (rate - base >= NULL_RATE_OVER_BASELINE)).select(day, "rows", "nulls")


def zero_row_anomalies(rows: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fetched, normalised of every expected sync that fetched nothing, or of which nothing was normalised.

    ``expected`` has the keys (such as account, level and day) of the syncs that ran, a row each; rows have the keys and
    ``is_normalised``.  A day that delivered nothing has no row of its own, so it is found only from what ran.
    """
    got = rows.groupBy(*keys).agg(F.count("*").alias("fetched"), F.count_if("is_normalised").alias("normalised"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = expected.select(*keys).distinct().join(got, keys, "left").select(*keys, zero("fetched"), zero("normalised"))
    return out.where("fetched = 0 or normalised = 0")


def entity_extracts(tables: dict[str, DataFrame], kinds: list[str]) -> DataFrame:
    """platform, account_id, kind, entity, name, report_date of every entity that a platform's spend rows name."""
    parts = []
    for platform, rows in tables.items():
        name = lambda k, rows=rows: F.col(f"{k}_name") if f"{k}_name" in rows.columns else F.lit(None).cast("string")
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_id").alias("entity"), name(k).alias("name")) for k in kinds]))
        parts.append(rows.select(F.lit(platform).alias("platform"), "account_id", "report_date", each.alias("e")).select("platform", "account_id", "report_date", "e.*").where("entity is not null"))
    return reduce(DataFrame.unionByName, parts)


def with_names(rows: DataFrame, metadata: DataFrame, creatives: DataFrame) -> DataFrame:
    """Adds entity_name by (platform, account, campaign) and creative_name by creative, where known."""
    known = metadata.where("kind = 'campaign'").select("platform", "account_id", F.col("entity").alias("campaign_id"), F.col("name").alias("entity_name"))
    return rows.join(known, ["platform", "account_id", "campaign_id"], "left").join(creatives, "creative_id", "left")


def collapse_metadata(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, latest_name (the last that isn't blank), last_seen; needs name, seen and ordinal."""
    named = F.trim("name") != ""
    return rows.groupBy(*keys).agg(F.max_by(F.when(named, F.trim("name")), F.when(named, F.struct("seen", "ordinal"))).alias("latest_name"), F.max("seen").alias("last_seen"))


def metadata_plan(found: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Every named found entity with what to do: insert, update or keep; nameless ones are never written."""
    old = existing.select(*keys, F.col("latest_name").alias("old_name"), F.col("last_seen").alias("old_seen"), F.lit(True).alias("known"))
    out = found.where(F.col("latest_name").isNotNull()).join(old, keys, "left")
    same = F.col("latest_name").eqNullSafe(F.col("old_name")) & F.col("last_seen").eqNullSafe(F.col("old_seen"))
    return out.withColumn("action", F.when(F.col("known").isNull(), "insert").when(same, "keep").otherwise("update")).drop("known", "old_name", "old_seen")


def freshness(metadata: DataFrame, keys: list[str], as_of: Column, stale_hours: int = 48) -> DataFrame:
    stale = F.col("last_seen").isNull() | (F.col("last_seen") < as_of - F.make_dt_interval(hours=F.lit(stale_hours)))
    return metadata.groupBy(*keys).agg(F.count("*").alias("entities"), F.count_if(stale).alias("stale"), F.count_if(~stale).alias("fresh"), F.min("last_seen").alias("oldest"), F.max("last_seen").alias("newest"))


def newest_per_scope(spend: DataFrame, scope: list[str], order: list[Column]) -> DataFrame:
    """The newest spend row of every scope."""
    return spend.withColumn("__rank", F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).where("__rank = 1").drop("__rank")


def campaign_names(newest: DataFrame, metadata: DataFrame, scope: list[str]) -> DataFrame:
    """scope, name, entity_id, status: a scope gets a name only if all its entities' resolutions agree."""
    rows = newest.join(metadata, ["platform", "campaign_id"], "left")
    clean = lambda c: F.nullif(F.regexp_replace(F.trim(c), r"\s+", " "), F.lit(""))
    latest, fallback = clean(F.col("latest_name")), clean(F.col("campaign_name"))
    status = F.when(latest.isNotNull(), "resolved").when(fallback.isNotNull(), "fallback_name").otherwise("unresolved")
    rows = rows.withColumn("r", F.struct(F.coalesce(latest, fallback, F.col("campaign_id"), F.lit("unknown")).alias("name"), F.col("campaign_id").alias("entity_id"), status.alias("status")))
    out = rows.groupBy(*scope).agg(F.countDistinct("r").alias("n"), F.min("r").alias("r"))
    return out.where("n = 1").select(*scope, "r.*")


def missing_dates(calendar: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Days of the calendar for which a connection has no spend: connection x calendar, less what is there."""
    planned = have.select(key).distinct().join(F.broadcast(calendar.agg(F.collect_list("day").alias("days")))).select(key, F.explode("days").alias("day"))
    return planned.join(have.select(key, "day").distinct(), [key, "day"], "left_anti")


def reconciled(planned: DataFrame, missing: DataFrame, key: str) -> DataFrame:
    """key, missing, status of every connection."""
    gone = missing.groupBy(key).agg(F.count("*").alias("missing"))
    out = planned.select(key).distinct().join(gone, key, "left").select(key, F.coalesce("missing", F.lit(0).cast("long")).alias("missing"))
    return out.withColumn("status", F.when(F.col("missing") > 0, "missing").otherwise("healthy"))
