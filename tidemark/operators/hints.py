"""Orders' own evidence: attributes, marketing hints, landing sessions, recovery, and write-back of what was resolved."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dims import CLICK_ID_TYPES, touchpoint
from tidemark.functions.text import query_parameter, trim_to_null
from tidemark.operators.attribution import TIERS

# Names of attributes, their order, and the confidence of a hint with and without a click id.
UTM = ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term"]
LANDING_KEYS = ["landing_url", "page_url", "landing_path", "landing_site"]
HINT_CONFIDENCE = (0.55, 0.4)
# What a reason says of tier and source, and the labels of tiers.
REASONS = {
    "shopify_hint_derived": ("deterministic_shopify_hint", "shopify_marketing_hint"),
    "matched_by_landing_session": ("deterministic_first_party", "landing_session_id"),
    "matched_by_checkout_token": ("deterministic_first_party", "checkout_token"),
    "matched_by_cart_token": ("deterministic_first_party", "cart_token"),
    "matched_by_customer_identity": ("deterministic_first_party", "stitched_identity_journey"),
    "unattributed": ("unattributed", "unattributed"),
}
TIER_LABELS = {"deterministic_first_party": "Deterministic first-party", "deterministic_shopify_hint": "Deterministic Shopify hint", "ga4_fallback": "GA4 fallback", "unattributed": "Unattributed"}
STAGES = ["resolved_in_first_party", "fell_through_to_shopify_hint", "fell_through_to_ga4_fallback", "fell_through_to_unattributed"]


def attribute(attributes: Column, name: str) -> Column:
    """The trimmed value of the first entry (name, value) of that name, null if blank."""
    return trim_to_null(F.get(F.filter(attributes, lambda x: x["name"] == name), F.lit(0))["value"])


def first_attribute(lists: list[Column], names: list[str]) -> Column:
    """The first known of the names in the first list, then in the next."""
    return F.coalesce(*[attribute(a, n) for a in lists for n in names])


def attribute_map(payload: Column) -> Column:
    """All attributes of an order's JSON, given as lists of (name or key, value) or as objects; later ones win, blank ones don't count."""
    out = None
    for field in ("note_attributes", "attributes"):
        raw = F.get_json_object(payload, f"$.{field}")
        entries = F.from_json(raw, "array<struct<name:string,key:string,value:string>>")
        listed = F.transform(entries, lambda x: F.struct(F.coalesce(trim_to_null(x["name"]), trim_to_null(x["key"])).alias("key"), trim_to_null(x["value"]).alias("value")))
        keyed = F.map_entries(F.from_json(raw, "map<string,string>"))
        keyed = F.transform(keyed, lambda x: F.struct(x["key"].alias("key"), trim_to_null(x["value"]).alias("value")))
        own = F.when(F.ltrim(raw).startswith("["), listed).when(F.ltrim(raw).startswith("{"), keyed)
        own = F.filter(F.coalesce(own, F.array().cast("array<struct<key:string,value:string>>")), lambda x: x["key"].isNotNull() & x["value"].isNotNull())
        out = own if out is None else F.concat(out, own)
    # of equal keys the last entry stays
    last = F.filter(out, lambda x, i: ~F.exists(F.slice(out, i + 2, F.size(out)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def hints(orders: DataFrame, prefix: str = "app_") -> DataFrame:
    """order_id, the canonical dimensions of an order's hint, and its confidence; orders without a dimension have no row.

    ``orders`` have landing_site and the lists note_attributes and attributes of (name, value).  A
    field is taken from an attribute of its name, or of its name after ``prefix``; else from the query of the
    landing site, then of a landing attribute.
    """
    lists = [F.col("note_attributes"), F.col("attributes")]
    urls = [trim_to_null(F.col("landing_site"))] + [first_attribute([a], [k for n in LANDING_KEYS for k in (n, prefix + n)]) for a in lists]
    base = F.lit("https://hint.local")
    urls = [F.when(u.rlike("(?i)^https?://"), u).otherwise(F.concat(base, F.when(u.startswith("/"), u).otherwise(F.concat(F.lit("/"), u)))) for u in urls]
    # inline() keeps the optimizer from writing an expression out wherever the next step names it
    orders = orders.select("order_id", "note_attributes", "attributes", F.inline(F.array(F.struct(*[u.alias(f"u{i}") for i, u in enumerate(urls)]))))
    value = lambda name: F.coalesce(first_attribute(lists, [name, prefix + name]), *[trim_to_null(query_parameter(F.col(f"u{i}"), name)) for i in range(len(urls))])
    raw = orders.select("order_id", F.inline(F.array(F.struct(*[value(n).alias(n) for n in [*UTM, *CLICK_ID_TYPES]]))))
    fields = {n.removeprefix("utm_"): F.col(n) for n in [*UTM, *CLICK_ID_TYPES]}
    out = raw.select("order_id", F.inline(F.array(touchpoint(fields))))
    known = F.coalesce("source", "medium", "campaign", "content", "term", "click_type", "click_value").isNotNull()
    return out.where(known).withColumn("confidence", F.when(F.col("click_value").isNotNull(), HINT_CONFIDENCE[0]).otherwise(HINT_CONFIDENCE[1]))


def landing_session(orders: DataFrame, sessions: DataFrame, touches: DataFrame, explicit: str = "explicit_session") -> DataFrame:
    """order_id, session_id, found_by: the session an order names if it exists, else the latest with its checkout token, then its cart token.

    The latest touch of a token is one row per token, so a hot token meets its orders once each.
    """
    named = orders.select("order_id", F.col(explicit).alias("session_id")).join(sessions.select("session_id").distinct(), "session_id").select("order_id", F.col("session_id").alias("explicit"))
    out = orders.select("order_id", "checkout_token", "cart_token").join(named, "order_id", "left")
    for token in ("checkout_token", "cart_token"):
        known = touches.join(sessions.select("session_id").distinct(), "session_id", "left_semi").where(F.col(token).isNotNull())
        latest = known.groupBy(token).agg(F.max_by("session_id", F.struct("ts", "event_id")).alias(f"by_{token}"))
        out = out.join(latest, token, "left")
    by = F.when(F.col("explicit").isNotNull(), "explicit").when(F.col("by_checkout_token").isNotNull(), "checkout_token").when(F.col("by_cart_token").isNotNull(), "cart_token")
    return out.select("order_id", F.coalesce("explicit", "by_checkout_token", "by_cart_token").alias("session_id"), by.alias("found_by"))


def needs_recovery(orders: DataFrame, credits: DataFrame) -> DataFrame:
    """Web orders without a last-touch credit, or with one that names no source, medium or campaign."""
    last = credits.where("model = 'last_touch'").groupBy("order_id").agg(F.max(F.coalesce("source", "medium", "campaign").isNotNull()).alias("__named"))
    web = orders.where(F.coalesce("source_name", F.lit("")) == "web")
    return web.join(last, "order_id", "left").where(~F.coalesce("__named", F.lit(False))).drop("__named")


def recovered(scope: DataFrame, landing: DataFrame, found: DataFrame) -> DataFrame:
    """order_id, relinked, outcome of each order in scope.

    An order whose landing session is now another one is relinked; one without any takes its hint; the
    others go back to the queue.  ``scope`` has session_id as known so far.
    """
    out = scope.select("order_id", F.col("session_id").alias("old")).join(landing.select("order_id", F.col("session_id").alias("new")), "order_id", "left")
    out = out.join(found.select("order_id", F.lit(True).alias("hinted")), "order_id", "left")
    relinked = F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old"))
    outcome = F.when(F.col("new").isNull() & F.col("hinted"), "hint").otherwise("requeued")
    return out.select("order_id", relinked.alias("relinked"), outcome.alias("outcome"))


def recovery_report(rows: DataFrame) -> DataFrame:
    """One row: rescanned, relinked, requeued and hinted orders."""
    return rows.agg(F.count("*").alias("rescanned"), F.count_if("relinked").alias("relinked"), F.count_if(F.col("outcome") == "requeued").alias("requeued"), F.count_if(F.col("outcome") == "hint").alias("hinted"))


def tier_label(tier: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in TIER_LABELS.items() for x in pair])[known_tier(tier)]


def known_tier(tier: Column) -> Column:
    """The tier if there is such one, else unattributed."""
    return F.when(tier.isin(TIERS), tier).otherwise(TIERS[-1])


def reason_tier(reason: Column) -> Column:
    """struct(tier, source) of the reason of a stored result; reasons that aren't known are of the fallback."""
    tier, source = (F.create_map(*[F.lit(x) for name, pair in REASONS.items() for x in (name, pair[k])])[reason] for k in (0, 1))
    return F.struct(F.coalesce(tier, F.lit("ga4_fallback")).alias("tier"), F.coalesce(source, F.lit("ga4_fallback")).alias("source"))


def audit(tier: Column, evidence: Column, matched_at: Column, reason: Column) -> Column:
    """struct(tier, source, matched_at, reason): the record that is kept of a resolved order."""
    first_party = F.when(evidence == "customer_identity", "stitched_identity_journey").otherwise(evidence)
    source = F.when(tier == TIERS[0], first_party).when(tier == TIERS[1], "shopify_marketing_hint").when(tier == TIERS[2], "ga4_fallback").otherwise("unattributed")
    return F.struct(known_tier(tier).alias("tier"), source.alias("source"), matched_at.alias("matched_at"), reason.alias("reason"))


def outcome(tier: Column, has_winner: Column, is_direct: Column) -> Column:
    """struct(depth, stage, outcome): how far resolution fell through, and what won."""
    depth = F.array_position(F.array(*[F.lit(t) for t in TIERS]), known_tier(tier)).cast("int") - 1
    won = F.when(~has_winner, "unattributed").when(is_direct, "direct_winner").otherwise("non_direct_winner")
    return F.struct(depth.alias("depth"), F.get(F.array(*[F.lit(s) for s in STAGES]), depth).alias("stage"), won.alias("outcome"))


def last_touch(touches: DataFrame, columns: list[str]) -> DataFrame:
    """Per session its last touch by (time, event)."""
    return touches.groupBy("session_id").agg(F.max_by(F.struct(*columns), F.struct("ts", "event_id")).alias("__t")).select("session_id", "__t.*")


def writeback_attributes(orders: DataFrame, results: DataFrame, touches: DataFrame) -> DataFrame:
    """order_id and the map of attributes that an order should carry.

    An order's session is the resolved one, else its landing session; the session's last touch gives the
    rest.  Orders without a session have a null map.
    """
    keyed = orders.join(results.select("order_id", F.col("session_id").alias("__resolved")), "order_id", "left").withColumn("session", F.coalesce("__resolved", "session_id")).select("order_id", "session")
    last = last_touch(touches, ["source", "medium", "campaign", "click_value"]).withColumnRenamed("session_id", "session")
    out = keyed.join(last, "session", "left")
    names = {"session_id": "session", "utm_source": "source", "utm_medium": "medium", "utm_campaign": "campaign", "click_id": "click_value"}
    entries = F.array(F.struct(F.lit("schema_version").alias("key"), F.lit("1").alias("value")), *[F.struct(F.lit(k).alias("key"), F.col(v).alias("value")) for k, v in names.items()])
    return out.select("order_id", F.when(F.col("session").isNotNull(), F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull()))).alias("expected"))


def reconciled(expected: DataFrame, current: DataFrame) -> DataFrame:
    """order_id, status, missing, different: how the attributes that an order carries meet the expected ones.

    Attributes beyond the expected ones don't count.
    """
    out = expected.join(current.select("order_id", "current"), "order_id", "left")
    have = F.coalesce("current", F.create_map().cast("map<string,string>"))
    want = F.map_entries("expected")
    missing = F.size(F.filter(want, lambda x: have[x["key"]].isNull()))
    different = F.size(F.filter(want, lambda x: have[x["key"]].isNotNull() & (have[x["key"]] != x["value"])))
    status = F.when(F.col("expected").isNull(), "no_session").when((missing == 0) & (different == 0), "up_to_date").otherwise("needs_writeback")
    return out.select("order_id", status.alias("status"), F.when(F.col("expected").isNull(), 0).otherwise(missing).alias("missing"), F.when(F.col("expected").isNull(), 0).otherwise(different).alias("different"))


def filtered(rows: DataFrame, model: str, source: str | None = None, campaign: str | None = None, tier: str | None = None) -> DataFrame:
    """Orders' credits by model and optional source, campaign and tier; an order without a tier is unattributed."""
    tests = [F.col("model") == model]
    tests += [F.col(c) == v for c, v in (("source", source), ("campaign", campaign)) if v]
    tests += [F.coalesce("tier", F.lit(TIERS[-1])) == tier] if tier else []
    return rows.where(reduce(lambda a, b: a & b, tests))
