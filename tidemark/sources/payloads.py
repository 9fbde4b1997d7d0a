"""JSON sources: browser events, captures, order webhooks, paged exports and platform insights.

Every source parses with a schema in the scan stage and returns a row for each payload it can't take,
with the reason in ``problem``, so that nothing is lost without a trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dims import CLICK_ID_TYPES, touchpoint
from tidemark.functions.text import lower_to_null, normal_url, query_parameter, trim_to_null, url_host
from tidemark.functions.time import ZONED

# Kinds of browser events, states of consent, and the version of captures.
EVENT_TYPES = ["page_view", "product_view", "add_to_cart", "checkout_started"]
CONSENT_STATES = ["granted", "denied", "unknown"]
CAPTURE_VERSION = 1

EVENT_FIELDS = ["eventType", "occurredAt", "sessionId", "pageUrl", "referrerUrl", "cartToken", "checkoutToken", "clientEventId", "consentState"]
EVENT_SCHEMA = ", ".join(f"{f} string" for f in EVENT_FIELDS) + ", context struct<userAgent:string,screen:string,language:string>"
UTM_FIELDS = ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term"]
URL_FIELDS = ["landing_url", "referrer_url", "page_url"]
CAPTURE_SCHEMA = "schema_version int, session_id string, occurred_at string, captured_at string, " + ", ".join(f"{f} string" for f in [*URL_FIELDS, *UTM_FIELDS, *CLICK_ID_TYPES]) + ", consent_state string"
ORDER_SCHEMA = "id long, customer_id string, source_name string, checkout_token string, cart_token string, total_price string, processed_at string, created_at string, landing_site string, line_items array<struct<sku:string,quantity:int,price:string>>"
METRICS = ["actions", "action_values", "purchase_roas"]
INSIGHT_SCHEMA = "data array<struct<campaign_id:string,campaign_name:string,date_start:string,spend:string,action_type:string," + ",".join(f"{m}:array<struct<action_type:string,value:string>>" for m in METRICS) + ">>, paging struct<next:string>"


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))


def zoned(c: Column) -> Column:
    """The UTC time of a text that names its zone, else null."""
    text = F.trim(c)
    return F.when(text.rlike(ZONED), F.try_to_timestamp(text)).cast("timestamp_ntz")


def has_web_protocol(c: Column) -> Column:
    """Whether a url is http or https; one that is missing passes."""
    return F.coalesce(trim_to_null(c).rlike("(?i)^https?://[^/]+"), F.lit(True))


def consent(c: Column) -> Column:
    return F.when(c.isin(CONSENT_STATES), c).otherwise("unknown")


def payload_consent(payload: Column) -> Column:
    """The state of consent that a payload's text names under either spelling, else unknown."""
    camel, snake = F.get_json_object(payload, "$.consentState"), F.get_json_object(payload, "$.consent_state")
    return F.when(camel.isin(CONSENT_STATES), camel).when(snake.isin(CONSENT_STATES), snake).otherwise("unknown")


def browser_events(raw: DataFrame, body: str = "body") -> DataFrame:
    """Adds problem and the fields of an event; a payload with a field that the schema lacks isn't taken."""
    parsed = raw.withColumn("__e", F.from_json(body, EVENT_SCHEMA)).withColumn("__keys", F.json_object_keys(body))
    e = lambda name: F.col(f"__e.{name}")
    unknown = F.size(F.array_except("__keys", F.array(*[F.lit(f) for f in [*EVENT_FIELDS, "context"]]))) > 0
    problem = (
        F.when(F.col("__keys").isNull(), "not_json").when(unknown, "unknown_field").when(~F.coalesce(e("eventType").isin(EVENT_TYPES), F.lit(False)), "event_type")
        .when(~is_uuid(e("sessionId")), "session_id").when(zoned(e("occurredAt")).isNull(), "occurred_at")
        .when(trim_to_null(e("pageUrl")).isNull() | ~has_web_protocol(e("pageUrl")), "page_url").when(~has_web_protocol(e("referrerUrl")), "referrer_url")
    )
    out = parsed.select(
        *raw.columns, problem.alias("problem"), e("eventType").alias("event_type"), zoned(e("occurredAt")).alias("occurred_at"), F.lower(e("sessionId")).alias("session_id"),
        normal_url(e("pageUrl")).alias("page_url"), normal_url(e("referrerUrl")).alias("referrer_url"), trim_to_null(e("cartToken")).alias("cart_token"), trim_to_null(e("checkoutToken")).alias("checkout_token"),
        trim_to_null(e("clientEventId")).alias("client_event_id"), consent(e("consentState")).alias("consent_state"), trim_to_null(e("context.language")).alias("language"),
    )
    return out


def captures(raw: DataFrame, body: str = "body") -> DataFrame:
    """Adds problem and the normalised fields of an attribution capture of CAPTURE_VERSION."""
    parsed = raw.withColumn("__c", F.from_json(body, CAPTURE_SCHEMA))
    c = lambda name: F.col(f"__c.{name}")
    bad_url = F.lit(False)
    for name in URL_FIELDS:
        bad_url = bad_url | ~has_web_protocol(c(name))
    problem = (
        F.when(F.json_object_keys(body).isNull(), "not_json").when(~F.coalesce(c("schema_version") == CAPTURE_VERSION, F.lit(False)), "schema_version").when(~is_uuid(c("session_id")), "session_id")
        .when(zoned(c("occurred_at")).isNull() | zoned(c("captured_at")).isNull(), "time").when(bad_url, "url")
    )
    return parsed.select(
        *raw.columns, problem.alias("problem"), F.lower(c("session_id")).alias("session_id"), zoned(c("occurred_at")).alias("occurred_at"), zoned(c("captured_at")).alias("captured_at"),
        *[normal_url(c(f)).alias(f) for f in URL_FIELDS], *[lower_to_null(c(f)).alias(f) for f in UTM_FIELDS], *[trim_to_null(c(f)).alias(f) for f in CLICK_ID_TYPES], consent(c("consent_state")).alias("consent_state"),
    )


def capture_status(session: Column, marks: list[Column], urls: list[Column]) -> Column:
    """missing_session_id; complete with a dimension or click id and a url; else partial."""
    known = lambda columns: F.coalesce(*[trim_to_null(c) for c in columns]).isNotNull()
    return F.when(trim_to_null(session).isNull(), "missing_session_id").when(known(marks) & known(urls), "complete").otherwise("partial")


def session_bootstrap(requests: DataFrame, url: str = "url", referrer: str = "referrer") -> DataFrame:
    """Adds landing_url, referrer_url (none from the same host) and the canonical dimensions of the url's query."""
    raw = {f: query_parameter(F.col(url), f"utm_{f}") for f in ("source", "medium", "campaign", "content", "term")}
    raw |= {t: query_parameter(F.col(url), t) for t in CLICK_ID_TYPES}
    own = url_host(F.col(url)).eqNullSafe(url_host(F.col(referrer)))
    return requests.withColumns({"landing_url": normal_url(F.col(url)), "referrer_url": F.when(~own, normal_url(F.col(referrer))), "d": touchpoint(raw)}).select(*requests.columns, "landing_url", "referrer_url", "d.*")


def receipts(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds payload_hash; a delivery is known by its topic, shop and payload."""
    return raw.withColumn("payload_hash", F.sha2(payload, 256))


def new_receipts(old: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Adds duplicate: whether a delivery repeats an old one or an earlier one of its batch."""
    keys = ["topic", "shop", "payload_hash"]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1
    known = old.select(*keys).distinct().withColumn("__known", F.lit(True))
    return incoming.withColumn("__first", first).join(known, keys, "left").withColumn("duplicate", ~F.col("__first") | F.col("__known").isNotNull()).drop("__first", "__known")


def webhook_orders(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds problem and the fields of an order; its time is the first known of processed and created."""
    parsed = raw.withColumn("__o", F.from_json(payload, ORDER_SCHEMA))
    o = lambda name: F.col(f"__o.{name}")
    problem = F.when(F.json_object_keys(payload).isNull(), "not_json").when(o("id").isNull(), "id").when(o("total_price").try_cast("decimal(18,2)").isNull(), "total_price")
    return parsed.select(
        *raw.columns, problem.alias("problem"), o("id").alias("order_id"), trim_to_null(o("customer_id")).alias("customer_id"), F.coalesce(trim_to_null(o("source_name")), F.lit("")).alias("source_name"),
        trim_to_null(o("checkout_token")).alias("checkout_token"), trim_to_null(o("cart_token")).alias("cart_token"), (o("total_price").try_cast("decimal(18,2)") * 100).cast("long").alias("cents"),
        F.coalesce(zoned(o("processed_at")), zoned(o("created_at"))).alias("ordered_at"), o("landing_site").alias("landing_site"), o("line_items").alias("line_items"),
    )


def order_lines(orders: DataFrame) -> DataFrame:
    """order_id, line_no, sku, quantity, cents: one row per line item."""
    rows = orders.where("problem is null").select("order_id", F.posexplode("line_items").alias("line_no", "i"))
    return rows.select("order_id", "line_no", trim_to_null(F.col("i.sku")).alias("sku"), F.col("i.quantity").alias("quantity"), (F.col("i.price").try_cast("decimal(18,2)") * 100).cast("long").alias("cents"))


def paged_rows(pages: DataFrame, schema: str, items: str, body: str = "body") -> DataFrame:
    """The items of stored pages: one row (item_no, item) per entry of the array field ``items``.

    Following a cursor is the fetcher's work; the pages it stored are read together, in any order.
    """
    return pages.withColumn("__p", F.from_json(body, schema)).select(*[c for c in pages.columns if c != body], F.posexplode_outer(f"__p.{items}").alias("item_no", "item")).where("item is not null")


def latest_orders(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """order_id, cents, ordered_at of a backfill: each order's last version among those of the window."""
    rows = rows.where((F.col("ordered_at") >= first) & (F.col("ordered_at") <= last))
    return rows.groupBy("order_id").agg(F.max_by(F.struct("cents", "ordered_at"), "version").alias("v")).select("order_id", "v.*")


def insights(pages: DataFrame, body: str = "body") -> DataFrame:
    """Rows of a platform's paged insights; ``page_no`` and the place on it order what was met first."""
    return paged_rows(pages, INSIGHT_SCHEMA, "data", body).select(*[c for c in pages.columns if c != body], "item_no", "item.*")


def missing_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """The urls that pages name as their next and that weren't fetched; pages have ``url``."""
    following = pages.select(F.get_json_object(body, "$.paging.next").alias("url")).where("url is not null")
    return following.join(pages.select("url"), "url", "left_anti")


def metric_entries(rows: DataFrame, keys: list[str], ordinal: Column) -> DataFrame:
    """(keys, at, kind, action_type, value) of insight rows: the row's own action type first, then its metric lists in order."""
    own = F.struct(F.lit("row").alias("kind"), F.lit(0).alias("no"), F.col("action_type"), F.lit(None).cast("string").alias("value"))
    none = F.array().cast("array<struct<action_type:string,value:string>>")

    def listed(place: int, metric: str) -> Column:
        return F.transform(F.coalesce(metric, none), lambda x, i: F.struct(F.lit(metric).alias("kind"), (F.lit(place * 1_000_000 + 1) + i).alias("no"), x["action_type"].alias("action_type"), x["value"].alias("value")))

    lists = [listed(k, m) for k, m in enumerate(METRICS)]
    flat = rows.select(*keys, ordinal.alias("__at"), F.explode(F.concat(F.array(own), *lists)).alias("e"))
    return flat.select(*keys, F.struct("__at", "e.no").alias("at"), "e.kind", "e.action_type", "e.value")


def dated_rows(rows: DataFrame, column: str, day: str) -> DataFrame:
    """The rows of one day of a query-language export."""
    return rows.where(F.col(column) == day)


def shards(daily: DataFrame, intraday: DataFrame, first: str, last: str, suffix: str = "suffix") -> DataFrame:
    """Rows of daily and intraday shards whose suffix (yyyymmdd) lies in the range; a partition column, so other shards aren't read."""
    keep = F.col(suffix).between(first, last)
    return daily.where(keep).withColumn("table_type", F.lit("events")).unionByName(intraday.where(keep).withColumn("table_type", F.lit("intraday")))


def stable_json(c: Column) -> Column:
    """A JSON text with the keys of every object in order, however deep; null if it is no JSON."""
    return F.to_json(F.try_parse_json(c))


def sql_fingerprint(values: dict[str, Column]) -> Column:
    """SHA-256 of the fields as a database prints a binary JSON object: shorter keys first, then by letters; a missing value is ''."""
    text = lambda c: F.regexp_extract(F.to_json(F.array(F.coalesce(c, F.lit("")))), r"^\[(.*)\]$", 1)
    names = sorted(values, key=lambda k: (len(k), k))
    parts = [x for i, k in enumerate(names) for x in (F.lit(f"{', ' if i else '{'}\"{k}\": "), text(values[k]))]
    return F.sha2(F.concat(*parts, F.lit("}")), 256)


def json_key(*columns: str | Column) -> Column:
    """SHA-256 of the columns' JSON in the given order, nulls included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def typed_json(snapshot: Column, path: str, kind: str) -> Column:
    """The value at a path if its JSON type is the asked one: a number for double, a text that isn't blank for string."""
    value = F.try_variant_get(F.try_parse_json(snapshot), path, "variant")
    is_text = F.schema_of_variant(value) == "STRING"
    if kind == "string":
        found = F.try_variant_get(value, "$", "string")
        return F.when(is_text & (F.trim(found) != ""), found)
    number = F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return F.when(number, F.try_variant_get(value, "$", "double"))


def json_texts(c: Column) -> Column:
    """The texts of a JSON array, none if it isn't one."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
