"""Canonical marketing dimensions: source, medium, campaign, content, term and click id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import freeform, lookup_key, or_unknown, trim_to_null

# Click id types in order of priority.
CLICK_ID_TYPES = ["gclid", "gbraid", "wbraid", "fbclid", "ttclid", "msclkid"]

# Names of sources.
SOURCES = {
    "google": ["google", "google_ads", "googleadwords", "google_adwords", "adwords", "youtube"],
    "microsoft": ["bing", "microsoft", "microsoft_ads", "msn"],
    "meta": ["facebook", "fb", "instagram", "ig", "meta", "meta_ads"],
    "tiktok": ["tiktok", "tik_tok", "tt"],
    "email": ["email", "e_mail", "newsletter", "klaviyo", "mailchimp"],
    "direct": ["direct"],
    "referral": ["referral"],
    "organic": ["organic", "organic_search", "seo"],
    "shopify": ["shopify"],
}

# Names of media.
MEDIA = {
    "cpc": ["cpc", "ppc", "sem", "paidsearch", "paid_search"],
    "paid_social": ["paidsocial", "paid_social", "social_paid", "social"],
    "email": ["email", "e_mail", "newsletter"],
    "organic_search": ["organic", "organic_search", "seo"],
    "referral": ["referral"],
    "affiliate": ["affiliate"],
    "display": ["display", "banner", "programmatic"],
    "sms": ["sms", "text"],
    "direct": ["direct", "none"],
}

# What a click id implies.
CLICK_ID_IMPLIES = {
    "gclid": ("google", "cpc"),
    "gbraid": ("google", "cpc"),
    "wbraid": ("google", "cpc"),
    "fbclid": ("meta", "paid_social"),
    "ttclid": ("tiktok", "paid_social"),
    "msclkid": ("microsoft", "cpc"),
}

UNMAPPED = "unmapped"


def _lookup(key: Column, names: dict[str, list[str]]) -> Column:
    """The canonical name; one literal map, which keeps the generated code small."""
    pairs = [F.lit(x) for canonical, aliases in names.items() for alias in aliases for x in (alias, canonical)]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(UNMAPPED))


def _implied(click_type: Column, at: int) -> Column:
    return F.create_map(*[F.lit(x) for name, implied in CLICK_ID_IMPLIES.items() for x in (name, implied[at])])[click_type]


def click_id(explicit_type: Column, explicit_value: Column, fields: dict[str, Column]) -> Column:
    """struct(type, value): the explicit pair, else the first field that has a value, else what there is."""
    key, value = lookup_key(explicit_type), trim_to_null(explicit_value)
    known = F.when(key.isin(CLICK_ID_TYPES), key)
    out = F.struct(known.alias("type"), value.alias("value"))
    for name in reversed([t for t in CLICK_ID_TYPES if t in fields]):
        own = trim_to_null(fields[name])
        out = F.when(own.isNotNull(), F.struct(F.lit(name).alias("type"), own.alias("value"))).otherwise(out)
    return F.when(known.isNotNull() & value.isNotNull(), F.struct(known.alias("type"), value.alias("value"))).otherwise(out)


def source(raw: Column, click_type: Column) -> Column:
    key = lookup_key(raw)
    return F.when(F.coalesce(key, F.lit("")) != "", _lookup(key, SOURCES)).otherwise(_implied(click_type, 0))


def medium(raw: Column, click_type: Column) -> Column:
    key = lookup_key(raw)
    return F.when(F.coalesce(key, F.lit("")) != "", _lookup(key, MEDIA)).otherwise(_implied(click_type, 1))


def touchpoint(raw: dict[str, Column]) -> Column:
    """struct of canonical dimensions from raw columns: the five dimensions, click_type, click_value and click id fields."""
    none = F.lit(None).cast("string")
    get = lambda name: raw.get(name, none)
    click = click_id(get("click_type"), get("click_value"), {k: raw[k] for k in CLICK_ID_TYPES if k in raw})
    return F.struct(
        source(get("source"), click["type"]).alias("source"),
        medium(get("medium"), click["type"]).alias("medium"),
        *[freeform(get(name)).alias(name) for name in ("campaign", "content", "term")],
        click["type"].alias("click_type"),
        click["value"].alias("click_value"),
    )


def spend(raw: dict[str, Column]) -> Column:
    """As touchpoint(), with unknown instead of nulls, and without the click id."""
    dims = touchpoint(raw)
    return F.struct(*[or_unknown(dims[name]).alias(name) for name in ("source", "medium", "campaign", "content", "term")])
