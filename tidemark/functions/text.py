"""Column functions on text, hashes, urls and numbers.  All take and return columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_SPACE = r"^[\s ﻿]+|[\s ﻿]+$"


def trim_to_null(c: Column) -> Column:
    trimmed = F.regexp_replace(c, EDGE_SPACE, "")
    return F.when(trimmed != "", trimmed)


def lower_to_null(c: Column) -> Column:
    return F.lower(trim_to_null(c))


def upper_to_null(c: Column) -> Column:
    return F.upper(trim_to_null(c))


def lookup_key(c: Column) -> Column:
    """Lower case, runs of other than letters and digits as one underscore, none at the edges."""
    return F.regexp_replace(F.regexp_replace(lower_to_null(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def freeform(c: Column) -> Column:
    return F.regexp_replace(lower_to_null(c), r"\s+", " ")


def or_unknown(c: Column) -> Column:
    return F.coalesce(c, F.lit("unknown"))


def is_hex64(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def email_hash(c: Column) -> Column:
    return F.sha2(lower_to_null(c), 256)


def e164(c: Column) -> Column:
    """Plus and digits by the country rules below, else null."""
    trimmed = trim_to_null(c)
    digits = F.regexp_replace(trimmed, r"\D", "")
    tail = F.substring(digits, 3, 100)

    def plausible(d: Column) -> Column:
        return F.when(d.rlike("^[0-9]{8,15}$"), F.concat(F.lit("+"), d))

    return (
        F.when(trimmed.startswith("+"), plausible(digits))
        .when(digits.startswith("00"), plausible(tail))
        .when(F.length(digits) == 10, F.concat(F.lit("+1"), digits))
        .when((F.length(digits) == 11) & digits.startswith("1"), F.concat(F.lit("+"), digits))
        .otherwise(plausible(digits))
    )


def phone_hash(c: Column) -> Column:
    return F.sha2(e164(c), 256)


def escaped_contains(c: Column, needle: str) -> Column:
    """Case-insensitive containment; wildcard characters of the needle stand for themselves."""
    return F.contains(F.lower(c), F.lit(needle.lower()))


def query_parameter(url: Column, name: str) -> Column:
    """The first value of a query parameter, decoded; null if there is none."""
    raw = F.regexp_extract(url, rf"^[^?#]*\?(?:[^#]*&)??{name}=([^&#]*)", 1)
    return F.when(raw != "", F.try_url_decode(raw))


def normal_url(c: Column) -> Column:
    """An http or https url without its fragment, else null."""
    bare = F.regexp_replace(trim_to_null(c), "#.*$", "")
    return F.when(bare.rlike("^https?://[^/]+"), bare)


def resolved_url(c: Column, base: str) -> Column:
    """An http or https url without its fragment, resolved against a base; null for other schemes."""
    text = F.regexp_replace(trim_to_null(c), "#.*$", "")
    origin = re.match(r"(https?:)//[^/?#]+", base)
    path = re.sub(r"[?#].*$", "", base)[origin.end() :] or "/"
    joined = (
        F.when(text.rlike("(?i)^https?://[^/]+"), text).when(text.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), None).when(text.startswith("//"), F.concat(F.lit(origin[1]), text))
        .when(text.startswith("/"), F.concat(F.lit(origin[0]), text)).when(text.startswith("?"), F.concat(F.lit(origin[0] + path), text)).otherwise(F.concat(F.lit(origin[0] + path[: path.rindex("/") + 1]), text))
    )
    return joined


def ip_hash(c: Column) -> Column:
    return F.sha2(trim_to_null(c), 256)


def rate4(a: Column, b: Column) -> Column:
    """a / b to four decimals, null unless b is over zero."""
    return F.when(b > 0, F.floor(a.cast("double") / b.cast("double") * 10_000 + 0.5) / 10_000.0)


def cents_text(c: Column) -> Column:
    """Integer cents as a text with two decimals."""
    sign = F.when(c < 0, "-").otherwise("")
    return F.concat(sign, F.floor(F.abs(c) / 100).cast("string"), F.lit("."), F.lpad((F.abs(c) % 100).cast("string"), 2, "0"))


def date_list(c: Column) -> Column:
    """The ISO dates of an array of texts, each once and in order."""
    return F.array_sort(F.array_distinct(F.filter(c, lambda x: x.rlike(r"^\d{4}-\d{2}-\d{2}$"))))


def url_host(c: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(c, r"^https?://([^/:?#]+)", 1), F.lit("")))


def number_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def strict_number(c: Column) -> Column:
    return trim_to_null(c).try_cast("double")


def integer_prefix(c: Column) -> Column:
    """The leading integer of a text, 0 if there is none."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0).cast("long"))


def cents(c: Column) -> Column:
    """Money to integer cents, half up."""
    return F.floor(c * 100 + 0.5).cast("long")


def rounded(c: Column, digits: int) -> Column:
    return F.floor(c * 10**digits + 0.5) / float(10**digits)


def micros_to_cents(c: Column) -> Column:
    return F.floor(c / 10_000 + 0.5).cast("long")


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def backoff_seconds(attempt: Column, base: int, cap: int) -> Column:
    """base * 2 ** (attempt - 1), at most cap."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(attempt, F.lit(1)) - 1), F.lit(float(cap))).cast("long")


def free_text_match(columns: list[str], needle: str) -> Column:
    """Whether any column's text holds the needle, whatever the case."""
    return F.contains(F.lower(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in columns])), F.lit(needle.strip().lower()))
