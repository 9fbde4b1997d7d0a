"""Column functions on time.  Timestamps without zone are UTC."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "America/Los_Angeles"
# Short names of zones.
ZONE_ALIASES = {"PST": "America/Los_Angeles", "PDT": "America/Los_Angeles", "PT": "America/Los_Angeles"}
ZONES = sorted(available_timezones())
ZONED = r"(?i)(z|[+-]\d{2}:?\d{2})$"


def event_time(*candidates: str) -> Column:
    """The first time that is known."""
    return F.coalesce(*candidates)


def zoned_time(*names: str) -> Column:
    """struct(ts, source) of the first text column that parses and names its zone."""
    out = F.struct(F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("source"))
    for name in reversed(names):
        text = F.trim(F.col(name))
        ts = F.when(text.rlike(ZONED), F.try_to_timestamp(text))
        out = F.when(ts.isNotNull(), F.struct(ts.alias("ts"), F.lit(name).alias("source"))).otherwise(out)
    return out


def local(ts: Column, zone: str = ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def local_date(ts: Column, zone: str = ZONE) -> Column:
    """The business date of a UTC time."""
    return F.to_date(local(ts, zone))


def in_local_days(ts: Column, first: str, last: str, zone: str = ZONE) -> Column:
    """first <= local date <= last, as a range of the raw column, so that scans can prune on it."""
    start = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.lit(f"{first} 00:00:00").cast("timestamp_ntz"))
    end = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz"))
    return (ts >= start) & (ts < end)


def day_bounds(day: Column, zone: str = ZONE) -> Column:
    """struct(starts, ends): the UTC times of a local day's first and last millisecond."""
    starts = F.convert_timezone(F.lit(zone), F.lit("UTC"), day.cast("timestamp_ntz"))
    ends = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.date_add(day, 1).cast("timestamp_ntz"))
    return F.struct(starts.alias("starts"), (ends - F.expr("interval 1 millisecond")).alias("ends"))


def days(spark: SparkSession, first: str, last: str, name: str = "day") -> DataFrame:
    """One row per date of an inclusive range."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(name))


def hours(spark: SparkSession, first: str, last: str, name: str = "hour") -> DataFrame:
    """One row per hour of an inclusive range."""
    step = F.expr("interval 1 hour")
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"), step)).alias(name))


def day_count(first: Column, last: Column) -> Column:
    return F.datediff(last, first) + 1


def hour_lag(latest: Column, done: Column) -> Column:
    """Hours that ``done`` is behind ``latest``, to the nearest and none below zero."""
    seconds = (F.unix_micros(latest.cast("timestamp")) - F.unix_micros(done.cast("timestamp"))) / 1e6
    return F.greatest(F.round(seconds / 3_600), F.lit(0)).cast("long")


def zone_name(c: Column) -> Column:
    """A zone's name for the short names that users give, any name with a region as it is, else null."""
    short = F.create_map(*[F.lit(x) for pair in ZONE_ALIASES.items() for x in pair])[F.upper(F.trim(c))]
    return F.coalesce(short, F.when(F.trim(c).isin(ZONES), F.trim(c)))
