"""Tables that come as shards by day (a suffix yyyymmdd): laid out so that a range reads only its own files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds of shards; intraday rows give way to daily ones of the same day.
KINDS = ("events", "intraday")


def suffix_of(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def write_shards(rows: DataFrame, path: str, kind: Column, day: Column) -> None:
    """Rows into a folder for each kind and suffix; shards that rows hold are replaced, others stay."""
    dealt = rows.withColumns({"table_type": kind, "table_suffix": suffix_of(day)})
    dealt.repartition("table_type", "table_suffix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table_type", "table_suffix").parquet(path)


def read_shards(spark: SparkSession, path: str, rows: str) -> DataFrame:
    """All shards, with table_type and table_suffix as texts; ``rows`` is the schema of a shard's rows."""
    return spark.read.schema(f"{rows}, table_type string, table_suffix string").parquet(path)


def between(shards: DataFrame, first: str, last: str) -> DataFrame:
    """The shards of a range of suffixes; a filter of the partition column, so no other file is read."""
    return shards.where(F.col("table_suffix").between(first, last))


def since(shards: DataFrame, watermarks: DataFrame, last: str, trailing_days: int = 0) -> DataFrame:
    """The shards of every kind from its watermark (table_type, watermark: a date), less some days that are read again, to ``last``.

    The suffixes are a small table made of the watermarks, one row a day, that the shards meet by equality; so Spark
    prunes the files while it runs, by what the watermarks say then.
    """
    first = F.date_sub("watermark", trailing_days)
    days = watermarks.where(first <= F.to_date(F.lit(last), "yyyyMMdd")).select("table_type", F.explode(F.sequence(first, F.to_date(F.lit(last), "yyyyMMdd"))).alias("day"))
    return shards.join(F.broadcast(days.select("table_type", suffix_of(F.col("day")).alias("table_suffix")).distinct()), ["table_type", "table_suffix"], "left_semi")


def one_kind_a_day(shards: DataFrame) -> DataFrame:
    """Rows of the daily shard of a suffix, or of the intraday one where there is no daily shard; kinds are looked up per suffix, not per row."""
    best = shards.groupBy("table_suffix").agg(F.min(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("table_type"))).alias("__kind"))
    kept = best.select("table_suffix", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("__kind").cast("int")).alias("table_type"))
    return shards.join(F.broadcast(kept), ["table_suffix", "table_type"], "left_semi")  # a row a day
