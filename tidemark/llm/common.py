"""Helpers that the text operators share: table access, tokens and 64-bit mixing; staging comes from tidemark.storage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ship
from tidemark.storage import discard, shared_dir, stage

__all__ = ["LOWER", "crc_mod", "discard", "id_hash", "mix64", "shared_dir", "stage", "table", "words_of"]

#: Upper-case ASCII to lower case; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_hash(*columns: str | Column) -> Column:
    """A non-negative hash of the columns, for sampling and for dealing rows out."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 31))


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; null ids have no remainder."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def words_of(text: str | None) -> list[bytes]:
    """The runs of bytes outside space and tab to carriage return, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
