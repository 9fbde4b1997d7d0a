"""A Parquet table whose parts are replaced as a unit, by manifests that readers follow.

Rows are written to a new folder, parted by one column; then a manifest, one file, names for every part the
folder that holds it now.  A reader takes the newest manifest, so it sees all of a change or nothing, and a
writer that dies before its manifest leaves the old rows in place.  Each change has the name of its run; a run that
a manifest already has is not done again.  A table has one writer at a time; one that finds a newer version than it
started from stops.  Folders that no manifest names are for a lifetime rule to remove.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "run string, part string, root string, version long"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there; any other failure is raised."""
    try:
        spark.read.schema("x string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


class Versioned:
    """The table at ``path`` with the columns of ``schema``, parted by the column ``part``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, part: str):
        self.spark, self.path, self.schema, self.part = spark, path.rstrip("/"), schema, part
        self.columns = [f.name for f in schema]

    def manifests(self) -> DataFrame:
        """run, part, root, version of all versions."""
        path = f"{self.path}/manifests"
        return self.spark.read.schema(MANIFEST).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], MANIFEST)

    def version(self) -> int:
        """The newest version; 0 before the first."""
        return self.manifests().agg(F.max("version")).first()[0] or 0

    def roots(self, version: int | None = None) -> dict[str, list[str]]:
        """The folders of a version (the newest) and the parts that each holds; parts are few, as days are."""
        found: dict[str, list[str]] = {}
        for r in self.manifests().where(F.col("version") == (self.version() if version is None else version)).where("part is not null").collect():
            found.setdefault(r["root"], []).append(r["part"])
        return found

    def read(self, parts: list[str] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version, of all parts or of some; only their folders are read."""
        out = self.spark.createDataFrame([], self.schema)
        for root, held in sorted(self.roots(version).items()):
            wanted = held if parts is None else sorted(set(held) & set(parts))
            if wanted:
                kind = self.schema[self.part].dataType
                rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/{root}").where(F.col(self.part).isin(*[F.lit(p).cast(kind) for p in wanted]))
                out = out.unionByName(rows.select(self.columns))
        return out

    def replace(self, rows: DataFrame, parts: list[str] | None, run: str) -> int:
        """The rows of ``parts`` (None: all) give way to ``rows``, which lie in them; returns the version that has them."""
        done = self.manifests().where(F.col("run") == run).agg(F.min("version")).first()[0]
        if done:
            return done
        now, root = self.version(), f"data/{uuid.uuid4().hex}"
        dealt = rows.select(self.columns).hint("rebalance", self.part)  # few files a part, and large parts in several
        dealt.write.partitionBy(self.part).parquet(f"{self.path}/{root}")
        own = [str(r[0]) for r in self.spark.read.schema(self.schema).parquet(f"{self.path}/{root}").select(F.col(self.part).cast("string")).distinct().collect()]
        if parts is not None and set(own) - set(parts):
            raise ValueError(f"rows outside the replaced parts: {sorted(set(own) - set(parts))[:3]}")
        kept = [] if parts is None else [(p, r) for r, held in self.roots(now).items() for p in held if p not in set(parts)]
        listed = [(run, p, r) for p, r in [*kept, *[(p, root) for p in own]]] or [(run, None, None)]
        manifest, number = self.spark.createDataFrame(listed, "run string, part string, root string").coalesce(1), now + 1
        while True:
            try:
                manifest.write.mode("errorifexists").parquet(f"{self.path}/manifests/version={number}")
            except AnalysisException as e:
                if e.getCondition() != "PATH_ALREADY_EXISTS":
                    raise
                if self.version() != now:
                    raise RuntimeError(f"another writer has changed {self.path}") from e
                number += 1  # a manifest that was broken off has no rows
            else:
                return number

    def merge(self, rows: DataFrame, ids: DataFrame, parts: list[str], run: str) -> int:
        """All rows of the ``ids`` in ``parts`` give way to ``rows``; the parts' other rows stay."""
        rest = self.read(parts).join(ids, ids.columns, "left_anti")
        return self.replace(rest.select(self.columns).unionByName(rows.select(self.columns)), parts, run)

    def history(self) -> DataFrame:
        """version, run, parts."""
        return self.manifests().groupBy("version", "run").agg(F.count("part").alias("parts"))
