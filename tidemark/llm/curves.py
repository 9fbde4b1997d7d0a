"""Approximate nearest neighbours by shifted space-filling curves.

Equal vectors are one class with its smallest ids, so copies never fill a window.  Each of CURVES orderings
projects the classes onto BITS-bit cells of WIDTH random directions, shifted by a random offset, and sorts them
by their place on a Hilbert curve; Spark cuts that order into ranges and gives every class its rank.
A query meets all classes within ``window`` ranks of its own on each curve.  Windows lie over aligned blocks of BLOCK
ranks: a task gets one block and the queries whose windows touch it, measures true distances and keeps the best; what
the blocks and curves find is merged and ranked again.

Fitted on samples, both bounded by SAMPLE components: the scale of each direction, and the window: the exact
nearest neighbours of at most about PROBES queries are found by a scan, and the window is the rank distance that
holds TARGET of them on at least one curve.  It follows the data: the less its structure, the wider
(on vectors without any, windows hold most of the table).  A vector length that no probe has is scanned whole.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
null ids; a query meets vectors of its own length only; ties go to the smaller vec_id; rows that repeat both
vec_id and vector are one; none is a candidate for its own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import id_hash, stage, table
from tidemark.llm.order import positions
from tidemark.session import ship

TOP = 10
CURVES, WIDTH, BITS = 4, 6, 10
#: Ranks of a block, and queries that meet it in one task.
BLOCK, QUERY_BLOCK = 4_096, 4_096
#: Components of a sample at most, queries of the calibration, and the share of their neighbours that windows hold.
SAMPLE, PROBES, TARGET = 2_000_000, 400, 0.97
HIT = "asked long, row long, ids array<long>, score double"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of points (n, width) of non-negative integers on a Hilbert curve; width * bits is 63 at most.

    Coordinates become the transposed form of the index: from the highest bit down, a set bit inverts the lower bits of
    the first axis, a clear one exchanges them with the axis at hand; a Gray code then undoes the reflections.
    """
    axes = [c.astype(np.int64) for c in np.ascontiguousarray(cells.T)]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i, axis in enumerate(axes):
            up = (axis >> b & 1).astype(bool)
            swap = (axes[0] ^ axis) & low
            axes[0], other = np.where(up, axes[0] ^ low, axes[0] ^ swap), np.where(up, axis, axis ^ swap)
            if i:
                axes[i] = other
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(axes[-1] >> b & 1, (1 << b) - 1, 0)
    key = np.zeros_like(axes[0])
    for b in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | ((axis ^ turn) >> b & 1)
    return key


class Curve:
    """Directions, scale and shift of one ordering of vectors of one length; the same seed gives the same curve."""

    def __init__(self, dimension: int, number: int, sample: np.ndarray):
        rng = np.random.default_rng((dimension, number))
        width = min(WIDTH, dimension)
        self.directions = np.linalg.qr(rng.normal(size=(dimension, width)))[0]
        self.shift = rng.random(width)
        self.low, high = np.quantile(sample @ self.directions, [0.001, 0.999], axis=0)
        self.span = np.maximum(high - self.low, 1e-12)

    def keys(self, points: np.ndarray) -> np.ndarray:
        unit = np.clip((points @ self.directions - self.low) / self.span, 0, 1)
        return hilbert(np.minimum((unit + self.shift) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.int64), BITS)


def matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.asarray(c.flatten()) for c in chunks] or [np.empty(0)]).reshape(-1, dimension)


def nearest(query: np.ndarray, rows: np.ndarray, squares: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows and their distances; equal distances go by ``firsts``.  squares: |row|^2.

    A product picks all rows that can be among them, whatever its rounding; differences then decide.
    """
    own = float(query @ query)
    rough = squares - 2 * (rows @ query) + own
    slack = 1e-12 * len(query) * (own + float(squares.max()))
    limit = np.partition(rough, k - 1)[k - 1] if len(rows) > k else np.inf
    near = np.flatnonzero(rough <= limit + 2 * slack)
    score = np.sqrt(((rows[near] - query) ** 2).sum(axis=1))
    best = np.lexsort((firsts[near], score))[:k]
    return near[best], score[best]


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v (array of double) of the vectors that take part."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).where(finite & some).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))


def classes_of(vectors: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Classes of equal vectors (row, dimension, v, ids: the k + 1 smallest) and the queries' (row, vec_id)."""
    every = vectors.select("vec_id", "v", F.lit(False).alias("asks")).unionByName(queries.select("vec_id", "v", F.lit(True).alias("asks")))
    every = stage(every.groupBy("v", "vec_id").agg(F.max("asks").alias("asks"), F.min("asks").alias("only")), "vectors")
    place = F.row_number().over(Window.partitionBy("v").orderBy("only", "vec_id"))
    least = every.withColumn("place", place).where(F.col("place") <= k + 1)
    listed = least.groupBy("v").agg(F.array_sort(F.collect_list(F.when(~F.col("only"), F.col("vec_id")))).alias("ids"))  # k + 1 at most
    classes = stage(listed.select(F.monotonically_increasing_id().alias("row"), F.size("v").alias("dimension"), "v", "ids"), "classes")
    asked = every.where("asks").select("v", "vec_id").join(classes.select("v", "row"), "v").select("row", "vec_id")
    return classes, stage(asked, "asked")


def sampled(rows: DataFrame, components: int, most: int) -> list:
    """Rows (dimension, v, ...) with about ``most`` components in all."""
    rate = min(1.0, most / max(1, components))
    return rows.where(id_hash("row", F.lit(11)) < float(1 << 31) * rate).collect()


def placed_on(classes: DataFrame, curves: dict[int, list[Curve]]) -> DataFrame:
    """Rows on every curve with their rank: grp (dimension:curve), row, v, ids, dimension, pos, n; unsampled lengths have one order by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dimension = batch["dimension"].to_numpy()
            for d in np.unique(dimension).tolist():
                part = batch.filter(pa.array(dimension == d))
                points = matrix(part["v"], d)
                for number, keys in enumerate([c.keys(points) for c in curves[d]] if d in curves else [np.zeros(len(points), np.int64)]):
                    names = pa.array([f"{d}:{number}"] * part.num_rows)
                    yield pa.RecordBatch.from_arrays([names, part["dimension"], pa.array(keys), part["row"], part["v"], part["ids"]], names=["grp", "dimension", "key", "row", "v", "ids"])

    each = classes.select("dimension", "row", "v", "ids").mapInArrow(run, "grp string, dimension int, key long, row long, v array<double>, ids array<long>")
    return stage(positions(each, "grp", ["key", "row"], "ordered"), "placed")


def probed(classes: DataFrame, probes: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """The exact k nearest classes of each probe but itself, by a scan: asked, row.  probes: rows and vectors by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int, int]]] = {}
        for batch in batches:
            dimension = batch["dimension"].to_numpy()
            for d in np.unique(dimension).tolist():
                if d not in probes:
                    continue
                part = batch.filter(pa.array(dimension == d))
                rows, points, firsts = part["row"].to_numpy(), matrix(part["v"], d), pc.list_element(part["ids"], 0).to_numpy()
                squares = (points**2).sum(axis=1)
                for own, query in zip(*probes[d], strict=True):
                    others = rows != own
                    if others.any():
                        at, score = nearest(query, points[others], squares[others], firsts[others], k)
                        best[own] = sorted([*best.get(own, []), *zip(score.tolist(), firsts[others][at].tolist(), rows[others][at].tolist(), strict=True)])[:k]
        flat = [(own, *x) for own, found in best.items() for x in found]
        yield pa.RecordBatch.from_pydict({"asked": pa.array([x[0] for x in flat], pa.int64()), "score": pa.array([x[1] for x in flat], pa.float64()), "first": pa.array([x[2] for x in flat], pa.int64()), "row": pa.array([x[3] for x in flat], pa.int64())})

    found = classes.where(F.size("ids") > 0).select("dimension", "row", "v", "ids").mapInArrow(run, "asked long, score double, first long, row long")
    place = F.row_number().over(Window.partitionBy("asked").orderBy("score", "first"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("asked", "row")


def windows_of(classes: DataFrame, placed: DataFrame, probes: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> dict[int, int]:
    """By dimension, the rank distance on the nearest curve that holds TARGET of the probes' neighbours."""
    if not probes:
        return {}
    pairs = stage(probed(classes, probes, k), "probed")  # k rows a probe
    ends = pairs.select("row").union(pairs.select("asked")).distinct()
    ranks = stage(placed.select("grp", "dimension", "row", "pos").join(F.broadcast(ends), "row"), "ranks")
    mine = ranks.select("grp", "dimension", F.col("row").alias("asked"), F.col("pos").alias("own"))
    gaps = pairs.join(ranks.select("grp", "row", "pos"), "row").join(mine, ["grp", "asked"]).groupBy("dimension", "asked", "row").agg(F.min(F.abs(F.col("pos") - F.col("own"))).alias("gap"))
    by_dimension: dict[int, list[int]] = {}
    for r in gaps.select("dimension", "gap").collect():
        by_dimension.setdefault(r["dimension"], []).append(r["gap"])
    return {d: int(np.ceil(np.quantile(g, TARGET))) for d, g in by_dimension.items()}


def meet(k: int):
    def run(group: pa.Table) -> pa.Table:
        """The rows of a block and the queries that meet it to each query's k nearest rows."""
        dimension = group["dimension"][0].as_py()
        asks, own = group.filter(group["asks"]), group.filter(pc.invert(group["asks"]))
        asked, at, scores = [], [np.empty(0, np.int64)], [np.empty(0)]
        if asks.num_rows and own.num_rows:
            rows, queries, names = matrix(own["v"], dimension), matrix(asks["v"], dimension), asks["row"].to_pylist()
            firsts, squares = pc.list_element(own["ids"].combine_chunks(), 0).to_numpy(), (rows**2).sum(axis=1)
            for name, query in zip(names, queries, strict=True):
                near, score = nearest(query, rows, squares, firsts, k)
                asked += [name] * len(near)
                at.append(near)
                scores.append(score)
        found = own.take(pa.array(np.concatenate(at)))
        return pa.table({"asked": pa.array(asked, pa.int64()), "row": found["row"], "ids": found["ids"], "score": np.concatenate(scores)})

    return run


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found; vectors and queries are (vec_id, v) as of usable()."""
    spark = vectors.sparkSession
    ship(spark)
    classes, asked = classes_of(vectors, queries, k)
    components = classes.agg(F.sum("dimension")).first()[0] or 0
    sample: dict[int, list] = {}
    for r in sampled(classes.select("row", "dimension", "v"), components, SAMPLE):
        sample.setdefault(r["dimension"], []).append(r["v"])
    curves = {d: [Curve(d, number, np.array(v)) for number in range(CURVES)] for d, v in sample.items()}
    placed = placed_on(classes, curves)
    starts = asked.select("row").distinct()
    wanted = classes.select("row", "dimension", "v").join(starts, "row")
    total, own = wanted.agg(F.count("*"), F.sum("dimension")).first()
    probes: dict[int, list] = {}
    for r in sampled(wanted, own or 0, min(SAMPLE, PROBES * (own or 0) // max(1, total))):
        if r["dimension"] in curves:
            probes.setdefault(r["dimension"], []).append((r["row"], r["v"]))
    found = windows_of(classes, placed, {d: (np.array([r for r, _ in x]), np.array([v for _, v in x])) for d, x in probes.items()}, k)
    widths = spark.createDataFrame(sorted(found.items()), "dimension int, width long")  # PROBES rows at most
    asks = placed.join(starts, "row").join(F.broadcast(widths), "dimension", "left")
    first = F.greatest(F.col("pos") - F.coalesce("width", "n"), F.lit(0))
    last = F.least(F.col("pos") + F.coalesce("width", "n"), F.col("n") - 1)
    met = stage(asks.select("grp", "dimension", "row", "v", F.explode(F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK))).alias("block")), "asks")
    parts = met.groupBy("grp", "block").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts"))
    sent = met.join(parts, ["grp", "block"]).withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int"))
    held = placed.where(F.size("ids") > 0).withColumn("block", F.floor(F.col("pos") / BLOCK)).join(parts, ["grp", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["grp", "block", "part", "dimension", "row", "v", "ids", "asks"]
    both = held.withColumn("asks", F.lit(False)).select(columns).unionByName(sent.withColumn("asks", F.lit(True)).withColumn("ids", F.array().cast("array<long>")).select(columns))
    hits = both.groupBy("grp", "block", "part").applyInArrow(meet(k + 2), HIT)
    return ranked(hits, asked, k)


def ranked(hits: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Hits of all blocks and curves to each query's k nearest ids: of every class the k + 2 nearest classes, then their ids."""
    place = F.row_number().over(Window.partitionBy("asked").orderBy("score", F.col("ids")[0]))
    once = hits.groupBy("asked", "row").agg(F.min("score").alias("score"), F.min("ids").alias("ids"))
    near = once.withColumn("place", place).where(F.col("place") <= k + 2)
    pairs = F.transform("ids", lambda i: F.struct(F.col("score").alias("score"), i.alias("vec_id")))
    listed = near.groupBy("asked").agg(F.array_sort(F.flatten(F.collect_list(pairs))).alias("found"))  # (k + 1) * (k + 2) at most
    own = asked.join(listed, F.col("row") == F.col("asked")).select(F.col("vec_id").alias("query_id"), "found")
    kept = F.slice(F.filter("found", lambda c: c["vec_id"] != F.col("query_id")), 1, k)
    each = own.select("query_id", F.posexplode(kept).alias("at", "hit"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 10 nearest found for every vec_id divisible by 100."""
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return neighbours(vectors, vectors.where("vec_id % 100 = 0"))
