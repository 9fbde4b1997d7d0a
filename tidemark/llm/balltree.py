"""Exact top-k inner-product search by ball-tree branch and bound, one tree a shard.

A bounded sample of the vectors gives a tree of splits, each along the line between two far points, whose
leaves are cells of space.  Every vector is routed to its cell; a cell is a ball around its
sample's mean, with the radius of its farthest vector, and cells of many vectors are cut into shards by hash.
A query meets cells in the order of their upper bounds q . centre + |q| * radius: first the best
one, then the FIRST_CELLS next, then all others, each round only where the bound reaches the k-th score that the
rounds before have found.  A task gets a shard and a block of queries; it builds a ball tree over
the shard and visits nodes in the order of the same bound, skipping those under a query's current k-th score.

So no pair of a query and a vector is left out but by a bound, and results are exact whatever the sample.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part;
a query meets vectors of its own dimension only; ties go to the smaller vec_id; of rows that repeat a
vec_id each counts, but none is a candidate for its own id; scores that leave 64 bits end the query with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage, table
from tidemark.session import ship

TOP, SCALE, LEAF = 10, 1024, 64
#: Vectors of a shard and queries of a block, about; the tree of a shard is built for each block.
SHARD_ROWS, QUERY_BLOCK = 8_192, 8_192
#: Cells at most, and sampled vectors for the splits.
CELLS, SAMPLE = 4_096, 40_000
#: Cells of the second round.
FIRST_CELLS = 8
ROUTED = "dimension int, cell int, vec_id long, v array<long>, far double"
FOUND = "query_id long, vec_id long, score long"


class BallTree:
    """Nodes as arrays: centre, radius, first and last row, children (-1: leaf).  Rows are integers."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        order, self.nodes = np.arange(len(rows)), []
        points = rows.astype(np.float64)
        stack = [(0, len(rows), -1)]
        while stack:
            a, b, parent = stack.pop()
            own = points[order[a:b]]
            centre = own.mean(axis=0)
            radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
            here = len(self.nodes)
            self.nodes.append([centre, radius, a, b, -1, -1])
            if parent >= 0:
                self.nodes[parent][4 if self.nodes[parent][4] < 0 else 5] = here
            if b - a > LEAF and radius > 0:
                far = own[((own - centre) ** 2).sum(axis=1).argmax()]
                other = own[((own - far) ** 2).sum(axis=1).argmax()]
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own @ (other - far), middle)]
                stack += [(a + middle, b, here), (a, a + middle, here)]
        self.rows, self.ids = rows[order], ids[order]

    def search(self, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int = TOP) -> tuple[np.ndarray, np.ndarray]:
        """(queries, k) ids and scores, best first; ids of -1 where fewer are found.

        Queries go down the tree together: a node is opened for those whose bound reaches their
        k-th score, and of two children the one with the larger mean bound comes first.
        """
        n, least = len(queries), np.iinfo(np.int64).min
        best_ids, best = np.full((n, k), -1, np.int64), np.full((n, k), least, np.int64)
        kth = floor.copy()
        q = queries.astype(np.float64)
        length = np.sqrt((q * q).sum(axis=1))
        slack = 1e-9 * (length * max(1.0, max(np.abs(c[0]).max() + c[1] for c in self.nodes)) * q.shape[1]) + 1e-6

        def bound(node: int, who: np.ndarray) -> np.ndarray:
            return q[who] @ self.nodes[node][0] + length[who] * self.nodes[node][1] + slack[who]

        everyone = np.arange(n)
        stack = [(0, everyone, bound(0, everyone))]
        exact = float(np.abs(self.rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * q.shape[1] < 2**53
        while stack:
            node, who, upper = stack.pop()
            who = who[upper >= kth[who]]
            if not len(who):
                continue
            _, _, a, b, left, right = self.nodes[node]
            if left < 0:
                scores = (q[who] @ self.rows[a:b].T.astype(np.float64)).astype(np.int64) if exact else queries[who] @ self.rows[a:b].T
                scores[query_ids[who][:, None] == self.ids[a:b][None, :]] = least
                all_scores = np.concatenate([best[who], scores], axis=1)
                all_ids = np.concatenate([best_ids[who], np.broadcast_to(self.ids[a:b], scores.shape)], axis=1)
                order = np.lexsort((all_ids, -all_scores.astype(np.float64) if exact else ~all_scores), axis=1)[:, :k]
                best[who], best_ids[who] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)
                kth[who] = np.maximum(kth[who], best[who, k - 1])
            else:
                up_left, up_right = bound(left, who), bound(right, who)
                pair = [(left, who, up_left), (right, who, up_right)]
                stack += pair if up_left.mean() < up_right.mean() else pair[::-1]
        best_ids[best == least] = -1
        return best_ids, best


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component as long, for the vectors that take part."""
    v = F.col(embedding).cast("array<double>")
    good = F.size(v) > 0
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).where(good & finite).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def matrix(column: pa.ChunkedArray, dimension: int) -> np.ndarray:
    return np.concatenate([np.asarray(c.flatten()) for c in column.chunks] or [np.empty(0, np.int64)]).reshape(-1, dimension)


class Cells:
    """Splits of the space of one dimension: inner nodes have a direction, a threshold and two children, leaves a cell."""

    def __init__(self, points: np.ndarray, cells: int):
        self.nodes: list[tuple] = []
        self.centres: list[np.ndarray] = []
        stack = [(points.astype(np.float64), cells, -1)]
        while stack:
            own, n, parent = stack.pop()
            here = len(self.nodes)
            if parent >= 0:
                self.nodes[parent] = (*self.nodes[parent], here)
            centre = own.mean(axis=0)
            far = own[((own - centre) ** 2).sum(axis=1).argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            side = own @ (other - far)
            cut = np.median(side)
            right = side > cut
            if n < 2 or not right.any():
                self.nodes.append((None, len(self.centres)))
                self.centres.append(centre)
                continue
            self.nodes.append((other - far, cut))
            stack += [(own[right], n // 2, here), (own[~right], n - n // 2, here)]

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of every point and its distance from the cell's centre."""
        cell, stack = np.zeros(len(points), np.int32), [(0, np.arange(len(points)))]
        while stack:
            at, who = stack.pop()
            node = self.nodes[at]
            if node[0] is None:
                cell[who] = node[1]
                continue
            right = points[who] @ node[0] > node[1]
            stack += [(node[2], who[~right]), (node[3], who[right])]
        return cell, np.sqrt(((points - np.array(self.centres)[cell]) ** 2).sum(axis=1))


def search_task(key: tuple, group: pa.Table) -> pa.Table:
    """The rows of a shard and of a block of queries (with their floors) to the best of the shard."""
    dimension = key[0].as_py()
    asks, own = (group.filter(pc.equal(group["asks"], x)) for x in (True, False))
    ids, scores, names = np.empty((0, TOP), np.int64), np.empty((0, TOP), np.int64), np.empty(0, np.int64)
    if asks.num_rows and own.num_rows:
        rows, queries = matrix(own["v"], dimension), matrix(asks["v"], dimension)
        if float(np.abs(rows).max()) * float(np.abs(queries).max()) * dimension >= 2.0**63:
            raise OverflowError("inner products of these vectors leave 64 bits")
        tree, names = BallTree(rows, own["vec_id"].to_numpy()), asks["vec_id"].to_numpy()
        ids, scores = tree.search(queries, names, asks["floor"].to_numpy())
    keep = (ids >= -(1 << 62)) & (scores > np.iinfo(np.int64).min)
    return pa.table({"query_id": np.repeat(names, TOP)[keep.ravel()], "vec_id": ids[keep], "score": scores[keep]})


def split_cells(rows: DataFrame, total: int) -> dict[int, Cells]:
    """Per dimension its cells, from at most about SAMPLE vectors."""
    rate = min(1.0, SAMPLE / max(1, total))
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(1 << 31)) < float(1 << 31) * rate).select("dimension", "v")
    found: dict[int, list] = {}
    for r in sample.collect():
        found.setdefault(r["dimension"], []).append(r["v"])
    cells = min(CELLS, -(-total // SHARD_ROWS))
    return {d: Cells(np.array(v), max(1, cells * len(v) // sum(map(len, found.values())))) for d, v in found.items()}


def routed(rows: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """(dimension, vec_id, v) to ROUTED; dimensions that the sample missed are one cell around 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dimension = batch["dimension"].to_numpy()
            for d in np.unique(dimension).tolist():
                part = batch.filter(pa.array(dimension == d))
                points = np.asarray(part["v"].flatten()).reshape(-1, d).astype(np.float64)
                cell, far = cells[d].route(points) if d in cells else (np.zeros(len(points), np.int32), np.sqrt((points**2).sum(axis=1)))
                yield pa.RecordBatch.from_arrays([part["dimension"], pa.array(cell), part["vec_id"], part["v"], pa.array(far)], names=["dimension", "cell", "vec_id", "v", "far"])

    return rows.select("dimension", "vec_id", "v").mapInArrow(run, ROUTED)


def bounds(queries: DataFrame, balls: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """Adds cells: of each query's dimension (cell, bound), the largest bound first; balls are (cells, centres, radii)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("cell", pa.int32()), ("bound", pa.float64())]))
        for whole in batches:
            for batch in (whole.slice(lo, 256) for lo in range(0, whole.num_rows, 256)):
                listed = []
                for d, v in zip(batch["dimension"].to_pylist(), batch["v"].to_pylist(), strict=True):
                    if d not in balls:
                        listed.append([])
                        continue
                    names, centres, radii = balls[d]
                    q = np.array(v, np.float64)
                    length = float(np.sqrt(q @ q))
                    upper = centres @ q + length * radii
                    upper += 1e-9 * length * (np.abs(centres).max() + radii) * d + 1e-6
                    order = np.argsort(-upper, kind="stable")
                    listed.append([{"cell": int(names[i]), "bound": float(upper[i])} for i in order])
                yield pa.RecordBatch.from_arrays([batch["dimension"], batch["vec_id"], batch["v"], pa.array(listed, kind)], names=["dimension", "vec_id", "v", "cells"])

    return queries.select("dimension", "vec_id", "v").mapInArrow(run, "dimension int, vec_id long, v array<long>, cells array<struct<cell:int,bound:double>>")


def best_of(found: DataFrame) -> DataFrame:
    """The TOP best rows of every query with their rank; the limit is taken before the shuffle and after it."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= TOP)


def top_k(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: vectors and queries are (vec_id, v) as of quantised()."""
    spark = vectors.sparkSession
    ship(spark)
    least = F.lit(-(1 << 63)).cast("long")
    rows = stage(vectors.withColumn("dimension", F.size("v")), "vectors")
    total = rows.count()
    cells = split_cells(rows, total)
    own = stage(routed(rows, cells), "routed")
    sizes = own.groupBy("dimension", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # CELLS a dimension at most
    balls: dict[int, tuple] = {}
    for d in {r["dimension"] for r in sizes}:
        mine = sorted((r["cell"], r["radius"]) for r in sizes if r["dimension"] == d)
        centres = np.array(cells[d].centres) if d in cells else np.zeros((1, d))
        names = np.array([c for c, _ in mine])
        balls[d] = (names, centres[names], np.array([x for _, x in mine]))
    shards = spark.createDataFrame([(r["dimension"], r["cell"], -(-r["n"] // SHARD_ROWS)) for r in sizes], "dimension int, cell int, shards int")
    asked = stage(bounds(queries.withColumn("dimension", F.size("v")), balls), "queries")
    found, kth = None, None
    columns = ["dimension", "cell", "shard", "block", "vec_id", "v", "asks", "floor"]
    for first, last in ((0, 1), (1, 1 + FIRST_CELLS), (1 + FIRST_CELLS, CELLS)):
        if last > 1 and max((len(b[0]) for b in balls.values()), default=0) <= first:
            break
        asks = asked.select("dimension", "vec_id", "v", F.slice("cells", first + 1, last - first).alias("cells"))
        if kth is not None:  # cells that can't reach the k-th score go before the query is copied
            asks = asks.join(kth, F.col("vec_id") == F.col("query_id"), "left").withColumn("cells", F.filter("cells", lambda c: F.col("floor").isNull() | (c["bound"] >= F.col("floor"))))
        asks = asks.withColumn("c", F.explode("cells")).drop("cells").select("*", "c.cell")
        asks = stage(asks.select("dimension", "cell", "vec_id", "v", F.coalesce("floor", least).alias("floor") if kth is not None else least.alias("floor")), "asks")
        met = asks.groupBy("dimension", "cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks")).join(F.broadcast(shards), ["dimension", "cell"])
        each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        copies = own.join(F.broadcast(met), ["dimension", "cell"]).withColumn("shard", F.pmod(F.xxhash64("vec_id"), "shards").cast("int")).select("*", each)
        sent = asks.join(F.broadcast(met), ["dimension", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(5)), "blocks").cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
        both = copies.withColumns({"asks": F.lit(False), "floor": least}).select(columns).unionByName(sent.withColumn("asks", F.lit(True)).select(columns))
        hits = both.groupBy("dimension", "cell", "shard", "block").applyInArrow(search_task, FOUND)
        found = stage(best_of(hits if found is None else hits.unionByName(found)).drop("rank"), "hits")
        kth = found.groupBy("query_id").agg(F.when(F.count("*") >= TOP, F.min("score")).alias("floor"))
    return best_of(found).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 10 best for every vec_id divisible by 100."""
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT * FROM v WHERE vec_id % 100 = 0), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
