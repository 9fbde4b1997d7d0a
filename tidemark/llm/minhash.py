"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set are the distinct 5-word shingles of its lower-cased words.  Circulant MinHash
needs two permutations of the shingle space: sigma scatters the shingles, and coordinate k of
the signature is the least pi(sigma(x) - k) over the set, so all coordinates come from the one
permutation pi, circularly shifted.  BANDS bands of ROWS coordinates give candidates; a link is
confirmed on the full sets when 100 * intersection >= 75 * union.

Documents with equal sets form one class, of which one representative goes on.  A bucket's members
are candidates of its smallest id, its pivot; the connected parts of this candidate graph are
clusters.  A cluster is cut into blocks of about BLOCK documents.  A task gets a block and the
cluster's pivot, rebuilds the sets from the whole texts, and verifies all pairs by one matrix
product; it returns a spanning set of links.  Where a cluster has more blocks and documents that
aren't linked with its pivot, these are verified against all its blocks, block by block.  So a
large group of copies costs about as much as it has members, and no link is lost: every pair
that shares a bucket is verified on full sets, or lies in one component already.

At ROWS = 4 and BANDS = 32 a pair at similarity 0.75 shares no bucket with probability 5e-6.

Defined results: null and wordless texts have an empty set and link with nothing; fewer than five
words make one shingle; rows that repeat a doc_id are one document with several texts' links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, mix64, stage, table, words_of
from tidemark.operators.graph import components
from tidemark.session import ship

SHINGLE, BANDS, ROWS = 5, 32, 4
#: The least similarity is LEAST / 100.
LEAST = 75
CACHED_WORDS = 200_000
SIGNED = "doc_id long, n_shingles long, class string, bands array<long>"
#: Documents of a block, about; columns of one matrix product.
BLOCK, COLUMNS = 192, 8_192
_POWERS = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the word shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    total = np.zeros(n, np.uint64)
    for j in range(min(SHINGLE, len(h))):
        total += h[j : j + n] * _POWERS[j]
    return np.unique(mix64(total))


def _pi(x: np.ndarray) -> np.ndarray:
    """The permutation pi of 32-bit values."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def band_hashes(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets, BANDS) bucket hashes of non-empty sets that lie one after the other in ``shingles``."""
    out = np.empty((len(starts), BANDS), np.uint64)
    lo = 0
    while lo < len(starts):  # blocks that stay in the cache
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + 16_384)))
        end = starts[hi] if hi < len(starts) else len(shingles)
        sigma = (mix64(shingles[starts[lo] : end] + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
        at = starts[lo:hi] - starts[lo]
        for b in range(BANDS):
            h = np.full(hi - lo, b + 1, np.uint64)
            for k in range(b * ROWS, b * ROWS + ROWS):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(_pi(sigma - np.uint32(k)), at))
            out[lo:hi, b] = h
        lo = hi
    return out


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to SIGNED."""
    hashes = WordHashes()
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            if len(hashes) > CACHED_WORDS:
                hashes.clear()
            sets = [shingle_set(words_of(t), hashes) for t in part["text"].to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
            ends = np.cumsum(sizes)
            full = np.flatnonzero(sizes)
            bands = band_hashes(flat, (ends - sizes)[full]).view(np.int64)
            offsets = np.zeros(len(sets) + 1, np.int32)
            offsets[full + 1] = BANDS
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"].cast(pa.int64()),
                    pa.array(sizes),
                    pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets], pa.string()),
                    pa.ListArray.from_arrays(np.cumsum(offsets).astype(np.int32), pa.array(bands.ravel())),
                ],
                names=["doc_id", "n_shingles", "class", "bands"],
            )


def verified(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j), i < j, of sets that are similar enough."""
    sizes = np.array([len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(column[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    return np.nonzero(np.triu(100 * common.astype(np.int64) >= LEAST * union.astype(np.int64), 1))


def spanning(ids: list[int], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links (smallest id, other id) that join what the pairs join."""
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        a, b = root(i), root(j)
        if a != b:
            a, b = (a, b) if ids[a] <= ids[b] else (b, a)
            parent[b] = a
    return [(ids[root(i)], ids[i]) for i in range(len(ids)) if ids[root(i)] != ids[i]]


def verify_block(group: pa.Table) -> pa.Table:
    """The links among a block's documents; ids may occur more than once, with other texts."""
    hashes = WordHashes()
    rows = [(i, s) for i, t in zip(group["id"].to_pylist(), group["text"].to_pylist(), strict=True) if len(s := shingle_set(words_of(t), hashes))]
    links = spanning([i for i, _ in rows], *verified([s for _, s in rows])) if len(rows) > 1 else []
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs, which needs doc_id and text."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage(docs.mapInArrow(sign, SIGNED), "signed")
    some = signed.where("class is not null and doc_id is not null")
    classes = stage(some.groupBy("class").agg(F.min("doc_id").alias("id")), "classes")
    signs = some.join(classes, "class").where("doc_id = id").select("id", "bands").dropDuplicates(["id", "bands"])
    banded = stage(signs.select("id", F.posexplode("bands").alias("band", "hash")), "banded")
    pivots = banded.groupBy("band", "hash").agg(F.min("id").alias("a"), F.max("id").alias("top")).where("a < top").drop("top")
    # a document's pivots, BANDS at most: it is joined with the smallest, and that one with the others, which members share
    met = banded.join(pivots, ["band", "hash"]).where("a <> id").groupBy("id").agg(F.collect_set("a").alias("pivots"))
    near = met.select("id", F.array_min("pivots").alias("a"), "pivots")
    weak = components(near.select("a", F.explode(F.concat(F.array("id"), F.filter("pivots", lambda x: x > F.col("a")))).alias("b")))
    sizes = weak.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = stage(weak.join(sizes, "component").select("id", F.col("component").alias("cluster"), "blocks", F.pmod(F.xxhash64("id"), "blocks").alias("block")), "dealt")
    texts = stage(dealt.join(docs.withColumnRenamed("doc_id", "id"), "id").repartition("cluster", "block"), "members")

    def links(rows: DataFrame) -> DataFrame:
        return rows.groupBy("cluster", "block").applyInArrow(verify_block, "a long, b long")

    own = texts.select("id", "text", "cluster", "block")
    pivot = texts.where("id = cluster and blocks > 1").select("id", "text", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    first = stage(links(own.unionByName(pivot)), "links")
    found = components(first)
    # what a large cluster's blocks couldn't link with its pivot meets all blocks of the cluster
    large = texts.where("blocks > 1")
    rest = stage(large.join(found, "id", "left").where("coalesce(component, id) <> cluster").select("id", "text", "cluster", "blocks"), "rest")
    cuts = rest.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).alias("cuts"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    apart = rest.join(cuts, "cluster").withColumn("cut", F.pmod(F.xxhash64("id", F.lit(1)), "cuts")).select("id", "text", "cluster", "cut", blocks.alias("other"))
    others = large.join(cuts, "cluster").select("id", "text", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut"), F.col("block").alias("other"))
    met = apart.unionByName(others).select("id", "text", "cluster", F.struct("cut", "other").alias("block"))
    second = stage(links(met), "links")
    final = components(first.union(second)) if second.limit(1).count() else found
    names = stage(classes.join(final, "id", "left").select("class", F.coalesce("component", "id").alias("component")), "names")
    discard(classes, banded, dealt, texts, first, rest, second)  # only signed and names are read from here on
    out = signed.select("doc_id", "n_shingles", "class").join(names, "class", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def as_they_came(docs: DataFrame, came: DataFrame) -> DataFrame:
    """doc_id, text as it came, of the rows of docs that have lost lines of it or nothing; ids that ``came`` repeats aren't known."""
    once = came.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__tm_came")).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.first("__tm_came").alias("__tm_came")).where("n = 1").drop("n")
    lines = lambda c: F.split(c, "\n")
    return docs.join(once, "doc_id").where(F.size(F.array_except(lines("text"), lines("__tm_came"))) == 0).select("doc_id", F.col("__tm_came").alias("text"))


def keep_one_of_each(docs: DataFrame, came: DataFrame | None = None) -> DataFrame:
    """Pipeline stage: of each group of near duplicates the row of the smallest doc_id stays.

    With ``came``, documents as they were before lines left them, those that were near duplicates then are so still, as well as
    those that are now.  Rows are judged one by one where a doc_id is null or repeats: each of its different texts is a
    document of its own, so none goes for what another says.  Null ids come first; of rows that
    are equal in id and text one stays; rows without a word all stay, unless by what they came as.
    """
    twice = docs.groupBy(F.col("doc_id").alias("__tm_id")).agg(F.count("*").alias("__tm_n")).where("__tm_n > 1").drop("__tm_n")
    own = docs.join(twice, F.col("doc_id") == F.col("__tm_id"), "left")
    single = F.col("doc_id").isNotNull() & F.col("__tm_id").isNull()
    keyed = stage(own.withColumn("__tm_single", single).withColumn("__tm_key", F.when(single, F.col("doc_id").cast("long")).otherwise(F.xxhash64("doc_id", "text"))).drop("__tm_id"), "keyed")
    judged = near_duplicates(keyed.select(F.col("__tm_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("__tm_key"), F.col("component_id").alias("component"))
    if came is not None:
        before = near_duplicates(as_they_came(keyed.where("__tm_single").select(F.col("__tm_key").alias("doc_id"), "text"), came))
        both = judged.join(before.select(F.col("doc_id").alias("__tm_key"), F.col("component_id").alias("before")), "__tm_key", "left")
        both = stage(both, "judged")
        # a group then and a group now that share a document are one
        joined = components(both.where("before <> component").select(F.col("component").alias("a"), F.col("before").alias("b")).distinct()).select(F.col("id").alias("component"), F.col("component").alias("joined"))
        judged = both.join(joined, "component", "left").select("__tm_key", F.coalesce("joined", "component").alias("component"))
    met = judged.join(keyed.select("__tm_key", "doc_id"), "__tm_key")
    stays = met.groupBy("component").agg(F.min(F.struct("doc_id", "__tm_key"))["__tm_key"].alias("__tm_key")).select("__tm_key")
    spread = F.when(~F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False)), F.monotonically_increasing_id())
    first = Window.partitionBy("__tm_key", "__tm_spread").orderBy("__tm_key")
    left = keyed.join(stays, "__tm_key", "left_semi").withColumn("__tm_spread", spread).withColumn("__tm_row", F.row_number().over(first))
    return left.where("__tm_row = 1").select(docs.columns)
