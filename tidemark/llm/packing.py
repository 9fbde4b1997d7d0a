"""Packing of sequences into batches: optimal length buckets and a token budget.

A document's whole text is its words and one end; texts of more than MAX_TOKENS are cut into
pieces of that length and one rest.  A dynamic programme over the global length histogram (of
MAX_TOKENS entries at most) chooses the BUCKETS bucket bounds that need the least padding.  In a
bucket of bound b a batch holds floor(BUDGET / b) pieces, each padded to b.

Batches are formed over a whole bucket: its pieces are dealt out to groups by hash, the groups'
sizes are summed up in order, and a piece's place is its group's offset plus its place in the
group.  So every batch but a bucket's last is full, and no bucket meets in one task.

Defined results: a null or empty text is one piece of one token, its end; equal rows get places
of their own; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import id_hash, stage, table
from tidemark.session import ship

MAX_TOKENS, BUCKETS, BUDGET = 2048, 12, 16_384
#: Pieces of a group at least, and groups at most but for one a bucket: the table of groups is bounded.
GROUP_ROWS, GROUPS = 1_000, 20_000


def token_count(text: Column) -> Column:
    """Words (runs of characters outside space and tab to carriage return) and one end."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)) + 1


def bucket_bounds(histogram: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The increasing bounds, the longest length last, that minimise the padded tokens.

    histogram[i] counts the pieces of i tokens.
    """
    lengths = np.flatnonzero(histogram)
    if not len(lengths):
        return []
    count = np.concatenate([[0], np.cumsum(histogram[lengths])]).astype(np.float64)
    n, buckets = len(lengths), min(buckets, len(lengths))
    best = np.full((buckets + 1, n + 1), np.inf)
    best[:, 0] = 0
    cut = np.zeros((buckets + 1, n + 1), np.int64)
    for k in range(1, buckets + 1):
        for j in range(1, n + 1):
            cost = best[k - 1, :j] + (count[j] - count[:j]) * lengths[j - 1]
            cut[k, j] = cost.argmin()
            best[k, j] = cost[cut[k, j]]
    bounds, j = [], n
    for k in range(buckets, 0, -1):
        if j:
            bounds.append(int(lengths[j - 1]))
            j = int(cut[k, j])
    return bounds[::-1]


def pieces(sized: DataFrame, keys: list[str], max_tokens: int = MAX_TOKENS) -> DataFrame:
    """keys, piece, start, n_tokens for rows of (keys, n): every token is in one piece."""
    cut = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / max_tokens).cast("int") - 1))
    out = sized.select(*keys, "n", cut.alias("piece"))
    start = (F.col("piece") * max_tokens).cast("long")
    return out.select(*keys, "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(max_tokens)).cast("int").alias("n_tokens"))


def pack_lengths(sized: DataFrame, keys: list[str], max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """keys, piece, start, n_tokens, bucket (its bound), batch, slot: one row per piece of the rows of (keys, n), n at least 1."""
    ship(sized.sparkSession)
    parts = stage(pieces(sized, keys, max_tokens), "pieces")
    histogram = np.zeros(max_tokens + 1, np.int64)
    for r in parts.groupBy("n_tokens").count().collect():  # max_tokens rows at most
        histogram[r["n_tokens"]] = r["count"]
    bounds = bucket_bounds(histogram, buckets)
    if not bounds:
        return parts.select("*", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("batch"), F.lit(0).alias("slot"))
    bucket = groups = F.lit(None).cast("int")
    each = max(GROUP_ROWS, int(histogram.sum()) // GROUPS)
    for low, high in reversed(list(zip([0, *bounds], bounds, strict=False))):
        inside = F.col("n_tokens") <= high
        bucket = F.when(inside, F.lit(high)).otherwise(bucket)
        groups = F.when(inside, F.lit(-(-int(histogram[low + 1 : high + 1].sum()) // each))).otherwise(groups)
    dealt = parts.withColumn("bucket", bucket).withColumn("__group", F.pmod(id_hash(*keys, "piece"), groups).cast("int"))
    sizes = dealt.groupBy("bucket", "__group").agg(F.count("*").alias("__size"))
    before = Window.partitionBy("bucket").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "__group", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("bucket", "__group").orderBy(*keys, "piece")
    placed = dealt.withColumn("__at", F.row_number().over(inside)).join(F.broadcast(offsets), ["bucket", "__group"])
    at, holds = F.col("__offset") + F.col("__at") - 1, F.floor(F.lit(budget) / F.col("bucket"))
    holds = F.greatest(holds, F.lit(1))
    return placed.select(*keys, "piece", "start", "n_tokens", "bucket", F.floor(at / holds).cast("long").alias("batch"), (at % holds).cast("int").alias("slot"))


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, piece, start, n_tokens, bucket, batch, slot of documents, by their words."""
    return pack_lengths(docs.select("doc_id", token_count(F.col("text")).alias("n")), ["doc_id"], max_tokens, buckets, budget)


def token_batches(encoded: DataFrame, pad_id: int, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """bucket, batch, doc_ids, starts, n_tokens, input_ids: padded batches of (doc_id, ids), such as a tokenizer gives.

    Slot k of a batch is the tokens starts[k] .. starts[k] + n_tokens[k] of a document, padded with pad_id to
    the bucket's bound; a batch has at most ``budget`` tokens, or one row.  Rows without ids are in no batch; rows
    equal in id and tokens are packed once.
    """
    rows = stage(encoded.where(F.size("ids") > 0).select("doc_id", "ids").withColumn("row", F.xxhash64("doc_id", "ids")), "encoded")
    placed = pack_lengths(rows.dropDuplicates(["doc_id", "row"]).select("doc_id", "row", F.size("ids").cast("long").alias("n")), ["doc_id", "row"], max_tokens, buckets, budget)
    texts = rows.dropDuplicates(["doc_id", "row"]).select(F.col("doc_id").alias("__doc"), F.col("row").alias("__row"), "ids")
    met = placed.join(texts, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("row") == F.col("__row")))
    tokens = F.slice("ids", (F.col("start") + 1).cast("int"), "n_tokens")
    padded = F.concat(tokens, F.array_repeat(F.lit(pad_id).cast("int"), F.col("bucket") - F.col("n_tokens")))
    slots = F.array_sort(F.collect_list(F.struct("slot", "doc_id", "start", "n_tokens", padded.alias("ids"))))  # bounded by the budget
    out = met.groupBy("bucket", "batch").agg(slots.alias("s"))
    return out.select("bucket", "batch", F.col("s.doc_id").alias("doc_ids"), F.col("s.start").alias("starts"), F.col("s.n_tokens").alias("n_tokens"), F.col("s.ids").alias("input_ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, n_tokens, bucket, batch, slot for all pieces of all documents."""
    return pack(table(spark, sf_dir, "documents"))
