"""Ranked lexical search by the threshold algorithm, over shards of documents.

A pass over the texts counts the queries' terms in each document: the forward index.  Term weights and
lengths come from all documents.  Shards are dealt by row and bounded in postings; a task makes
its shard's lists, one a term, sorted by impact, and answers all queries of the block: it reads
the lists side by side, a step of rows from each at a time, looks every document that is new up in the forward index for
its whole score, and stops once the threshold, the sum of what the lists show at their
ends, falls strictly below the k-th score.  The first shard's k-th scores hold for all others from their start.

Queries go in blocks that hold about BLOCK_TERMS terms; each block is a pass over the documents, so
what a task knows of the queries is bounded, whatever their number.  One query is never cut.

Defined results: documents without text or terms are never found; documents without an id count
in the statistics and are never found; rows that repeat a doc_id are documents of their own, as are equal texts; a
query is a distinct pair of item_id and text, a null item_id is an id like any other; a query without text or terms
finds nothing; equal scores go by doc_id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, stage, table
from tidemark.session import ship

TOP = 10
#: Terms of a block of queries and postings of a shard, about.
BLOCK_TERMS, SHARD_POSTINGS = 200_000, 1_000_000
#: Rows that a step reads from each list: at first, and at most.
FIRST_STEP, LAST_STEP = 8, 512
#: Letters, digits and all bytes outside ASCII stay, lower-cased; all others part terms.
TERMS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER)


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TERMS).split() if text else []


def weight(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def item_blocks(items: DataFrame) -> DataFrame:
    """item_id, terms, block of the queries that have terms; a block has about BLOCK_TERMS terms, or one query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t))) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["item_id"], pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])

    parted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    listed = stage(parted.mapInArrow(run, "item_id long, terms array<binary>").where(F.size("terms") > 0), "items")
    blocks = 1
    while True:
        dealt = listed.withColumn("block", F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)))
        held = dealt.groupBy("block").agg(F.sum(F.size("terms")).alias("n"), F.count("*").alias("items"))
        if not held.where((F.col("n") > BLOCK_TERMS) & (F.col("items") > 1)).limit(1).count():
            return dealt
        blocks *= 2


def forward(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the text), terms (numbers of the vocabulary's terms in it) and counts, for texts that have terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for whole in batches:
            for batch in (whole.slice(lo, 256) for lo in range(0, whole.num_rows, 256)):
                lengths, terms, counts, ends = [], [], [], [0]
                for text in batch["text"]:
                    words = terms_of(text.as_py())
                    lengths.append(len(words))
                    tf = Counter(words)
                    here = known & tf.keys()
                    terms += [vocabulary[t] for t in here]
                    counts += [tf[t] for t in here]
                    ends.append(len(terms))
                at = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    return texts.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>").where("n > 0")


class Shard:
    """Lists of a shard sorted by impact, and its forward index, both as arrays over one set of postings."""

    def __init__(self, group: pa.Table, weights: np.ndarray):
        doc_ids = group["doc_id"].to_numpy()
        by_id = np.argsort(doc_ids, kind="stable")
        group, self.doc_ids = group.take(by_id), doc_ids[by_id]
        lists = group["terms"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        self.terms = np.asarray(lists.flatten())
        tf = np.asarray(group["counts"].combine_chunks().flatten())
        docs = np.repeat(np.arange(len(sizes)), sizes)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * group["m"].to_numpy()[docs]) * weights[self.terms]
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        order = np.lexsort((docs, -self.impact, self.terms))
        self.list_docs, self.list_impact = docs[order], self.impact[order]
        self.list_start = np.searchsorted(self.terms[order], np.arange(len(weights) + 1))
        self.seen = np.zeros(len(sizes), bool)
        self.wanted = np.zeros(len(weights), bool)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """The whole scores of documents for the wanted terms, from the forward index."""
        sizes = self.start[docs + 1] - self.start[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.start[docs] - ends + sizes, sizes)
        gains = np.where(self.wanted[self.terms[at]], self.impact[at], 0)
        return np.add.reduceat(gains, ends - sizes)  # a document from a list has a posting

    def search(self, terms: np.ndarray, floor: int, k: int = TOP) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores, best first; only scores of at least ``floor`` are sure to be found."""
        terms = terms[self.list_start[terms] < self.list_start[terms + 1]]
        first, last = self.list_start[terms], self.list_start[terms + 1]
        docs, scores, touched = np.empty(0, np.int64), np.empty(0, np.int64), []
        self.wanted[terms] = True
        depth, step = 0, FIRST_STEP
        while len(terms):
            at = (first[:, None] + np.arange(depth, depth + step)[None, :]).ravel()
            shown = np.unique(self.list_docs[at[at < np.repeat(last, step)]])
            new = shown[~self.seen[shown]]
            if len(new):
                self.seen[new] = True
                touched.append(new)
                docs, scores = np.concatenate([docs, new]), np.concatenate([scores, self.scores(new)])
                best = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[best], scores[best]
            depth, step = depth + step, min(2 * step, LAST_STEP)
            open_ = first + depth < last
            threshold = self.list_impact[first[open_] + depth - 1].sum()
            kth = max(floor, scores[k - 1] if len(scores) >= k else 0)
            if not open_.any() or threshold < max(kth, 1):
                break
        self.wanted[terms] = False
        for x in touched:
            self.seen[x] = False
        keep = (scores > 0) & (scores >= floor)
        return docs[keep], scores[keep]


def search_all(index: DataFrame, queries: list[np.ndarray], weights: np.ndarray, floors: np.ndarray) -> DataFrame:
    """The TOP best of each query in each shard: query (number), doc_id, score."""

    def run(group: pa.Table) -> pa.Table:
        shard = Shard(group, weights)
        numbers, ids, found = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, terms in enumerate(queries):
            docs, scores = shard.search(terms, int(floors[k]))
            numbers += [k] * len(docs)
            ids.append(shard.doc_ids[docs])
            found.append(scores)
        return pa.table({"query": pa.array(numbers, pa.int32()), "doc_id": np.concatenate(ids), "score": np.concatenate(found)})

    return index.groupBy("shard").applyInArrow(run, "query int, doc_id long, score long")


def best_of(hits: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    return hits.withColumn("rank", place).where(F.col("rank") <= TOP)


def ranked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the TOP best documents of every item."""
    spark = documents.sparkSession
    ship(spark)
    dealt, out = item_blocks(items), []
    for block in sorted(r["block"] for r in dealt.select("block").distinct().collect()):
        queries = [(r["item_id"], [bytes(t) for t in r["terms"]]) for r in dealt.where(F.col("block") == block).collect()]  # about BLOCK_TERMS terms
        vocabulary = {t: k for k, t in enumerate(sorted({t for _, terms in queries for t in terms}))}
        counted = stage(forward(documents, vocabulary).withColumn("row", F.monotonically_increasing_id()), "forward")
        total, length, postings = counted.agg(F.count("*"), F.sum("n"), F.sum(F.size("terms"))).first()
        if not postings:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for term, n in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # the block's terms
            df[term] = n
        weights = np.array([weight(int(n), total) for n in df], np.int64)
        shards = -(-postings // SHARD_POSTINGS)
        index = counted.where(F.col("doc_id").isNotNull() & (F.size("terms") > 0)).select("doc_id", "terms", "counts", F.expr(f"100 - 90 + ((90 * n * {total}L) div {length}L)").alias("m"), F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))
        asked = [np.array([vocabulary[t] for t in terms]) for _, terms in queries]
        hits = stage(search_all(index.where("shard = 0"), asked, weights, np.zeros(len(asked), np.int64)), "pilot")
        if shards > 1:
            floors = np.zeros(len(asked), np.int64)
            for query, n, least in hits.groupBy("query").agg(F.count("*"), F.min("score")).collect():  # the block's queries
                floors[query] = least if n >= TOP else 0
            hits = hits.unionByName(search_all(index.where("shard > 0"), asked, weights, floors))
        names = spark.createDataFrame([(k, item_id) for k, (item_id, _) in enumerate(queries)], "query int, item_id long")
        out.append(best_of(hits).join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in out:
        found = found.unionByName(part)
    return found


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the 10 best documents for every item of ``benchmark``."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS_SQL = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP13_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS_SQL} AS terms FROM documents),
d AS (SELECT row, doc_id, len(terms) AS n, terms FROM t WHERE len(terms) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM d),
q AS (SELECT DISTINCT item_id, text FROM benchmark),
qt AS (SELECT DISTINCT item_id, text, unnest({_TERMS_SQL}) AS term FROM q),
p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
scored AS (
  SELECT item_id, text, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // length)))) AS BIGINT) AS score
  FROM qt JOIN p USING (term) JOIN w USING (term), s WHERE doc_id IS NOT NULL GROUP BY item_id, text, row, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
