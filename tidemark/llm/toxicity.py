"""Toxicity by cumulative-link ordinal regression on sparse text features.

A document's features are its distinct words and the 4- and 5-letter pieces of its words, with
word ends marked.  Of all features of the labelled rows the FEATURES with the largest gain
(log-likelihood ratio against the grades) are kept.  One weight vector is shared by all ordered
thresholds: P(grade > j) = sigmoid(w . x - t_j) with t_0 <= t_1 <= ...; the expected severity is
the sum over j of P(grade > j).  Weights are kept at zero or more and only features that raise the
mean grade are candidates, so much harmless text can't outweigh an insult.

Grades come from the labels and the text: 0 is not toxic, and toxic texts are 1, or 2 when they hold
more different marked words than half of the toxic texts that hold any.  A word is marked when its
gain for toxic against not toxic is large enough for a feature.  So the grade rises with what makes
a text toxic, and the first threshold is toxic alone; quality takes no part.

Defined results: null and empty texts have no features and get the base rate, and are never
toxic; without labelled rows every severity is 0; of equally likely grades the lowest is given.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import id_hash, stage, table
from tidemark.session import ship

#: The model is fitted on at most about so many labelled rows, on the best so many features.
LABELLED_ROWS, FEATURES = 20_000, 1_000
#: ... with at least this gain, so that none of some million candidates gets in by chance.
LEAST_GAIN = 12
CACHED_WORDS, ROUNDS, RIDGE = 200_000, 400, 2e-4
#: Longer words are read like others, but their features aren't kept for the next text.
CACHED_CHARS = 40
WORD = re.compile(r"[^\W\d_]+")
COUNTS = "feature string, grade int, n long"


def features_of(word: str) -> set[str]:
    marked = f"^{word}$"
    return {marked} | {marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1)}


def words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def whole_word(word: str) -> set[str]:
    return {f"^{word}$"}


def count_features(batches: Iterator[pa.RecordBatch], of: Callable[[str], set[str]] = features_of) -> Iterator[pa.RecordBatch]:
    """(text, grade) rows to partial document counts of (feature, grade)."""
    cache: dict[str, set[str]] = {}
    counts: dict[int, defaultdict[str, int]] = {}

    def flush() -> pa.RecordBatch:
        rows = [(f, g, n) for g, c in counts.items() for f, n in c.items()]
        counts.clear()
        return pa.RecordBatch.from_pydict({"feature": pa.array([r[0] for r in rows], pa.string()), "grade": pa.array([r[1] for r in rows], pa.int32()), "n": pa.array([r[2] for r in rows], pa.int64())})

    for batch in batches:
        for text, grade in zip(batch["text"].to_pylist(), batch["grade"].to_pylist(), strict=True):
            if len(cache) > CACHED_WORDS // 4:
                cache.clear()
            found: set[str] = set()
            for w in words(text):
                if len(w) > CACHED_CHARS:
                    found |= of(w)
                    continue
                if w not in cache:
                    cache[w] = of(w)
                found |= cache[w]
            own = counts.setdefault(grade, defaultdict(int))
            for f in found:
                own[f] += 1
            if sum(map(len, counts.values())) > 300_000:
                yield flush()
    yield flush()


def scored(n: dict[int, int]):
    """The log-likelihood ratio of a feature's grade counts against the grades' shares."""
    total = float(sum(n.values()))
    df = sum(F.coalesce(F.col(f"g{g}"), F.lit(0)) for g in n)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    return sum((part(F.coalesce(F.col(f"g{g}"), F.lit(0)).cast("double"), df * (k / total)) + part(F.lit(float(k)) - F.coalesce(F.col(f"g{g}"), F.lit(0)), (F.lit(total) - df) * (k / total)) for g, k in n.items()), F.lit(0.0))


class OrdinalModel:
    """Shared weights and ordered thresholds; grades 0..len(thresholds)."""

    def __init__(self, features: list[str], weights: np.ndarray, thresholds: np.ndarray):
        self.index, self.weights, self.thresholds = {f: i for i, f in enumerate(features)}, weights, thresholds

    def exceed(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) for every row and threshold."""
        return 1 / (1 + np.exp(-np.clip(np.asarray(scores)[:, None] - self.thresholds, -40, 40)))


def thresholds_of(theta: np.ndarray, top: int) -> np.ndarray:
    """The ordered thresholds: the first, and the gaps' logs, at the parameters' end."""
    own = theta[len(theta) - top :]
    return np.cumsum(np.concatenate([own[:1], np.exp(own[1:])]))


def likelihood(theta: np.ndarray, flat: np.ndarray, owner: np.ndarray, grade: np.ndarray, top: int) -> tuple[float, np.ndarray]:
    """The mean log-likelihood of the grades less the ridge, and its gradient.

    theta are the weights and the thresholds' parameters; row owner[i] has feature flat[i].
    """
    m, n = len(theta) - top, len(grade)
    w, cut = theta[:m], thresholds_of(theta, top)
    score = np.bincount(owner, w[flat], minlength=n) if n else np.zeros(0)
    edge = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(score[:, None] - cut, -40, 40))), np.zeros((n, 1))], axis=1)
    at = np.arange(n)
    p = np.maximum(edge[at, grade] - edge[at, grade + 1], 1e-9)
    slope = edge * (1 - edge)
    d_score = (slope[at, grade] - slope[at, grade + 1]) / p
    d_cut = np.array([(slope[:, j + 1] / p * (np.where(grade == j, 1.0, 0.0) - np.where(grade == j + 1, 1.0, 0.0))).sum() for j in range(top)])
    size = max(1, n)
    grad = np.concatenate([np.bincount(flat, d_score[owner], minlength=m) / size - 2 * RIDGE * w, np.zeros(top)])
    grad[m] = d_cut.sum() / size
    for j in range(1, top):
        grad[m + j] = d_cut[j:].sum() / size * np.exp(theta[m + j])
    return float(np.log(p).sum() / size - RIDGE * (w * w).sum()), grad


def fit(features: list[str], rows: list[tuple[list[int], int]], top: int) -> OrdinalModel:
    """Maximum likelihood with a ridge, by Adam on all rows; thresholds stay ordered by their gaps' logs.

    A grade without a row gets half a row's share, so that its threshold stays finite.
    """
    flat = np.array([i for r, _ in rows for i in r], np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r, _ in rows])
    grade = np.array([g for _, g in rows], np.int64)
    above = [(float((grade > j).sum()) + 0.5 * (top - j) / top) / (len(rows) + 1.0) for j in range(top)]
    start = np.array([np.log((1 - a) / a) for a in above])
    gaps = np.log(np.maximum(np.diff(start), 1e-3))
    theta = np.concatenate([np.zeros(len(features)), start[:1], gaps])
    seen = [bool((grade > j).any()) for j in range(top)]
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        _, grad = likelihood(theta, flat, owner, grade, top)
        for j in range(top):
            if not seen[j]:
                grad[len(features) + j] = 0
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta += 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        theta[: len(features)] = np.maximum(theta[: len(features)], 0)
    return OrdinalModel(features, theta[: len(features)], thresholds_of(theta, top))


def sampled(labelled: DataFrame, top: int) -> DataFrame:
    """At most about LABELLED_ROWS of the rows with a text and a grade 0..top; equal ones once."""
    known = labelled.where(F.col("text").isNotNull() & F.col("grade").between(0, top))
    rate = min(1.0, LABELLED_ROWS / max(1, known.count()))
    return known.where(id_hash("doc_id") < float(1 << 31) * rate).select("doc_id", "text", F.col("grade").cast("int").alias("grade"), F.xxhash64("text").alias("same")).dropDuplicates(["same", "grade"])


def raising(sample: DataFrame, n: dict[int, int], of: Callable[[str], set[str]] = features_of) -> list[str]:
    """The at most FEATURES features of largest gain among those that raise the mean grade."""
    counts = sample.select("text", "grade").mapInArrow(lambda batches: count_features(batches, of), COUNTS)
    wide = counts.groupBy("feature").agg(*[F.sum(F.when(F.col("grade") == g, F.col("n"))).alias(f"g{g}") for g in n])
    count = {g: F.coalesce(F.col(f"g{g}"), F.lit(0)) for g in n}
    raises = sum(g * c for g, c in count.items()) * float(sum(n.values())) > sum(count.values()) * float(sum(g * k for g, k in n.items()))
    best = wide.where(raises).withColumn("gain", scored(n)).where(F.col("gain") > LEAST_GAIN).orderBy(F.desc("gain"), "feature").limit(FEATURES)
    return [r["feature"] for r in best.collect()] if len(n) > 1 else []


def train(labelled: DataFrame, top: int = 2) -> OrdinalModel:
    """labelled: (doc_id, text, grade) with grades 0..top; nulls take no part."""
    ship(labelled.sparkSession)
    sample = sampled(labelled, top)
    n = {r["grade"]: r["count"] for r in sample.groupBy("grade").count().collect()}
    if not n:
        return OrdinalModel([], np.zeros(0), np.full(top, 40.0))
    features = sorted(raising(sample, n))
    index = {f: i for i, f in enumerate(features)}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            out = [sorted(found(t, cache, index)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "grade": batch["grade"], "x": pa.array(out, pa.list_(pa.int32()))})

    rows = sample.mapInArrow(sparse, "doc_id long, grade int, x array<int>").collect()
    rows = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["grade"], r["x"]) for r in rows)
    return fit(features, [(x, g) for _, g, x in rows], top)


def found(text: str | None, cache: dict[str, tuple[int, ...]], index: dict[str, int]) -> set[int]:
    """The numbers of the text's features that the model has."""
    if len(cache) > CACHED_WORDS:
        cache.clear()
    out: set[int] = set()
    for w in words(text):
        own = cache.get(w)
        if own is None:
            own = tuple(index[f] for f in features_of(w) if f in index)
            if len(w) <= CACHED_CHARS:
                cache[w] = own
        if own:
            out.update(own)
    return out


def predictor(spark: SparkSession, model: OrdinalModel):
    """A column function: text to struct(grade, expected_severity, p_toxic)."""
    shared = spark.sparkContext.broadcast((model.index, model.weights, model.thresholds))

    @F.arrow_udf("grade long, expected_severity double, p_toxic double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index, weights, thresholds = shared.value
        cache: dict[str, tuple[int, ...]] = {}
        for texts in batches:
            scores = [float(weights[sorted(f)].sum()) if (f := found(t, cache, index)) else 0.0 for lo in range(0, len(texts), 256) for t in texts.slice(lo, 256).to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(np.array(scores)[:, None] - thresholds, -40, 40)))
            share = -np.diff(np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1), axis=1)
            yield pa.StructArray.from_arrays([pa.array(share.argmax(axis=1)), pa.array(p.sum(axis=1)), pa.array(p[:, 0])], names=["grade", "expected_severity", "p_toxic"])

    return predict.asNondeterministic()


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A sample of the labelled rows with their severity: 0 not toxic, 1 toxic, 2 toxic with many marked words."""
    ship(docs.sparkSession)
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("grade"))
    sample = stage(sampled(docs.select("doc_id", "text").join(known, "doc_id"), 1), "labelled")
    n = {r["grade"]: r["count"] for r in sample.groupBy("grade").count().collect()}
    marked = set(raising(sample, n, whole_word))

    def count_marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [len({w for x in words(t) for w in whole_word(x)} & marked) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "text": batch["text"], "grade": batch["grade"], "marked": pa.array(held, pa.int32())})

    counted = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "grade").mapInArrow(count_marked, "doc_id long, text string, grade int, marked int")
    usual = counted.where("grade > 0 and marked > 0").agg(F.percentile_approx("marked", 0.5)).first()[0]
    return counted.select("doc_id", "text", (F.col("grade") + F.when((F.col("grade") > 0) & (F.col("marked") > (usual or 0)), 1).otherwise(0)).alias("grade"))


def model_for(spark: SparkSession, sf_dir: str) -> OrdinalModel:
    return train(graded(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, grade (the likeliest), expected_severity, p_toxic, toxic for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    predict = predictor(spark, model_for(spark, sf_dir))
    out = docs.select("doc_id", predict("text").alias("p")).select("doc_id", "p.*")
    return out.withColumn("toxic", F.col("p_toxic") > 0.5)


def drop_toxic(docs: DataFrame, model: OrdinalModel, most: float = 0.5) -> DataFrame:
    """Pipeline stage: documents with P(grade > 0) over ``most`` go."""
    out = docs.withColumn("__tm_toxic", predictor(docs.sparkSession, model)("text"))
    return out.where(F.col("__tm_toxic.p_toxic") <= most).select(docs.columns)
