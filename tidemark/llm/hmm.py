"""Hidden Markov language model with exact sequence likelihoods.

Tokens are a text's lower-cased words and one end.  Latent states emit classes of tokens: each of
the FREQUENT commonest training words is a class, the other words share classes by a hash of their
last two bytes, the end has a class and so have words that training didn't meet.  Within a class a
word has its smoothed share of the class's training count, so a state's probability of a word is
P(class | state) * P(word | class).

The unknown word has the share of training tokens that occur once (Good and Turing's estimate), in
every state; as in the base formula it is one token, whatever its letters.

Word counts come from all training texts.  Scan tasks write blocks: the token numbers of some
texts and the block's distinct words with their training counts; the counts of a word are added
up over blocks and go back by a join to the blocks that hold it, so no task needs the whole vocabulary.
Baum-Welch runs on the classes of all whole training texts: every task returns expected counts, Spark
adds them up over partitions, and only the model's own size (STATES x classes) reaches the driver.
The scaled forward recursion gives the exact log-likelihood of every whole text.

Defined results: a null or empty text is the end token alone; without training rows N = V = 0 and
every token has probability 1 under the base formula's limits, and 1 / classes under the model;
rows that repeat a doc_id are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, stage, table
from tidemark.session import ship

STATES, FREQUENT, SUFFIXES, ITERATIONS, SEED, SMOOTHING = 8, 1023, 1024, 3, 11, 0.1
#: Tokens of a block, about, and of a batch of forward recursions.
BLOCK_TOKENS, BATCH_TOKENS = 2_500_000, 1_200_000
#: A word is never white space alone, so this stands for the end.
END = b"\n"
#: Class numbers: frequent words from 0, suffixes from FREQUENT, then the end and the unknown word.
END_CLASS, UNKNOWN_CLASS, CLASSES = FREQUENT + SUFFIXES, FREQUENT + SUFFIXES + 1, FREQUENT + SUFFIXES + 2

BLOCKS = "block long, doc_id long, held_out boolean, tokens array<int>, word binary, number int, n long"
ENCODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inside double, classes array<short>"


def write_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, held_out) to BLOCKS: rows of texts as word numbers, and rows of words with training counts.

    Block numbers differ between tasks; the result has to be written once and read from there.
    """
    task, done = TaskContext.get(), 0
    partition = task.partitionId() if task else 0
    parts: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal parts, size, done
        block = (partition << 32) + done
        done += 1
        ids, held_out = (pa.concat_arrays([p[i] for p in parts]) for i in (0, 1))
        lengths = np.concatenate([p[2] for p in parts])
        coded = pa.concat_arrays([p[3] for p in parts]).dictionary_encode()
        words = pa.concat_arrays([coded.dictionary, pa.array([END], pa.binary())])
        k, w = len(ids), len(words)
        flat = np.insert(np.asarray(coded.indices), np.cumsum(lengths), w - 1)
        train = np.repeat(~np.asarray(held_out), lengths + 1)
        offsets = np.concatenate([[0], np.cumsum(lengths + 1)]).astype(np.int32)
        tokens = pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(k + w, block, np.int64)),
                pa.concat_arrays([ids, pa.nulls(w, pa.int64())]),
                pa.concat_arrays([held_out, pa.nulls(w, pa.bool_())]),
                pa.concat_arrays([tokens, pa.nulls(w, tokens.type)]),
                pa.concat_arrays([pa.nulls(k, pa.binary()), words]),
                pa.concat_arrays([pa.nulls(k, pa.int32()), pa.array(np.arange(w, dtype=np.int32))]),
                pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(np.bincount(flat[train], minlength=w))]),
            ],
            names=["block", "doc_id", "held_out", "tokens", "word", "number", "n"],
        )
        parts, size = [], 0
        return out

    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            lengths, words = split_words(part["text"])
            parts.append((part["doc_id"], part["held_out"], lengths, words))
            size += len(words) + part.num_rows
            if size > BLOCK_TOKENS:
                yield flush()
    if parts:
        yield flush()


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Every text's number of words, and all their words one after another as binary."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = cut.flatten()
    real = np.asarray(pc.binary_length(flat)) > 0  # white space at either end leaves an empty piece
    ends = np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(cut)))])]
    return np.diff(ends), flat.filter(pa.array(real)).cast(pa.binary())


def encode(words: pa.Table, texts: pa.Table, total: int, distinct: int) -> pa.Table:
    """A block's words (number, c, class, inside) and its texts (doc_id, held_out, tokens) to ENCODED."""
    texts = texts.combine_chunks()
    tokens = pa.concat_arrays(texts["tokens"].chunks) if texts.num_rows else pa.array([], pa.list_(pa.int32()))
    number = words["number"].to_numpy()
    c, classes, inside = (np.empty(len(number), t) for t in (np.int64, np.int16, np.float64))
    for name, out in (("c", c), ("class", classes), ("inside", inside)):
        out[number] = words[name].to_numpy()
    base = np.log10((c + SMOOTHING) / (total + SMOOTHING * (distinct + 1))) if total else np.zeros(len(number))
    flat, offsets = np.asarray(tokens.flatten()), np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(tokens)))]).astype(np.int64)
    begin = offsets[:-1]
    summed = [np.add.reduceat(v[flat], begin) if len(begin) else v[:0] for v in ((c > 0).astype(np.int64), base, inside)]
    return pa.table(
        {
            "doc_id": texts["doc_id"], "held_out": texts["held_out"], "n_tokens": np.diff(offsets),
            "n_known": summed[0], "base_score": summed[1], "inside": summed[2],
            "classes": pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(classes[flat])),
        }
    )


class Hmm:
    """start (STATES), move (STATES, STATES) and emit (STATES, CLASSES), rows adding up to 1."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def initial(share: np.ndarray, states: int = STATES, seed: int = SEED) -> Hmm:
        """Class shares, disturbed differently for every state."""
        rng = np.random.default_rng(seed)
        emit = share * rng.gamma(2.0, 0.5, (states, len(share)))
        move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
        return Hmm(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))

    def forward(self, sequences: list[np.ndarray], backward: bool = False) -> tuple[np.ndarray, tuple | None]:
        """Natural log-likelihoods; with ``backward`` also the expected counts (start, move, emit), in single precision."""
        kind = np.float32 if backward else np.float64
        order = np.argsort([-len(s) for s in sequences], kind="stable")
        lengths = np.array([len(sequences[i]) for i in order])
        longest = int(lengths[0])
        active = np.searchsorted(-lengths, -np.arange(longest), "left")  # sequences longer than t
        at = np.concatenate([[0], np.cumsum(active)])
        flat = np.concatenate([sequences[i] for i in order])
        begin = np.cumsum(lengths) - lengths
        emit_t, move = np.ascontiguousarray(self.emit.T, kind), self.move.astype(kind)
        back = np.ascontiguousarray(move.T)
        scale = np.empty(at[-1], kind)
        kept = np.empty((at[-1], len(self.start)), kind) if backward else None
        where = np.empty(at[-1], np.int64)
        alpha = np.broadcast_to(self.start, (len(order), len(self.start))).astype(kind)
        for t in range(longest):
            n = active[t]
            where[at[t] : at[t + 1]] = spots = begin[:n] + t
            alpha = (alpha[:n] if t == 0 else alpha[:n] @ move) * emit_t[flat[spots]]
            s = alpha.sum(axis=1)
            alpha /= s[:, None]
            scale[at[t] : at[t + 1]] = s
            if backward:
                kept[at[t] : at[t + 1]] = alpha
        owner = np.concatenate([np.arange(n) for n in active])
        out = np.empty(len(order))
        out[order] = np.bincount(owner, np.log(scale), minlength=len(order))
        if not backward:
            return out, None
        after = np.ones_like(kept)  # scaled backward values
        moved = np.zeros_like(self.move)  # sums over all steps, in double precision
        for t in range(longest - 2, -1, -1):
            n, m = active[t], active[t + 1]
            step = slice(at[t + 1], at[t + 2])
            right = emit_t[flat[where[step]]] * after[step] / scale[step][:, None]
            after[at[t] : at[t] + m] = right @ back
            moved += kept[at[t] : at[t] + m].T @ right
        kept *= after
        classes = flat[where]
        counts = np.stack([np.bincount(classes, kept[:, k], minlength=self.emit.shape[1]) for k in range(kept.shape[1])])
        return out, (kept[: active[0]].sum(axis=0, dtype=np.float64), moved * self.move, counts)


def batches_of(rows: Iterator[pa.RecordBatch], size: int = BATCH_TOKENS) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Cut into slices of about so many tokens, with each row's classes."""
    for batch in rows:
        lengths = np.cumsum(np.asarray(pc.list_value_length(batch["classes"])))
        lo = 0
        while lo < batch.num_rows:
            done = lengths[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(lengths, done + size)))
            part = batch.slice(lo, hi - lo)
            flat = np.asarray(part["classes"].flatten())
            yield part, np.split(flat, lengths[lo : hi - 1] - done)
            lo = hi


def expect(batches: Iterator[pa.RecordBatch], model: Hmm) -> Iterator[pa.RecordBatch]:
    """Training rows to their expected counts, as rows (at, value) of one flat array."""
    total = None
    for _, sequences in batches_of(batches):
        _, counts = model.forward(sequences, backward=True)
        own = np.concatenate([c.ravel() for c in counts])
        total = own if total is None else total + own
    if total is not None:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "value"])


def with_unknown(emit: np.ndarray, unknown: float) -> np.ndarray:
    """Emission rows that add up to 1 and give the unknown word a fixed share."""
    emit = emit.copy()
    emit[:, UNKNOWN_CLASS] = 0
    emit *= (1 - unknown) / emit.sum(axis=1, keepdims=True)
    emit[:, UNKNOWN_CLASS] = unknown
    return emit


def baum_welch(encoded: DataFrame, share: np.ndarray, unknown: float, iterations: int = ITERATIONS, states: int = STATES) -> Hmm:
    """The model after so many passes over all training rows; counts are added up by Spark."""
    model = Hmm.initial(share, states)
    size = states + states * states + states * len(share)
    train = encoded.where(~F.col("held_out")).select("classes")
    for _ in range(iterations):
        rows = train.mapInArrow(lambda b, m=model: expect(b, m), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        total = np.zeros(size)
        for r in rows:  # STATES x classes at most
            total[r["at"]] = r["value"]
        start, move, emit = total[:states] + 1, total[states : states + states * states].reshape(states, states) + 1, total[states + states * states :].reshape(states, -1)
        emit = emit + share * 10  # shares of the whole corpus as a prior, so no state rules a class out
        model = Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), with_unknown(emit, unknown))
    return model


def score(batches: Iterator[pa.RecordBatch], model: Hmm) -> Iterator[pa.RecordBatch]:
    for part, sequences in batches_of(batches):
        like, _ = model.forward(sequences)
        total = pa.array(like / np.log(10) + np.asarray(part["inside"]))
        yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], part["n_tokens"], part["n_known"], part["base_score"], total], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def encode_corpus(docs: DataFrame) -> tuple[DataFrame, int, np.ndarray, float]:
    """ENCODED rows of (doc_id, text, held_out), N, the classes' shares of the training tokens, the unknown word's share."""
    blocks = stage(docs.select("doc_id", "text", "held_out").mapInArrow(write_blocks, BLOCKS), "blocks")
    words = blocks.where("word is not null").select("block", "number", "word", "n")
    counted = stage(words.groupBy("word").agg(F.sum("n").alias("c")), "words")
    known = counted.where("c > 0")
    sums = known.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("once")).first()
    total, distinct = sums["n"] or 0, sums["v"] or 0
    unknown = min(0.5, ((sums["once"] or 0) + SMOOTHING) / (total + 1))
    frequent = [(bytes(r["word"]), i) for i, r in enumerate(known.where(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(FREQUENT).collect())]
    listed = docs.sparkSession.createDataFrame(frequent, "word binary, place int")  # FREQUENT rows at most
    suffix = F.lit(FREQUENT) + (F.crc32(F.substring("word", -2, 2)) % SUFFIXES).cast("int")
    place = F.when(F.col("word") == F.lit(END), END_CLASS).when(F.col("place").isNotNull(), F.col("place")).when(F.col("c") > 0, suffix).otherwise(UNKNOWN_CLASS)
    classed = counted.join(F.broadcast(listed), "word", "left").select("word", "c", place.alias("class"))
    sizes = classed.groupBy("class").agg(F.sum("c").alias("of"), F.sum((F.col("c") > 0).cast("int")).alias("words")).collect()
    of, several = np.zeros(CLASSES), np.ones(CLASSES)
    for r in sizes:  # one row a class
        of[r["class"]], several[r["class"]] = r["of"], max(1, r["words"])
    share = of + SMOOTHING
    floor = F.array(*[F.lit(float(np.log10(of[k] + SMOOTHING * several[k]))) for k in range(FREQUENT, FREQUENT + SUFFIXES)])
    shared = F.col("class").between(FREQUENT, FREQUENT + SUFFIXES - 1)
    inside = F.when(shared, F.log10(F.col("c") + SMOOTHING) - floor[F.greatest(F.col("class") - FREQUENT, F.lit(0))]).otherwise(F.lit(0.0))
    valued = classed.select("word", "c", "class", inside.alias("inside"))
    words_in = words.select(F.col("block").alias("home"), "number", "word").join(valued, "word").drop("word")
    texts_in = blocks.where("word is null").select("block", "doc_id", "held_out", "tokens")
    met = words_in.groupBy("home").cogroup(texts_in.groupBy("block"))
    encoded = stage(met.applyInArrow(lambda words, texts: encode(words, texts, total, distinct), ENCODED), "encoded")
    return encoded, total, share / share.sum(), unknown


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for (doc_id, text, held_out); held-out rows train nothing."""
    ship(docs.sparkSession)
    encoded, total, share, unknown = encode_corpus(docs)
    model = baum_welch(encoded, share, unknown)
    scored = encoded.mapInArrow(lambda b: score(b, model), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; those whose crc32(doc_id) mod 10 is 0 are held out of training."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False))
    return score_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out")))
