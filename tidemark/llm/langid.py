"""Language identification by a bidirectional gated recurrent network over bytes.

The network is written and trained in numpy by backpropagation through time.  It reads the
bytes of a segment in both directions, gives every position a distribution over the learned
languages, and a document's distribution is the mean over all positions of its whole text.

A segment is a sentence or line: the bytes between two ends of sentences or lines, in which runs of
other than ASCII letters and parts of multi-byte characters are one space.  The recurrent state runs over all of a
segment, however long, and starts anew at the next, so the positions of a segment that occurs again have the
same labels and are computed once per task.  Segments of more than ``STRETCH`` bytes are read apart, in stretches that hand
their states on: from right to left for the states at the cuts, then from left to right with both directions, so that
memory holds a stretch.  Only examples that the network is trained on are cut, to ``EXAMPLE_BYTES``.

Defined results: a null text, or one without a letter, is ``und`` with score 0; rows with equal
text get equal predictions; without any labelled row that holds a segment everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, id_hash, table
from tidemark.session import ship

UNDETERMINED = "und"
#: Bytes of a segment that is read at once with the others, and of a training example at most.
STRETCH, EXAMPLE_BYTES = 1_024, 192
#: Longer ones are read this many bytes at a time, so many bytes of them side by side.
LONG_STRETCH, LONG_BYTES = 16_384, 1 << 20
#: Training takes at most so many rows of a language, and of each a window of so many characters.
ROWS_PER_LANGUAGE, WINDOW_CHARS, SEGMENTS_PER_LANGUAGE = 400, 1200, 4_000
#: Beyond so many languages each gets a smaller part, so that all are learned and the driver's sample stays bounded.
FULL_LANGUAGES = 256
HIDDEN, EPOCHS, BATCH, RATE, SEED = 8, 3, 64, 0.01, 7
#: Few examples are seen more often, so that training takes so many steps at least.
LEAST_STEPS = 150
CACHED_SEGMENTS = 200_000
#: Segments that run side by side, and their bytes, about.
POOLED, POOLED_BYTES = 2_048, 400_000
#: ASCII letters in lower case, bytes of multi-byte characters as they are, ends of sentences and lines as line ends, all else a space.
SEGMENT_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 10 if b in b".!?;:\n\r" else 32 for b in range(256))


#: Ends of sentences outside ASCII.
WIDE_ENDS = "。！？"


def lines_of(text: str) -> list[bytes]:
    for end in WIDE_ENDS:
        if end in text:
            text = text.replace(end, "\n")
    return text.encode("utf-8", "surrogatepass").translate(SEGMENT_BYTES).split(b"\n")


def segments(text: str) -> list[bytes]:
    return [b" ".join(words) for line in lines_of(text) if (words := line.split())]


def long_segments(text: str) -> list[bytes]:
    """The segments of more than STRETCH bytes."""
    return [s for line in lines_of(text) if len(line) > STRETCH and len(s := b" ".join(line.split())) > STRETCH]


def examples(text: str) -> list[bytes]:
    return [s[i : i + EXAMPLE_BYTES] for s in segments(text) for i in range(0, len(s), EXAMPLE_BYTES)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _sigmoid_of(x: np.ndarray) -> None:
    """In place, with exp, which is faster than tanh in single precision."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


class BiGru:
    """Weights: per direction ``x`` (byte table, 3 gates), ``u`` (recurrent), ``b``; ``o`` and ``c`` for the output."""

    def __init__(self, languages: list[str], seed: int = SEED, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        put = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        self.w = {f"{n}{d}": v for d in "fb" for n, v in (("x", put(256, 3 * hidden, s=0.3)), ("u", put(hidden, 3 * hidden, s=hidden**-0.5)), ("b", np.zeros(3 * hidden, np.float32)))}
        self.w |= {"o": put(2 * hidden, len(languages), s=0.2), "c": np.zeros(len(languages), np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray | None, d: str, keep: list | None = None) -> np.ndarray:
        """States at every position, (length, n, hidden); without a mask all positions count."""
        n, length = x.shape
        h, H = np.zeros((n, self.hidden), np.float32), self.hidden
        wx, u = self.w["x" + d] + self.w["b" + d], self.w["u" + d]
        out = np.empty((length, n, H), np.float32)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            a, g = wx[x[:, t]], h @ u
            zr = _sigmoid(a[:, : 2 * H] + g[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            c = np.tanh(a[:, 2 * H :] + r * g[:, 2 * H :])
            new = c + z * (h - c)
            if mask is not None:
                m = mask[:, t : t + 1]
                new = m * new + (1 - m) * h
            if keep is not None:
                keep.append((t, h, z, r, c, g[:, 2 * H :], m))
            out[t] = h = new
        return out

    def probabilities(self, x: np.ndarray, mask: np.ndarray | None = None, keep: dict | None = None) -> np.ndarray:
        """(length, n, languages) for bytes x and a 0/1 mask of (n, length)."""
        states = np.concatenate([self._run(x, mask, d, None if keep is None else keep.setdefault(d, [])) for d in "fb"], axis=2)
        logits = states @ self.w["o"] + self.w["c"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        if keep is not None:
            keep["states"] = states
        return p / p.sum(axis=2, keepdims=True)

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions and its gradient by backpropagation through time."""
        keep: dict = {}
        p, total, H = self.probabilities(x, mask, keep), mask.sum(), self.hidden
        rows = np.arange(len(y))
        m = mask.T[:, :, None]
        loss = float(-(np.log(p[:, rows, y] + 1e-9) * mask.T).sum() / total)
        d_logits = p.copy()
        d_logits[:, rows, y] -= 1
        d_logits *= m / total
        flat = d_logits.reshape(-1, d_logits.shape[2])
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        grads["o"] = keep["states"].reshape(-1, 2 * H).T @ flat
        grads["c"] = flat.sum(axis=0)
        d_states = d_logits @ self.w["o"].T
        for k, d in enumerate("fb"):
            dh, u = np.zeros((len(y), H), np.float32), self.w["u" + d]
            own = d_states[:, :, k * H : (k + 1) * H]
            for t, h, z, r, c, gc, mt in reversed(keep[d]):
                dh = dh + own[t]
                dn = dh * mt
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (h - c) * z * (1 - z)
                dr = dc * gc * r * (1 - r)
                da = np.concatenate([dz, dr, dc], axis=1)
                dg = np.concatenate([dz, dr, dc * r], axis=1)
                np.add.at(grads["x" + d], x[:, t], da)
                grads["b" + d] += da.sum(axis=0)
                grads["u" + d] += h.T @ dg
                dh = dh * (1 - mt) + dn * z + dg @ u.T
        return loss, grads

    def fit(self, examples: list[tuple[bytes, int]], epochs: int = EPOCHS, seed: int = SEED) -> BiGru:
        """Adam over segments of like length; examples are (segment, language index)."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second, step = {k: np.zeros_like(v) for k, v in self.w.items()}, 0
        for _ in range(max(epochs, -(-LEAST_STEPS * BATCH // max(1, len(examples))))):
            order = rng.permutation(len(examples))
            order = order[np.argsort([len(examples[i][0]) for i in order], kind="stable")]
            batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
            for i in rng.permutation(len(batches)):
                x, mask = padded([examples[j][0] for j in batches[i]])
                _, grads = self.gradient(x, mask, np.array([examples[j][1] for j in batches[i]]))
                step += 1
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] -= (RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def _states(self, x: np.ndarray, active: np.ndarray, d: str, h: np.ndarray) -> np.ndarray:
        """States of one or both directions over sequences that lie in columns of x (directions, length, n), the longest first.

        At step t only the first active[t] go on; a backward direction reads columns from their ends.  One row per step and
        column, for each of the directions ``d``.  They start from ``h``, which holds the last states afterwards.
        """
        H, table, u = self.hidden, np.concatenate([self.w["x" + k] + self.w["b" + k] for k in d]), np.stack([self.w["u" + k] for k in d])
        x = x + (np.arange(len(d), dtype=np.int16) * 256)[:, None, None]
        at = np.cumsum(active) - active
        out = np.empty((len(d), int(active.sum()), H), np.float32)
        for t, k in enumerate(active.tolist()):
            own = h[:, :k]
            a, g = table[x[:, t, :k]], own @ u
            zr = a[..., : 2 * H] + g[..., : 2 * H]
            _sigmoid_of(zr)
            c = zr[..., H:] * g[..., 2 * H :]
            c += a[..., 2 * H :]
            c *= 2  # tanh(x) = 2 sigmoid(2 x) - 1
            _sigmoid_of(c)
            c *= 2
            c -= 1
            own -= c
            own *= zr[..., :H]
            own += c
            out[:, at[t] : at[t] + k] = own
        return out

    def _sums(self, found: list[bytes], ends: np.ndarray) -> np.ndarray:
        """The sums of the language probabilities over the positions of segments, the longest first, from the states at both ends."""
        x, active = columns(found)
        states = self._states(x, active, "fb", ends)
        p = states[0] @ self.w["o"][: self.hidden]
        p += self.w["c"]
        # the state from the right of a position comes as many steps after the end as the position is before it
        lengths, at = np.array([len(s) for s in found]), np.cumsum(active) - active
        step = np.repeat(np.arange(len(active)), active)
        column = np.arange(len(step)) - at[step]
        p += (states[1] @ self.w["o"][self.hidden :])[at[lengths[column] - 1 - step] + column]
        if float(np.abs(self.w["o"]).sum(axis=0).max() + np.abs(self.w["c"]).max()) > 80:  # states are at most 1; else exp can't overflow
            p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= (p @ np.ones(p.shape[1], np.float32))[:, None]
        total, done = np.zeros((len(found), len(self.languages)), np.float32), 0
        for k in active.tolist():
            total[:k] += p[done : done + k]
            done += k
        return total

    def pooled(self, found: list[bytes]) -> np.ndarray:
        """For each segment of at most about a stretch the sums over its positions of the language probabilities, and their number."""
        out = np.zeros((len(found), len(self.languages) + 1), np.float32)
        lengths = np.array([len(s) for s in found])
        order = np.argsort(-lengths, kind="stable")
        lo = 0
        while lo < len(order):
            who = order[lo : lo + max(1, min(POOLED, POOLED_BYTES // int(lengths[order[lo]])))]
            lo += len(who)
            out[who, :-1] = self._sums([found[j] for j in who], np.zeros((2, len(who), self.hidden), np.float32))
        out[:, -1] = lengths
        return out

    def pooled_long(self, found: list[bytes]) -> np.ndarray:
        """The same for segments of any length, LONG_STRETCH at a time."""
        out = np.zeros((len(found), len(self.languages) + 1))
        lengths = np.array([len(s) for s in found])
        order = np.argsort(-lengths, kind="stable")
        begins = range(0, int(lengths.max(initial=0)), LONG_STRETCH)
        reach = [int((lengths > lo).sum()) for lo in begins]  # segments that have something of a stretch
        stretch = lambda lo, k: [found[j][lo : lo + LONG_STRETCH] for j in order[:k]]
        right = np.zeros((1, len(found), self.hidden), np.float32)
        cuts = {}  # states that come in from the right of a stretch
        for lo, k in reversed(list(zip(begins, reach, strict=True))):
            cuts[lo] = right[0, :k].copy()
            if lo:
                x, active = columns(stretch(lo, k))
                self._states(x[1:], active, "b", right)
        left = np.zeros((len(found), self.hidden), np.float32)
        for lo, k in zip(begins, reach, strict=True):
            ends = np.stack([left[:k], cuts.pop(lo)])
            sums = self._sums(stretch(lo, k), ends)
            left[:k] = ends[0]
            out[order[:k], :-1] += sums
        out[:, -1] = lengths
        return out


def columns(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Segments, the longest first, as columns of bytes from their starts and from their ends, and how many go on at each step."""
    lengths = np.array([len(s) for s in found])
    longest = int(lengths[0])
    x = np.stack([np.frombuffer(b"".join(s[::way].ljust(longest, b"\0") for s in found), np.uint8).reshape(len(found), longest).T for way in (1, -1)])
    return x.astype(np.int16), np.searchsorted(-lengths, -np.arange(longest), "left")


def padded(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    length = max(map(len, found))
    x = np.frombuffer(b"".join(s.ljust(length, b"\0") for s in found), np.uint8).reshape(len(found), length)
    return x, (np.arange(length) < np.array([len(s) for s in found])[:, None]).astype(np.float32)


def train(docs: DataFrame, learn_from: Column | None = None) -> BiGru | None:
    """Fit on a bounded sample of the labelled rows of every language, each taken without regard to the others.  None without labels."""
    ship(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    if learn_from is not None:
        known = known.where(learn_from)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    part = min(1.0, FULL_LANGUAGES / len(languages))
    most_rows, most_segments = max(1, int(ROWS_PER_LANGUAGE * part)), max(1, int(SEGMENTS_PER_LANGUAGE * part))
    # a few rows more where only a few are due, so that chance leaves no language without one
    rates = docs.sparkSession.createDataFrame([(k, (most_rows + 20) / counts[k] if most_rows < 100 else most_rows / counts[k]) for k in languages], "lang string, __tm_rate double")
    start = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.greatest(F.length("text") - WINDOW_CHARS, F.lit(1))).cast("int") + 1
    rows = (
        known.join(F.broadcast(rates), "lang").where(id_hash("doc_id", "text") < F.col("__tm_rate") * float(1 << 31))
        .select("lang", F.col("text").substr(start, F.lit(WINDOW_CHARS)).alias("window"), id_hash("doc_id", "text").alias("at"))
        .groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("at", "window"))), 1, 2 * most_rows + 20)["window"].alias("windows")).collect()
    )
    number = {k: i for i, k in enumerate(languages)}
    own: list[list[bytes]] = [[] for _ in languages]
    for r in rows:
        own[number[r["lang"]]] = sorted(s for w in r["windows"] for s in examples(w))
    rng = np.random.default_rng(SEED)
    chosen = [(found[j], i) for i, found in enumerate(own) for j in rng.permutation(len(found))[:most_segments]]
    return BiGru(languages).fit(chosen) if chosen else None


def long_sums(net: BiGru, texts: pa.Array) -> dict[bytes, np.ndarray]:
    """The pooled rows of a batch's long segments, which run side by side."""
    found = list({s for lo in range(0, len(texts), 512) for t in texts.slice(lo, 512).to_pylist() if t and len(t) * 4 > STRETCH for s in long_segments(t)})
    out: dict[bytes, np.ndarray] = {}
    part, size = [], 0
    for k, s in enumerate(found, 1):
        part.append(s)
        size += len(s)
        if size >= LONG_BYTES or k == len(found):
            out.update(zip(part, net.pooled_long(part), strict=True))
            part, size = [], 0
    return out


def predictor(spark: SparkSession, model: BiGru | None):
    """A column function: text to struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net, cache, sums = shared.value, {}, None
        for texts in batches:
            preds, scores = [], []
            long = long_sums(net, texts) if net else {}
            for lo in range(0, len(texts), 512):
                rows = [segments(t) if net and t and any(map(str.isalpha, t)) else [] for t in texts.slice(lo, 512).to_pylist()]
                if len(cache) > CACHED_SEGMENTS:
                    cache, sums = {}, None
                new = list({s for r in rows for s in r if s not in cache and len(s) <= STRETCH})
                if new or sums is None and net:
                    pooled = net.pooled(new)
                    cache.update(zip(new, range(len(cache), len(cache) + len(new)), strict=True))
                    sums = pooled if sums is None else np.concatenate([sums, pooled])
                for r in rows:
                    if not r:
                        preds.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    short = [cache[s] for s in r if len(s) <= STRETCH]
                    total = sums[np.array(short, np.int64)].sum(axis=0, dtype=np.float64)
                    if len(short) < len(r):
                        total = total + sum(long[s] for s in r if len(s) > STRETCH)
                    best = int(total[:-1].argmax())
                    preds.append(net.languages[best])
                    scores.append(min(1.0, max(0.0, float(total[best] / total[-1]))))
            yield pa.StructArray.from_arrays([pa.array(preds, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))

    return predict.asNondeterministic()


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    predict = predictor(spark, train(docs, crc_mod("doc_id", 3) != 1))
    out = docs.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), predict("text").alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, min_score: float = 0.4) -> DataFrame:
    """Pipeline stage: documents without a letter, or of no language with at least min_score, go."""
    predict = predictor(docs.sparkSession, train(docs, crc_mod("doc_id", 3) != 1))
    out = docs.withColumn("__tm_language", predict("text"))
    return out.where((F.col("__tm_language.lang_pred") != UNDETERMINED) & (F.col("__tm_language.score") >= min_score)).select(docs.columns)
