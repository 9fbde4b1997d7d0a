"""Document fingerprints by locally consistent parsing.

A text's characters are the names of level 0.  On every level runs of equal names become one
name; deterministic coin tossing on neighbouring names (the lowest bit in which they differ, and
its value) shrinks names to small labels, two rounds of it; a phrase begins at every local
maximum of the labels, and a phrase's name is a hash of its names.  Labels depend on a few neighbours only, so equal
substrings get the same interior phrases wherever they stand.  Levels go on until one name, the
root, is left.

The fingerprint is the root and the SKETCH smallest phrase names of each of the levels 2 and 3.
The likeness of two fingerprints is the mean over both levels of the estimated Jaccard similarity
of their phrase sets (exact for sets up to SKETCH); equal roots have likeness 1.

Defined results: a null text counts as empty; an empty text has root 0 and no phrases; two texts
without phrases on a level are alike there only if their roots are equal; rows are ordered by
(doc_id, hash of text), null ids first, so rows that repeat an id have a defined next row.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import mix64, stage, table

SKETCH, LEVELS = 32, (2, 3)
#: Characters that are parsed at once, about, and rows of a sorted range.
CHUNK, RANGE_ROWS, MOST_RANGES = 400_000, 500, 10_000
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_POWERS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Second round of coin tossing, as a table over two labels.
_low = np.arange(128)[:, None] ^ np.arange(128)[None, :]
_low = np.where(_low > 0, np.log2((_low & -_low) + (_low == 0)), 0).astype(np.int64)
_SECOND = (2 * _low + ((np.arange(128)[None, :] >> _low) & 1)).astype(np.uint8)


def next_level(names: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names and their texts' numbers; phrases never cross a text's end."""
    new_text = np.empty(len(names), bool)
    new_text[0] = True
    np.not_equal(text[1:], text[:-1], out=new_text[1:])
    begins = new_text.copy()
    begins[1:] |= names[1:] != names[:-1]
    if not begins.all():
        at = np.flatnonzero(begins)
        length = np.diff(np.append(at, len(names))).astype(np.uint64)
        names, text, new_text = names[at], text[at], new_text[at]
        long = length > 1
        names[long] = mix64(names[long] + length[long] * np.uint64(0x9E3779B97F4A7C15))
    differ = np.empty(len(names), np.uint64)
    differ[0] = 1
    np.bitwise_xor(names[1:], names[:-1], out=differ[1:])
    differ |= np.uint64(1) << np.uint64(63)  # texts may begin with the name that ends the one before
    lowest = np.bitwise_count(~differ & (differ - np.uint64(1)))
    label = (2 * lowest + ((names >> lowest.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
    label[new_text] = 0
    label[1:] = _SECOND[label[:-1], label[1:]]
    label[new_text] = 0
    # strict on the left, weak on the right: of equal neighbours at a text's start only the first counts
    peak = new_text.copy()
    peak[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:]) & ~new_text[2:]
    at = np.flatnonzero(peak)
    if len(at) and np.diff(np.append(at, len(names))).max() > 200:  # keeps phrases bounded
        place = np.arange(len(names)) - np.repeat(at, np.diff(np.append(at, len(names))))
        at = np.flatnonzero(peak | (place % 200 == 0))
    place = np.arange(len(names)) - np.repeat(at, np.diff(np.append(at, len(names))))
    phrase = mix64(np.add.reduceat(names * _POWERS[place], at) + np.uint64(1))
    return phrase, text[at]


def fingerprints(texts: list[str]) -> list[str]:
    """Root and sketches, as fixed-width hex with dots between levels."""
    out: list[list[str]] = [[] for _ in texts]
    roots = np.zeros(len(texts), np.uint64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    if len(text):
        names = mix64(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
        level, order = 0, np.arange(len(texts))
        while True:
            begin = np.searchsorted(text, order)
            single = np.searchsorted(text, order, "right") - begin == 1
            if level >= max(LEVELS):
                roots[order[single]] = names[begin[single]]
                keep = ~single[np.searchsorted(order, text)]
                names, text, order = names[keep], text[keep], order[~single]
                if not len(names):
                    break
            names, text = next_level(names, text)
            order = text[np.flatnonzero(np.append(True, text[1:] != text[:-1]))]
            level += 1
            if level in LEVELS:
                by = np.lexsort((names, text))
                n, t = names[by], text[by]
                fresh = np.append(True, (n[1:] != n[:-1]) | (t[1:] != t[:-1]))
                n, t = n[fresh], t[fresh]
                starts = np.searchsorted(t, np.arange(len(texts) + 1))
                for i in range(len(texts)):
                    out[i].append(n[starts[i] : min(starts[i + 1], starts[i] + SKETCH)].astype(">u8").tobytes().hex())
    return [".".join([f"{int(r):016x}", *(o or [""] * len(LEVELS))]) for r, o in zip(roots, out, strict=True)]


def likeness(a: str, b: str) -> float:
    """The estimated similarity, 0 to 1, of the texts of two fingerprints."""
    (root_a, *one), (root_b, *two) = a.split("."), b.split(".")
    if root_a == root_b:
        return 1.0
    total = 0.0
    for x, y in zip(one, two, strict=True):
        x, y = ({s[i : i + 16] for i in range(0, len(s), 16)} for s in (x, y))
        low = sorted(x | y)[:SKETCH] if min(len(x), len(y)) >= SKETCH else sorted(x | y)
        if len(x) >= SKETCH or len(y) >= SKETCH:  # beyond a full sketch's largest name nothing is known
            bound = min(max(s) for s in (x, y) if len(s) >= SKETCH)
            low = [v for v in low if v <= bound]
        total += len(x & y & set(low)) / len(low) if low else 0.0
    return total / len(one)


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, doc_id, hash, tail) to RESULT; a range's last row is its tail, the next range's first."""
    rows: list[tuple] = []
    size = 0
    held: tuple | None = None  # the last row, whose next one hasn't come yet, with its fingerprint

    def flush() -> pa.RecordBatch | None:
        nonlocal rows, size, held
        whole = ([held[0]] if held else []) + rows
        if not whole:
            return None
        pairs = [(x, y) for x, y in zip(whole, whole[1:], strict=False) if x[0] == y[0] and not x[3]]
        changed = [edited(x[2], y[2]) for x, y in pairs]
        prints = ([held[1]] if held else []) + fingerprints([r[2] for r in rows])
        of = {id(r): p for r, p in zip(whole, prints, strict=True)}
        after = fingerprints(changed)
        own, following = [of[id(x)] for x, _ in pairs], [of[id(y)] for _, y in pairs]
        held, rows, size = (whole[-1], prints[-1]), [], 0
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[1] for x, _ in pairs], pa.int64()),
                pa.array([len(x[2]) for x, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                pa.array(own, pa.string()),
                pa.array(after, pa.string()),
                pa.array([likeness(x, y) for x, y in zip(own, after, strict=True)], pa.float64()),
                pa.array([likeness(x, y) for x, y in zip(own, following, strict=True)], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            for row in zip(part["range"].to_pylist(), part["doc_id"].to_pylist(), part["text"].to_pylist(), part["tail"].to_pylist(), strict=True):
                rows.append((row[0], row[1], row[2] or "", row[3]))
                size += len(rows[-1][2])
                if size > CHUNK:
                    yield flush()
    if (last := flush()) is not None:
        yield last


Place = tuple[bool, int, int]


def place(doc_id: int | None, text_hash: int) -> Place:
    return (doc_id is not None, doc_id or 0, text_hash)


def deal(batches: Iterator[pa.RecordBatch], starts: list[Place]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their range; the first row of a range also becomes the tail of the one before."""
    first = set(starts)
    for batch in batches:
        take, number, tail = [], [], []
        for i, at in enumerate(map(place, batch["doc_id"].to_pylist(), batch["hash"].to_pylist())):
            k = bisect.bisect_right(starts, at) - 1
            take.append(i)
            number.append(k)
            tail.append(False)
            if at in first:
                take.append(i)
                number.append((k - 1) % len(starts))
                tail.append(True)
        rows = batch.take(pa.array(take, pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), rows["doc_id"], rows["text"], rows["hash"], pa.array(tail)], names=["range", "doc_id", "text", "hash", "tail"])


def with_next(docs: DataFrame) -> DataFrame:
    """Documents dealt out to ranges of the order (doc_id, hash), each range with its follower as a tail row.

    The ranges' first places, about one for RANGE_ROWS rows and at most MOST_RANGES, reach the driver.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    n = max(1, min(MOST_RANGES, ordered.count() // RANGE_ROWS))
    ids = ordered.select(F.struct("doc_id", "hash").alias("at"))
    parts = stage(ids.repartitionByRange(n, "at").select(F.spark_partition_id().alias("part"), "at"), "ranges")
    starts = sorted(place(*r["at"]) for r in parts.groupBy("part").agg(F.min("at").alias("at")).collect())
    return ordered.mapInArrow(lambda batches: deal(batches, starts), "range int, doc_id long, text string, hash long, tail boolean")


def fingerprint(docs: DataFrame) -> DataFrame:
    """RESULT for documents (doc_id, text)."""
    dealt = with_next(docs)
    return dealt.repartition("range").sortWithinPartitions("range", "tail", "doc_id", "hash").mapInArrow(fingerprint_rows, RESULT)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    return fingerprint(table(spark, sf_dir, "documents"))
