"""Line deduplication by a segment-partition edit join.

Lines are what a text's newlines part, stripped of white space at both ends.  Equal lines form a
class.  Two classes are linked when their lines differ by at most edits_of(l) edits of a character, l
being the shorter length: one for every 8 characters and at most EDITS, so lines under 8 characters
have exact classes only.  A line of length l is split into edits_of(l) + 1 segments, which are indexed
by (l, number, text); a line of length n probes the index for l = n - EDITS .. n with those of its own
pieces that can match a segment at that place when the rest matches too.  Candidates whose letter counts allow a link
are verified by banded bit-parallel edit distance on the whole lines.  Only distinct lines are indexed, and a
segment that very many of them share is dealt out to blocks, which meet two by two.

The first place of a line is its smallest (doc_id, line number, hash of the text).  A line is dropped when its class
occurs earlier, or when its class is linked with one that occurs earlier.

Defined results: blank lines are kept and linked with nothing; a null text
has no line; null doc_ids come first in the order; rows of equal doc_id and text are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, mix64, stage, table
from tidemark.session import ship

#: The most edits of a link, the characters a line needs for each, and the length that gives a line a class.
EDITS, CHARS_PER_EDIT, LEAST_CHARS = 2, 8, 1
#: Letter counts: bins of 4 bits, above the bit that tells an indexed segment from a probe.
BINS = 15
#: Rows of a segment key that one task compares; a key with more is dealt out to blocks.
HOT_ROWS = 4_000
FOUND = "a long, b long, key long"
LINES = "doc_id long, line_no int, row long, h1 long, h2 long"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def lines_of(text: str | None) -> list[str]:
    return [] if text is None else [line.strip() for line in text.split("\n")]


def edits_of(length: int) -> int:
    """The most edits of a link whose shorter line has so many characters."""
    return min(EDITS, length // CHARS_PER_EDIT)


def hashes_of(line: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def list_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, text) to LINES; blank lines have no hash."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            rows = [(d, i, r, *(hashes_of(line) if len(line) >= LEAST_CHARS else (None, None))) for d, r, t in zip(*(part[c].to_pylist() for c in ("doc_id", "row", "text")), strict=True) for i, line in enumerate(lines_of(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "line_no", "row", "h1", "h2"])


def fresh_lines(batches: Iterator[pa.RecordBatch], least_rows: int = 2_000) -> Iterator[tuple[list[str], list[tuple[int, int]]]]:
    """The task's lines that are long enough for a link, without most of its repetitions."""
    seen: set[tuple[int, int]] = set()
    found: list[str] = []
    names: list[tuple[int, int]] = []
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            for text in batch["text"].slice(lo, 64).to_pylist():
                for line in lines_of(text):
                    if len(line) >= CHARS_PER_EDIT and (h := hashes_of(line)) not in seen:
                        seen.add(h)
                        found.append(line)
                        names.append(h)
            if len(found) >= least_rows:
                yield found, names
                found, names = [], []
                if len(seen) > 200_000:
                    seen.clear()
    if found:
        yield found, names


def segment(length: np.ndarray, number: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of segment ``number`` (from 0) of lines of so many characters."""
    base, extra = length // (edits + 1), length % (edits + 1)
    longer_before = np.maximum(0, number - (edits + 1 - extra))
    start = base * number + longer_before
    return start, start + base + (number >= edits + 1 - extra)


def probes() -> list[tuple[int, int, int, int]]:
    """(most edits, length difference, segment, shift) of the pieces that a line has to look up."""
    out = []
    for edits in range(1, EDITS + 1):
        for less in range(edits + 1):
            for i in range(edits + 1):
                low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
                out += [(edits, less, i, shift) for shift in range(low, high + 1)]
    return out


def keys(batches: Iterator[pa.RecordBatch], rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Distinct lines (id, line) to (key, id, sign): each line's indexed segments and probes."""
    for part in (b.slice(lo, rows) for b in batches for lo in range(0, b.num_rows, rows)):
        found = part["line"].to_pylist()
        code = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = np.array([len(line) for line in found], np.int64)
        begin = np.cumsum(n) - n
        power = np.cumprod(np.full(len(code) + 1, _ODD)) * _INVERSE  # ODD ** i, modulo 2 ** 64
        inverse = np.cumprod(np.full(len(code) + 1, _INVERSE)) * _ODD
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(code + _ODD) * power[:-1])])
        counts = np.bincount(np.repeat(np.arange(len(n)), n) * BINS + (code % np.uint64(BINS)).astype(np.int64), minlength=len(n) * BINS).reshape(-1, BINS)
        sign = np.zeros(len(n), np.int64)
        for b in range(BINS):
            sign |= (counts[:, b] & 15) << (4 * b + 1)
        ids = part["id"].to_numpy()
        out = []
        for edits, less, i, shift in probes():
            target = n - less
            ok = np.minimum(EDITS, target // CHARS_PER_EDIT) == edits
            start, end = segment(target, i, edits)
            a, b = (begin + start + shift)[ok], (begin + end + shift)[ok]
            piece = (sums[b] - sums[a]) * inverse[a]
            key = mix64(mix64(piece) + target[ok].astype(np.uint64) * _ODD + np.uint64(i + 1))
            out.append((key.view(np.int64), ids[ok], sign[ok] | int(less == 0 and shift == 0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["key", "id", "sign"])


def allowed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether letter counts differ by at most 2 * EDITS; the counts are known modulo 16."""
    total = np.zeros(len(a), np.int64)
    for k in range(BINS):
        d = ((a >> (4 * k + 1)) - (b >> (4 * k + 1))) & 15
        total += np.minimum(d, 16 - d)
    return total <= 2 * EDITS


def pairs_of(key: np.ndarray, ids: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs a < b of rows sorted by key that share a key, of which one is an index entry and whose letters allow a link."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at, step = np.arange(max(0, len(key) - 1)), 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        pair = at[((sign[at] | sign[at + step]) & 1 == 1) & (ids[at] != ids[at + step])]
        pair = pair[allowed(sign[pair], sign[pair + step])]
        left.append(np.minimum(ids[pair], ids[pair + step]))
        right.append(np.maximum(ids[pair], ids[pair + step]))
        step += 1
    return np.concatenate(left), np.concatenate(right)


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, sign) sorted by key to FOUND: pairs (a, b, null), and the rows (id, sign, key) of keys with more than HOT_ROWS.

    At most HOT_ROWS rows of a key and one batch are held.
    """
    held, hot = [np.empty(0, np.int64)] * 3, None
    for batch in _with_end(batches):
        if batch is not None:
            held = [np.concatenate([h, batch[c].to_numpy()]) for h, c in zip(held, ("key", "id", "sign"), strict=True)]
        key = held[0]
        if not len(key):
            continue
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(heads, len(key)))
        many = (sizes > HOT_ROWS) | (key[heads] == hot if hot is not None else False)
        hot = int(key[-1]) if many[-1] else None
        # a last key that isn't hot so far may go on in the next batch
        cut = len(key) if batch is None or many[-1] else int(heads[-1])
        rows = np.repeat(many, sizes)[:cut]
        now, held = [h[:cut] for h in held], [h[cut:] for h in held]
        if rows.any():
            yield pa.RecordBatch.from_arrays([pa.array(now[k][rows]) for k in (1, 2, 0)], names=["a", "b", "key"])
        a, b = pairs_of(*[h[~rows] for h in now])
        for lo in range(0, len(a), 100_000):
            own = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(a[own]), pa.array(b[own]), pa.nulls(len(a[own]), pa.int64())], names=["a", "b", "key"])


def pairs_of_blocks(group: pa.Table) -> pa.Table:
    """The pairs between two blocks of one key, or inside one block."""
    same = np.zeros(group.num_rows, np.int64)
    ids, sign, part = (group[c].to_numpy() for c in ("a", "b", "part"))
    x, y = ids[part == part.min()], ids[part == part.max()]
    if part.min() == part.max():
        a, b = pairs_of(same, ids, sign)
    else:
        sx, sy = sign[part == part.min()], sign[part == part.max()]
        found = []
        for k in range(len(x)):
            ok = np.flatnonzero(((sx[k] | sy) & 1 == 1) & (y != x[k]))
            ok = ok[allowed(np.full(len(ok), sx[k]), sy[ok])]
            found.append((np.full(len(ok), x[k]), y[ok]))
        a, b = (np.concatenate(v) for v in zip(*found, strict=True))
        a, b = np.minimum(a, b), np.maximum(a, b)
    once = np.unique(np.stack([a, b]), axis=1)
    return pa.table({"a": once[0], "b": once[1]})


def candidate_pairs(keyed: DataFrame) -> DataFrame:
    """(a, b) of (key, id, sign), each pair once.

    The rows of a hot key are dealt out to blocks of about HOT_ROWS, and tasks compare two blocks each,
    so neither a task's memory nor its work grows with the key.
    """
    found = stage(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(candidates, FOUND), "candidates")
    hot = found.where("key is not null")
    blocks = hot.groupBy("key").agg(F.ceil(F.count("*") / HOT_ROWS).cast("int").alias("blocks"))
    dealt = hot.join(blocks, "key").withColumn("part", F.pmod(F.xxhash64("a", "b"), "blocks").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("a", "b", "part", F.struct("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")).alias("meeting"))
    return found.where("key is null").select("a", "b").union(met.groupBy("meeting").applyInArrow(pairs_of_blocks, "a long, b long")).distinct()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (id, h2, line)."""
    for found, names in fresh_lines(batches):
        yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in names], pa.int64()), pa.array([h[1] for h in names], pa.int64()), pa.array(found, pa.string())], names=["id", "h2", "line"])


def within(a: str, b: str, most: int | None = None) -> bool:
    """Whether at most ``most`` (under 32; else what the shorter length allows) edits turn a into b.

    Equal ends are cut off; a band of 64 diagonals of the edit matrix is kept as bits and moved
    down by one row a step (Hyyrö's banded form of Myers' algorithm).
    """
    if len(a) < len(b):
        a, b = b, a
    if most is None:
        most = edits_of(len(b))
    if len(a) - len(b) > most:
        return False
    if not most:
        return a == b
    low, high = 0, len(b)
    while low < high:  # longest common prefix
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, len(b)
    while low < high:  # longest common suffix
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low] else (low, mid - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    if not b:
        return len(a) <= most
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << 64) - 1
    vp, vn, distance = full << (63 - most) & full, 0, most
    start, row, side = most - 63, 1 << 63, 1 << 62
    for j, c in enumerate(b):
        own = where.get(c, 0)
        x = own >> start + j if start + j >= 0 else own << -(start + j)
        x &= full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp, hn = vn | ~(d0 | vp) & full, d0 & vp
        if j < len(a) - most:
            distance += not d0 & row
        else:
            distance += bool(hp & side) - bool(hn & side)
            side >>= 1
        if distance > 2 * most + len(b) - len(a) + most:
            return False
        vp, vn = (hn | ~((d0 >> 1) | hp)) & full, (d0 >> 1) & hp
    return distance <= most


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs with their lines to linked pairs."""
    for batch in batches:
        keep = [within(x, y) for x, y in zip(batch["line_a"].to_pylist(), batch["line_b"].to_pylist(), strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "a2", "b", "b2"])


def line_links(docs: DataFrame) -> DataFrame:
    """(a, a2, b, b2): hashes of the classes that are linked, each pair once."""
    lines = docs.select("text").mapInArrow(texts_of, "id long, h2 long, line string")
    distinct = stage(lines.dropDuplicates(["id", "h2"]), "distinctlines")
    pairs = stage(candidate_pairs(distinct.mapInArrow(keys, "key long, id long, sign long")), "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = distinct.join(ids, "id", "left_semi")
    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("h2").alias("a2"), F.col("line").alias("line_a")), "a")
    with_b = with_a.join(texts.select(F.col("id").alias("b"), F.col("h2").alias("b2"), F.col("line").alias("line_b")), "b")
    links = stage(with_b.mapInArrow(verify, "a long, a2 long, b long, b2 long"), "linelinks")
    discard(distinct, pairs)
    return links


def judged_rows(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, row (the hash of its text), class_doc_id, class_line_no, n_links, kept for every line of docs."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    lines = stage(docs.mapInArrow(list_lines, LINES), "lines")
    links = line_links(docs)
    long = lines.where("h1 is not null")
    first = stage(long.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no", "row")).alias("first")), "firsts")
    each = links.union(links.select("b", "b2", "a", "a2"))
    met = each.join(first.select(F.col("h1").alias("b"), F.col("h2").alias("b2"), F.col("first").alias("other")), ["b", "b2"])
    met = met.groupBy(F.col("a").alias("h1"), F.col("a2").alias("h2")).agg(F.count("*").alias("n_links"), F.min("other").alias("other"))
    classes = stage(first.join(met, ["h1", "h2"], "left"), "lineclasses")
    discard(first, links)
    out = lines.join(classes, ["h1", "h2"], "left")
    own = F.struct("doc_id", "line_no", "row")
    earlier = F.coalesce(F.col("other") < F.col("first"), F.lit(False))
    return out.select(
        "doc_id", "line_no", "row", F.when(F.col("h1").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_doc_id"),
        F.coalesce("first.line_no", "line_no").alias("class_line_no"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("h1").isNull(), True).otherwise((F.col("first") == own) & ~earlier).alias("kept"),
    )


def judged_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, class_doc_id, class_line_no, n_links, kept for every line of docs."""
    return judged_rows(docs).drop("row")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line of every document: its class (the first place of its text), links and verdict."""
    return judged_lines(table(spark, sf_dir, "documents"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """Pipeline stage: texts lose their dropped lines; documents of which no text is left go."""
    gone = judged_rows(docs).where("not kept").groupBy(F.col("doc_id").alias("__tm_doc"), F.col("row").alias("__tm_row")).agg(F.collect_set("line_no").alias("__tm_gone"))
    out = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__tm_doc")) & (F.xxhash64("text") == F.col("__tm_row")), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__tm_gone", i)), "\n")
    out = out.withColumn("text", F.when(F.col("__tm_gone").isNull(), F.col("text")).otherwise(left))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__tm_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.where(F.col("__tm_gone").isNull() | F.col("text").rlike(r"\S")).select(docs.columns)
