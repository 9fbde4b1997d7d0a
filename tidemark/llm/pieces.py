"""Sampled SentencePiece segmentations by forward filtering and backward sampling; lossless decoding.

The text, with a space put before it and every space written as U+2581, is cut into units: a run
of U+2581 with the characters up to the next one, or a run of other white space.  The lattice of a unit has an edge for every piece of the vocabulary that matches, and
one through byte pieces for each character that is no piece itself.  A piece of rank r (its place
in the file) has weight (r + 2) ** -THETA.  The forward filter adds up, for every position, the
weights of all paths to it, in logarithms where a unit is long; the backward sampler draws the edges from the unit's end, in proportion
to filter times weight, so a segmentation is drawn with its exact probability.

Draws are hashes of (row key, unit number, step), so a row's ids depend on nothing but its key and text.
Decoding joins the pieces, turns byte pieces back into bytes, and removes the first space.

Defined results: a null text has null ids and decodes to null; an empty text is the space that is
put before it; U+2581 itself is written as bytes, so it can't be taken for a space; rows with equal key and text get equal ids.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import mix64, table
from tidemark.session import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THETA = 0.8
#: Units up to so many characters share one table; the others' filters are kept in logarithms.
SHORT_CHARS = 48
SPACE = "▁"
UNIT = re.compile(rf"{SPACE}+[^{SPACE}\s]*|[^{SPACE}\s]+|[^\S{SPACE}]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Characters of a block of rows, about: bounds a block's arrays.
BLOCK_CHARS = 1_200_000


def text_hashes(texts: list[str]) -> np.ndarray:
    """64-bit hashes of texts of one length, by their characters."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(len(texts), -1)
    power = np.cumprod(np.full(codes.shape[1], _ODD)) * _INVERSE
    return mix64((mix64(codes + _ODD) * power).sum(axis=1, dtype=np.uint64))


class HashTable:
    """Values of 64-bit hashes: sorted hashes, and for their first bits where those begin."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.shift = np.uint64(64 - max(1, len(hashes).bit_length() + 1))
        first = hashes[order] >> self.shift
        self.starts = np.searchsorted(first, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64))
        self.most = int(np.bincount(first.astype(np.int64)).max(initial=0))
        # behind the last hash stands one that is looked for nowhere near
        self.hashes, self.values = np.append(hashes[order], np.zeros(self.most + 1, np.uint64)), np.append(values[order], np.full(self.most + 1, -1))

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the wanted hashes are there, and their values."""
        at, known = self.starts[wanted >> self.shift], np.zeros(len(wanted), bool)
        todo = np.arange(len(wanted))
        for _ in range(self.most):
            same = self.hashes[at[todo]] == wanted[todo]
            known[todo[same]] = True
            todo = todo[~same]
            at[todo] += 1
        return known, self.values[at[known]]


class Vocabulary:
    """Pieces by text with their ids, and the ids of the 256 byte pieces."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(pieces) if model.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.longest = max(map(len, self.ids))
        self.log_weight = -THETA * np.log(np.arange(n) + 2.0)
        ways: list[dict[str, int]] = [{} for _ in range(self.longest)]  # prefixes by length; -1: no piece
        for text, i in self.ids.items():
            for k in range(1, len(text)):
                ways[k - 1].setdefault(text[:k], -1)
            ways[len(text) - 1][text] = i
        self.prefixes = []
        for own in ways:
            self.prefixes.append(HashTable(text_hashes(list(own)), np.array(list(own.values()))))
        self.output: list[bytes] = [b""] * n
        for p, i in self.ids.items():
            self.output[i] = p.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.output[i] = bytes([b])
        self.outputs = pa.array(self.output, pa.binary())
        self.sizes = np.array([len(o) for o in self.output])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]

    def spelled(self, ids: np.ndarray) -> memoryview:
        """The bytes of all ids one after another."""
        taken = self.outputs.take(pa.array(ids))
        return memoryview(taken.buffers()[2] or b"")[: int(self.sizes[ids].sum())]


def units(text: str) -> list[str]:
    """The units of a text that holds no literal U+2581."""
    return UNIT.findall(SPACE + text.replace(" ", SPACE))


class Lattices:
    """The lattices of a block's distinct units, as flat tables.

    A node is a position of a unit.  Edges are found for all units at once: a start stays active for
    one more character as long as its substring is a prefix of a piece, by hashes of substrings.
    Every path over a character may be scaled by the same factor, so weights are divided by
    those of the single characters, and no filter value of a short unit under- or overflows; with ``logs`` the
    filter is kept in logarithms.  Edges into node v have
    cumulated shares in (v, v + 1], so the first one over v + u draws an edge of v.
    """

    def __init__(self, vocabulary: Vocabulary, units_: list[str | None], logs: bool = False):
        names = [SPACE if u is None else u for u in units_]
        sizes = np.array(list(map(len, names)))
        self.begin = np.cumsum(sizes + 1) - sizes - 1  # a unit's first node
        self.end = self.begin + sizes
        codes = np.frombuffer("\0".join([*names, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        inner = np.ones(len(codes), bool)
        inner[self.end] = False  # the character between two units
        nodes = np.arange(len(codes))
        last = np.repeat(self.end, sizes + 1)
        literal = np.zeros(len(codes), bool)
        if None in units_:
            at = units_.index(None)
            literal[self.begin[at] : self.end[at] + 1] = True
        power = np.cumprod(np.full(len(codes) + 1, _ODD)) * _INVERSE
        inverse = np.cumprod(np.full(len(codes) + 1, _INVERSE)) * _ODD
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(codes + _ODD) * power[:-1])])

        active = nodes[inner & ~literal]
        starts, ends, ids = [], [], []
        single = np.full(len(codes), -1)
        for length, table in enumerate(vocabulary.prefixes, 1):
            active = active[active + length <= last[active]]
            known, piece = table.find(mix64((sums[active + length] - sums[active]) * inverse[active]))
            active = active[known]
            found = piece >= 0
            if length == 1:
                single[active[found]] = piece[found]
            starts.append(active[found])
            ends.append(active[found] + length)
            ids.append(piece[found])
        spelled = np.flatnonzero(inner & (single < 0))
        chars, which = np.unique(codes[spelled], return_inverse=True)
        self.runs = [[vocabulary.bytes[b] for b in chr(int(c)).encode("utf-8", "surrogatepass")] for c in chars]
        run_weight = np.array([vocabulary.log_weight[r].sum() for r in self.runs])
        base = np.zeros(len(codes))
        base[inner] = vocabulary.log_weight[single[inner]]
        if len(spelled):
            base[spelled] = run_weight[which]
        total = np.concatenate([[0.0], np.cumsum(base)])
        start, end = np.concatenate([*starts, spelled]), np.concatenate([*ends, spelled + 1])
        first = np.concatenate([*ids, -1 - which.reshape(-1)])
        own = np.where(first >= 0, vocabulary.log_weight[first], base[start])
        order = np.argsort(end * 64 + (end - start), kind="stable")
        self.source, end, self.first = start[order], end[order], first[order]
        weight = own[order] - (total[end] - total[self.source])

        place = (end - np.repeat(self.begin, sizes + 1)[end]).astype(np.int64 if logs else np.uint8)
        by_place = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[by_place], np.arange(1, int(sizes.max(initial=0)) + 2))
        if not logs:
            weight = np.exp(weight)
        alpha = np.zeros(len(codes))
        alpha[self.begin] = 0 if logs else 1
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if lo == hi:
                continue
            e = by_place[lo:hi]
            into = end[e]
            heads = np.flatnonzero(np.append(True, into[1:] != into[:-1]))
            if logs:
                paths, counts = weight[e] + alpha[self.source[e]], np.diff(np.append(heads, len(e)))
                most = np.maximum.reduceat(paths, heads)
                alpha[into[heads]] = most + np.log(np.add.reduceat(np.exp(paths - np.repeat(most, counts)), heads))
                weight[e] = np.exp(paths - np.repeat(alpha[into[heads]], counts))
            else:
                weight[e] *= alpha[self.source[e]]
                alpha[into[heads]] = np.add.reduceat(weight[e], heads)
        heads = np.flatnonzero(np.append(True, end[1:] != end[:-1])) if len(end) else np.empty(0, np.int64)
        counts = np.diff(np.append(heads, len(end)))
        run = np.cumsum(weight if logs else weight / alpha[end])
        run -= np.repeat(np.concatenate([[0.0], run])[heads], counts)
        run[heads + counts - 1] = 1.0
        self.share = end + np.minimum(run, 1.0)
        self.heads = np.zeros(len(codes), np.int64)  # a node's first edge
        self.heads[end[heads]] = heads

    def sample(self, unit_numbers: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(occurrence, id) of all drawn pieces, in text order within an occurrence."""
        who, at, start = np.arange(len(unit_numbers)), self.end[unit_numbers], self.begin[unit_numbers]
        occurrences, edges, step = [], [], 0
        while len(who):
            draw = mix64(seeds[who] + np.uint64(step * 0xD1342543DE82EF95 % (1 << 64)))
            u = (draw >> np.uint64(12)).astype(np.float64) * 2.0**-52
            drawn, edge, todo = np.minimum(at + u, np.nextafter(at + 1.0, 0.0)), self.heads[at], np.arange(len(at))
            while len(todo := todo[self.share[edge[todo]] <= drawn[todo]]):  # a node's last share is over any draw
                edge[todo] += 1
            occurrences.append(who)
            edges.append(self.first[edge])
            at = self.source[edge]
            more = at > start[who]
            who, at = who[more], at[more]
            step += 1
        who = np.concatenate(occurrences)[::-1] if occurrences else np.empty(0, np.int64)
        ids = np.concatenate(edges)[::-1] if edges else np.empty(0, np.int64)
        order = np.argsort(who, kind="stable")  # the last step drew an occurrence's first piece
        return who[order], ids[order]


def units_of(text: str) -> list[str | None]:
    """The units in text order; None is a literal U+2581."""
    if SPACE not in text:
        return units(text)
    out: list[str | None] = []
    for k, part in enumerate(text.split(SPACE)):
        if k:
            out.append(None)
        found = units(part) if part or not k else []
        if k and found:  # only the text's start gets a space put before it
            found = [found[0][1:], *found[1:]] if len(found[0]) > 1 else found[1:]
        out += found
    return out


def draw(vocabulary: Vocabulary, keys: list[int], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The sampled ids of all texts one after another, and where each text's begin and end."""
    number: dict[str | None, int] = defaultdict(count().__next__)  # in order of appearance
    numbers, counts = [], []
    for text in texts:
        found = units_of(text) if text is not None else []
        numbers += map(number.__getitem__, found)
        counts.append(len(found))
    if not numbers:
        return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    sizes, at = np.array(counts), np.array(numbers)
    rows = np.repeat(np.arange(len(texts)), sizes)
    place = (np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint64)
    key = mix64(np.array([(k or 0) & ((1 << 64) - 1) for k in keys], np.uint64))[rows]
    seeds = mix64(key + place * np.uint64(0x9E3779B97F4A7C15))
    distinct = list(number)
    long = np.array([0 if u is None else len(u) for u in distinct]) > SHORT_CHARS
    which, drawn, runs = np.cumsum(long) - 1, [], []
    which[~long] = np.arange((~long).sum())
    for logs in (False, True):
        own = np.flatnonzero(long[at] == logs)
        if len(own):
            lattices = Lattices(vocabulary, [u for u, x in zip(distinct, long.tolist(), strict=True) if x == logs], logs)
            who, ids = lattices.sample(which[at[own]], seeds[own])
            drawn.append((own[who], np.where(ids < 0, ids - len(runs), ids)))
            runs += lattices.runs
    who, ids = (np.concatenate(x) for x in zip(*drawn, strict=True))
    if len(drawn) > 1:
        order = np.argsort(who, kind="stable")
        who, ids = who[order], ids[order]
    if len(runs):  # numbers under 0 stand for the byte pieces of a character
        width = np.ones(len(ids), np.int64)
        odd = np.flatnonzero(ids < 0)
        width[odd] = np.array([len(r) for r in runs])[-1 - ids[odd]]
        first = np.cumsum(width) - width
        who, spelled = np.repeat(who, width), np.repeat(ids, width)
        for k, r in zip(first[odd].tolist(), (-1 - ids[odd]).tolist(), strict=True):
            spelled[k : k + len(runs[r])] = runs[r]
        ids = spelled
    return ids, np.searchsorted(rows[who], np.arange(len(texts) + 1))


def encode(vocabulary: Vocabulary, keys: list[int], texts: list[str | None]) -> list[list[int] | None]:
    """Sampled ids of each text, by its row key."""
    ids, cuts = draw(vocabulary, keys, texts)
    return [None if t is None else ids[a:b].tolist() for t, a, b in zip(texts, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def encoded(vocabulary: Vocabulary, keys: list[int], texts: list[str | None]) -> pa.Array:
    """struct(ids, n_pieces, lossless) of each text; null texts have nulls."""
    ids, cuts = draw(vocabulary, keys, texts)
    back, n = vocabulary.spelled(ids), np.concatenate([[0], np.cumsum(vocabulary.sizes[ids])])[cuts].tolist()
    same = [None if t is None else bytes(back[a + 1 : b]) == t.encode("utf-8", "surrogatepass") for t, a, b in zip(texts, n[:-1], n[1:], strict=True)]
    none = pa.array([t is None for t in texts])
    listed = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=none)
    return pa.StructArray.from_arrays([listed, pc.if_else(none, None, pa.array(np.diff(cuts))), pa.array(same, pa.bool_())], names=["ids", "n_pieces", "lossless"])


def sampler(path: str = MODEL):
    """A function over batches of (key, text) to struct(ids, n_pieces, lossless)."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        vocabulary = Vocabulary(path)
        for keys, texts in batches:
            parts, lo = [], 0
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + sizes[hi] <= BLOCK_CHARS):
                    size += sizes[hi]
                    hi += 1
                parts.append(encoded(vocabulary, keys.slice(lo, hi - lo).to_pylist(), texts.slice(lo, hi - lo).to_pylist()))
                lo = hi
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("lossless", pa.bool_())]))

    return F.arrow_udf(run, "ids array<int>, n_pieces long, lossless boolean")


def decoder(path: str = MODEL):
    """A column function: ids to text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = Vocabulary(path)
        for ids in batches:
            yield pa.array([None if i is None else vocabulary.decode(i) for i in ids.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


def sampled_pieces(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_pieces, lossless (whether the ids decode to the text)."""
    ship(docs.sparkSession)
    out = docs.select("doc_id", sampler(path)(F.col("doc_id").cast("long"), F.col("text")).alias("p"))
    return out.select("doc_id", "p.ids", "p.n_pieces", "p.lossless")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled ids of every document's whole text, and whether they decode to it."""
    return sampled_pieces(table(spark, sf_dir, "documents"))
