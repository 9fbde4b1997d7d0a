"""Operators 11 to 13 against brute force: neighbours by curves, Merkle proofs, and the threshold algorithm."""

import math
import random
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from oracle import SF_DIR, difference

from tidemark.llm import curves, manifest, threshold
from tidemark.llm.queries import oracle_sql, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string"


# Neighbours


def test_hilbert_visits_every_cell_by_single_steps():
    for width, bits in ((2, 4), (3, 2), (1, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * width, indexing="ij"), -1).reshape(-1, width)
        keys = curves.hilbert(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def brute(rows, k=10):
    """The k nearest of each row whose id is divisible by 100, by (distance, id); rows: (id, vector), each pair once."""
    usable = {(i, tuple(float(np.float32(x)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in usable:
        if q % 100 == 0:
            near = sorted({(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in usable if i != q and len(w) == len(v)})[:k]
            out.setdefault(q, []).append([i for _, i in near])
    return out


def found(spark, rows):
    df = curves.usable(spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, query_id string, rank int"))
    out = {}
    for r in curves.neighbours(df, df.where("vec_id % 100 = 0")).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(x) for q, x in out.items()}


def test_neighbours_of_odd_vectors(spark):
    pick = random.Random(4)
    rows = [(k, [pick.gauss(0, 1) for _ in range(8)]) for k in range(1, 260)]
    rows += [(None, [1.0] * 8), (900, None), (901, []), (902, [None] * 8), (903, [float("nan")] * 8), (904, [0.0] * 8), (905, [float("inf")] * 8)]
    rows += [(1000 + k, rows[99][1]) for k in range(30)]  # copies of the vector of id 100
    rows += [(2000 + k, [float(k + 1), 2.0, 3.0]) for k in range(4)]  # another length
    rows += [rows[5], rows[99], (7, rows[99][1])]  # repeated rows, a repeated id
    got, want = found(spark, rows), brute(rows)
    assert {q: [[v for _, v, _ in x]] for q, x in got.items()} == want
    assert [v for _, v, _ in got[100]] == [7, *range(1000, 1009)] and all(s == 0 for _, _, s in got[100])
    assert [r for r, _, _ in got[2000]] == [1, 2, 3]


def test_neighbours_of_nothing(spark):
    assert found(spark, [(904, [0.0, 0.0])]) == {} and found(spark, [(100, [1.0])]) == {}


def test_windows_follow_structure_and_keep_recall(spark):
    """Vectors near a curve of the space: windows hold a small share of the table, and most neighbours."""
    rng = np.random.default_rng(3)
    t = rng.random(6000) * 40
    points = np.stack([np.cos(t * (k + 1) / 6) + rng.normal(0, 0.01, len(t)) for k in range(16)], 1)
    rows = [(k, p.tolist()) for k, p in enumerate(points)]
    df = curves.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    classes, asked = curves.classes_of(df, df.where("vec_id % 100 = 0"), 10)
    ids = {r["row"]: r["ids"][0] for r in classes.collect()}
    sample = {16: [curves.Curve(16, c, points) for c in range(curves.CURVES)]}
    probes = [(r["row"], points[ids[r["row"]]]) for r in asked.collect()]
    width = curves.windows_of(classes, curves.placed_on(classes, sample), {16: (np.array([r for r, _ in probes]), np.array([v for _, v in probes]))}, 10)[16]
    assert width < 600
    got = found(spark, rows)
    caught = sum(len({v for _, v, _ in got[q]} & set(near[0])) for q, near in brute(rows).items())
    assert caught >= 0.9 * 10 * 60


# Manifest


def H(parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Root, and each leaf's siblings (before, after) by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for k, pos in enumerate(at):
            run = runs[pos // 3]
            paths[k].append(("".join(run[: pos % 3]), "".join(run[pos % 3 + 1 :])))
        at, level = [p // 3 for p in at], [H(r) for r in runs]
    return level[0], paths


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 100, 243, 250])
def test_traversal_emits_the_paths_of_the_tree(n):
    leaves = [H([str(k)]) for k in range(n)]
    assert list(manifest.traverse(leaves, manifest.levels_of(n))) == plain_tree(leaves)[1]


def plain_manifest(docs):
    if not docs:
        return []
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, text: H([field(d[0]), field(d[3]), field(d[2]), field(d[4]), field(text)])
    by_source = {}
    for d in docs:
        by_source.setdefault(d[3], []).append(d)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted(((d[0] is not None, d[0] or 0, leaf(d, d[1])), d) for d in by_source[s])
        trees[s] = own, plain_tree([k[2] for k, _ in own])
    root, upper = plain_tree([trees[s][1][0] for s in sources])
    out = []
    for s, up in zip(sources, upper, strict=True):
        own, (subroot, paths) = trees[s]
        for (key, d), path in zip(own, paths, strict=True):
            tampered = d[1].replace("\n", "") if d[1] is not None and d[0] is not None and crc32(str(d[0]).encode()) % 2 == 0 else d[1]
            node = leaf(d, tampered)
            for before, after in [*path, *up]:
                node = H([before, node, after])
            out.append((d[0] if d[0] is not None else -1, key[2], subroot, root, H([b + a for b, a in [*path, *up]]), node, node == root))
    return sorted(out)


@pytest.mark.parametrize("height", [2, 7])  # blocks of 9 leaves, so that roots take several rounds
def test_manifest_like_a_plain_tree(spark, height):
    pick = random.Random(2)
    docs = [(k, pick.choice(["a\nb", "é\n", "", None, "plain"]), pick.choice(["de", None]), pick.choice(["hot"] * 5 + ["s1", "s10", "é", "", None]), pick.choice([3, None]), "x", "y") for k in range(120)]
    docs += [docs[3], docs[3], (None, "no id\n", None, "hot", 1, "x", "y"), (3, "same id", "en", docs[3][3], 7, "x", "y"), (500, "long " * 50_000, "en", "lone", 1, "x", "y")]
    got = manifest.checked(manifest.proofs(spark.createDataFrame(docs, DOCS), height)).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, *list(r)[1:]) for r in got) == plain_manifest(docs)


@pytest.mark.parametrize("docs", [[], [(1, "a", "en", "s", 1, "", "")], [(1, "a\n", "en", "s", 1, "", ""), (2, "b", "en", "t", 1, "", "")]])
def test_manifest_of_few(spark, docs):
    assert sorted(map(tuple, manifest.checked(manifest.proofs(spark.createDataFrame(docs, DOCS))).collect())) == plain_manifest(docs)


# Threshold search


def plain_terms(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if ord(c) >= 128 or c.isascii() and c.isalnum():
            word += c.lower() if c.isascii() else c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_ranking(docs, items):
    counted = [(d, Counter(plain_terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n, length = len(counted), sum(x for _, _, x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c, size in counted:
            m = 100 - 90 + (90 * size * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if c[t])
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(item, k, d, -s) for k, (s, d) in enumerate(sorted(scores)[:10], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("postings", [1_000_000, 40])
def test_ranking_like_brute_force(spark, monkeypatch, postings):
    monkeypatch.setattr(threshold, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(threshold, "BLOCK_TERMS", 1_000_000 if postings > 40 else 12)
    pick = random.Random(8)
    words = ["the", "The", "ÉTÉ", "été", "x1", "a", "b", "c", "d", "漢字", "foo"] + [f"w{k}" for k in range(30)]
    docs = [(k, "".join(pick.choice(words) + pick.choice([" ", "-", " ", "\n", "_"]) for _ in range(pick.randrange(40)))) for k in range(150)]
    docs += [(500 + k, "the foo foo bar") for k in range(40)] + [(None, "foo bar"), (3, "foo"), (3, "foo"), (700, None), (701, ""), (702, "--- !"), (703, "foo " * 90_000)]
    items = [(1, "foo bar"), (2, "The été, x1!"), (3, None), (4, "..."), (None, "foo"), (5, "unknown"), (6, " ".join(words)), (6, "foo"), (1, "foo bar")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, rank int").repartition(5)
    i = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, score string")
    assert sorted(map(tuple, threshold.ranked(d, i).collect()), key=str) == plain_ranking(docs, items)


def test_ranking_of_nothing(spark):
    d, i = (spark.createDataFrame(x, k) for x, k in (([(1, "a")], "doc_id long, text string"), ([(1, "a")], "item_id long, text string")))
    assert threshold.ranked(d.limit(0), i).count() == 0 and threshold.ranked(d, i.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op12_manifest", "op13_ranked"])
def test_queries_same_as_sql(spark, name):
    assert not difference(queries()[name](spark, SF_DIR), oracle_sql()[name], SF_DIR)


def test_op11_has_all_neighbours_of_a_small_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = {}
    for r in queries()["op11_neighbours"](spark, SF_DIR).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    want = brute(rows)
    assert sum(len({v for _, v in got[q]} & set(near[0])) for q, near in want.items()) >= 0.9 * 10 * len(want)
