"""Repeated ids, hot keys, exact counts and gradients of the text operators, each against a plain version."""

import collections
import itertools
import random
from types import SimpleNamespace

import numpy as np
import pytest
from test_text_operators import BASE, NEAR, edits, frame

from tidemark.llm import common, hmm, langid, linededup, minhash, toxicity


def session(master, configured=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: configured), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_only_a_local_master_gets_a_folder_of_its_own():
    assert common.shared_dir(session("yarn", "hdfs://x/shared")) == "hdfs://x/shared"
    assert common.shared_dir(session("local[4]")) == common.shared_dir(session("local[4]"))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError):
            common.shared_dir(session(master))


def test_one_of_each_with_repeated_and_null_ids(spark):
    other, third = "quite other words are in this text of mine", "and this is a third text that nobody else has"
    rows = [(1, BASE), (7, " ".join(NEAR)), (7, other), (7, other), (8, other), (None, third), (None, third), (9, third), (3, None), (3, None), (4, " ")]
    out = minhash.keep_one_of_each(frame(spark, rows))
    assert out.columns == frame(spark).columns
    got = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == {(1, BASE): 1, (7, other): 1, (None, third): 1, (3, None): 2, (4, " "): 1}


def brute_links(lines):
    return {frozenset((a, b)) for a, b in itertools.combinations(sorted(lines), 2) if abs(len(a) - len(b)) <= 2 and edits(a, b) <= min(2, min(len(a), len(b)) // 8)}


@pytest.mark.parametrize("hot", [3, 40])
def test_hot_segments_lose_no_link(spark, monkeypatch, hot):
    monkeypatch.setattr(linededup, "HOT_ROWS", hot)
    rng = random.Random(4)
    lines = sorted({f"Posted by user {rng.randint(0, 4000):05} today" for _ in range(150)} | {"an ordinary line stands here", "an ordinary lime stands here"})
    rows = [(i, "\n".join(rng.sample(lines, 12))) for i in range(30)]
    seen = {line for _, t in rows for line in t.split("\n")}
    docs = frame(spark, rows).repartition(7)
    name = {linededup.hashes_of(line): line for line in seen}
    got = [frozenset((name[r["a"], r["a2"]], name[r["b"], r["b2"]])) for r in linededup.line_links(docs).collect()]
    assert set(got) == brute_links(seen) and len(got) == len(set(got))


def test_one_line_in_every_document(spark):
    rows = [(i, f"the same line is in all of the documents here\nown line {i * 7919:09} of this text") for i in range(2000)]
    docs = frame(spark, rows).repartition(200)
    lines = linededup.judged_lines(docs)
    assert lines.where("line_no = 0 and kept").count() == 1
    distinct = docs.select("text").mapInArrow(linededup.texts_of, "id long, h2 long, line string").dropDuplicates(["id", "h2"])
    assert distinct.count() == 2001


def test_very_long_line_and_text(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(200_000)).strip()
    rows = [(1, long), (2, long[:90_000] + "#" + long[90_001:]), (3, long[:-3]), (4, f"x\n{long}")]
    got = {(r["doc_id"], r["line_no"]): (r["n_links"], r["kept"]) for r in linededup.judged_lines(frame(spark, rows)).collect()}
    assert got == {(1, 0): (1, True), (2, 0): (1, False), (3, 0): (0, True), (4, 0): (0, True), (4, 1): (1, False)}
    kept = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert kept == {1: 1, 2: 1, 3: 1, 4: 1}


def brute_counts(model, seqs):
    start, move, emit = np.zeros_like(model.start), np.zeros_like(model.move), np.zeros_like(model.emit)
    for s in seqs:
        paths = list(itertools.product(range(len(model.start)), repeat=len(s)))
        p = np.array([model.start[q[0]] * model.emit[q[0], s[0]] * np.prod([model.move[a, b] * model.emit[b, c] for a, b, c in zip(q, q[1:], s[1:], strict=False)]) for q in paths])
        for q, share in zip(paths, p / p.sum(), strict=True):
            start[q[0]] += share
            for a, b in zip(q, q[1:], strict=False):
                move[a, b] += share
            for a, c in zip(q, s, strict=True):
                emit[a, c] += share
    return start, move, emit


def test_expected_counts_are_those_of_all_paths():
    rng = np.random.default_rng(8)
    rows = lambda *shape: (lambda m: m / m.sum(axis=-1, keepdims=True))(rng.random(shape))
    model = hmm.Hmm(rows(3), rows(3, 3), rows(3, 5))
    seqs = [np.array([0, 4, 1, 2, 2, 3]), np.array([2]), np.array([1, 1, 0])]
    _, got = model.forward(seqs, backward=True)
    for a, b in zip(got, brute_counts(model, seqs), strict=True):
        assert np.allclose(a, b, atol=1e-5)


def test_likelihood_of_long_texts_does_not_fall(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "b", "c", "dog", "cat"], p=[0.4, 0.3, 0.1, 0.1, 0.1]) if k // 200 % 2 else rng.choice(["a", "x", "y"]) for k in range(n)) for n in (3000, 5000, 40, 1)]
    docs = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    encoded, _, share, unknown = hmm.encode_corpus(docs)
    like = []
    for n in range(5):
        model = hmm.baum_welch(encoded, share, unknown, n)
        like.append(sum(r["score"] for r in encoded.mapInArrow(lambda b, m=model: hmm.score(b, m), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double").collect()))
    assert all(b > a - 1 for a, b in zip(like, like[1:], strict=False)) and like[-1] > like[0]
    assert sum(r["n_tokens"] for r in encoded.collect()) == 8041 + 4


def test_blocks_change_no_score(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("one two three four five rare%d" % i if k % 9 == 0 else "one two") for k in range(300)), i % 4 == 0) for i in range(12)]
    rows = [(i, t.replace("%", ""), h, "x") for i, t, h in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, word string").coalesce(1)
    whole = sorted(map(tuple, hmm.score_texts(docs).collect()))
    monkeypatch.setattr(hmm, "BLOCK_TOKENS", 500)
    parts = sorted(map(tuple, hmm.score_texts(docs).collect()))
    assert [w[:5] for w in whole] == [p[:5] for p in parts]
    assert all(w[5:] == pytest.approx(p[5:], rel=1e-3) for w, p in zip(whole, parts, strict=True))


def test_ordinal_gradient():
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(40)]
    flat, owner, grade = np.concatenate(rows), np.repeat(np.arange(40), [len(r) for r in rows]), rng.integers(0, 4, 40)
    theta = np.concatenate([rng.normal(size=6), [-0.5, 0.1, -0.3]])
    _, grad = toxicity.likelihood(theta, flat, owner, grade, 3)
    for k in range(len(theta)):
        step = np.zeros_like(theta)
        step[k] = 1e-5
        up, down = (toxicity.likelihood(theta + s * step, flat, owner, grade, 3)[0] for s in (1, -1))
        assert (up - down) / 2e-5 == pytest.approx(grad[k], rel=1e-3, abs=1e-6)


def test_words_that_share_a_long_start_differ():
    a, b = "x" * 24 + "kind", "x" * 24 + "vile"
    assert toxicity.features_of(a) != toxicity.features_of(b) and toxicity.whole_word(a) != toxicity.whole_word(b)
    index = {f: i for i, f in enumerate(sorted(toxicity.features_of("x" * 60 + "vile")))}
    assert toxicity.found("x" * 60 + "vile", {}, index) == set(index.values())


def test_nothing_to_learn_is_undetermined(spark):
    docs = spark.createDataFrame([(1, "ª º", "xx"), (2, None, "yy"), (3, "some text", None)], "doc_id long, text string, lang string")
    net = langid.train(docs.where("doc_id <> 1"))
    assert net is None
    got = docs.select(langid.predictor(spark, net)("text").alias("p")).collect()
    assert {r["p"]["lang_pred"] for r in got} == {"und"}


def test_long_units_are_one_lattice():
    from tidemark.llm import pieces

    vocabulary = pieces.Vocabulary()
    # a unit just over the limit gives the same distribution in logarithms as without
    short, long = pieces.Lattices(vocabulary, ["▁thethe"]), pieces.Lattices(vocabulary, ["▁thethe"], logs=True)
    assert np.allclose(short.share, long.share) and (short.source == long.source).all() and (short.first == long.first).all()
    text = "日本語の文章には空白がない。" * 900 + "x" * 3000
    ids = pieces.encode(vocabulary, [1, 2], [text, text])
    assert all(vocabulary.decode(i) == text for i in ids) and ids[0] != ids[1]
    out = pieces.encoded(vocabulary, [1, None, 2], [text, None, ""])
    assert out.field("lossless").to_pylist() == [True, None, True] and out.field("ids").to_pylist()[0] == ids[0] and out.field("n_pieces").to_pylist()[1] is None


def test_pieces_cross_every_place_of_a_long_unit():
    from tidemark.llm import pieces

    vocabulary = pieces.Vocabulary()
    word = "internationalization"
    ids = pieces.encode(vocabulary, list(range(300)), [word * 4] * 300)
    cut, crossing = len("▁") + 47, 0  # where units used to be cut
    for own in ids:
        at = np.cumsum([len(vocabulary.output[i].decode()) for i in own])
        crossing += cut not in at
    assert crossing > 100


def test_batches_carry_every_token(spark):
    from tidemark.llm import packing, pieces

    rows = [(1, BASE), (2, "short"), (3, None), (4, ""), (5, BASE * 5), (6, "a b c"), (None, "no id here"), (7, "same"), (7, "same"), (7, "other")]
    encoded = pieces.sampled_pieces(frame(spark, rows)).select("doc_id", "ids")
    want = collections.defaultdict(set)
    for r in encoded.collect():
        if r["ids"]:
            want[r["doc_id"]].add(tuple(r["ids"]))
    out = packing.token_batches(encoded, pad_id=0, max_tokens=64, buckets=3, budget=256).collect()
    parts = collections.defaultdict(list)
    for b in out:
        assert len({len(x) for x in b["input_ids"]}) == 1 and len(b["input_ids"]) * b["bucket"] <= 256
        for d, start, n, ids in zip(b["doc_ids"], b["starts"], b["n_tokens"], b["input_ids"], strict=True):
            assert len(ids) == b["bucket"] and not any(ids[n:])
            parts[d].append((start, tuple(ids[:n])))
    for d, texts in want.items():
        assert sum(len(p) for _, p in parts[d]) == sum(map(len, texts))
        if len(texts) == 1:
            assert sum((p for _, p in sorted(parts[d])), ()) == next(iter(texts))
