"""The network that scores documents against a plain loop, over segments of any length."""

import math

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import langid


def plain(net, segment):
    """The sum of the language probabilities over a segment's positions, unit by unit."""
    H, w = net.hidden, {k: v.astype(np.float64) for k, v in net.w.items()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def states(d):
        h, out = np.zeros(H), []
        for byte in segment if d == "f" else segment[::-1]:
            a, g = w["x" + d][byte] + w["b" + d], h @ w["u" + d]
            z = np.array([sigmoid(v) for v in a[:H] + g[:H]])
            r = np.array([sigmoid(v) for v in a[H : 2 * H] + g[H : 2 * H]])
            h = (1 - z) * np.tanh(a[2 * H :] + r * g[2 * H :]) + z * h
            out.append(h)
        return out if d == "f" else out[::-1]

    total = np.zeros(len(net.languages))
    for f, b in zip(states("f"), states("b"), strict=True):
        e = np.exp(np.concatenate([f, b]) @ w["o"] + w["c"])
        total += e / e.sum()
    return total


@pytest.fixture(scope="module")
def net():
    made = langid.BiGru(["x", "y", "z"], seed=4, hidden=5)
    made.w = {k: v * 2 for k, v in made.w.items()}
    return made


@pytest.mark.parametrize("sizes", [[1], [3, 1, 1024, 7, 7], [1025], [1024 * 2], [2100, 1025, 300, 2048, 1, 1500]])
def test_pooled_like_a_plain_loop(net, monkeypatch, sizes):
    monkeypatch.setattr(langid, "LONG_STRETCH", 512)
    monkeypatch.setattr(langid, "POOLED_BYTES", 4_000)
    rng = np.random.default_rng(sum(sizes))
    found = [bytes(rng.integers(97, 123, n).tolist()) for n in sizes]
    want = np.array([[*plain(net, s), len(s)] for s in found])
    assert np.allclose(net.pooled_long(found), want, rtol=1e-4, atol=1e-3)
    assert np.allclose(net.pooled(found), want, rtol=1e-4, atol=1e-3)


def test_scores_like_the_network_position_by_position(net):
    x = np.frombuffer(b"some words of it", np.uint8)[None, :]
    assert np.allclose(net.probabilities(x)[:, 0].sum(axis=0), plain(net, bytes(x[0])), rtol=1e-4)


def test_segments_of_any_length_and_script():
    assert langid.segments("One two. THREE\nfour!") == [b"one two", b"three", b"four"]
    wide = "日本語です。" * 3
    assert len(langid.segments(wide)) == 3 and not langid.long_segments(wide)
    long = "wort " * 5_000
    assert langid.segments(long) == langid.long_segments(long) == [b" ".join([b"wort"] * 5_000)]
    assert all(len(s) <= langid.EXAMPLE_BYTES for s in langid.examples(long))


def test_long_texts_without_ends_are_read_whole(spark):
    say = {"aa": "abra kadabra ", "bb": "xyloz qwozy "}
    rows = [(k, (say[lang] * 30 + ". ") * 3, lang) for k in range(60) for lang in say]
    rows += [(1000, say["aa"] * 40_000, None), (1001, say["bb"] * 20_000 + say["aa"] * 2_000, None), (1002, "漢字 " * 300, None), (1003, "12 34", None), (1004, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(docs)
    got = {r["doc_id"]: r["p"] for r in docs.where("doc_id >= 1000").select("doc_id", langid.predictor(spark, net)("text").alias("p")).collect()}
    assert got[1000]["lang_pred"] == "aa" and got[1000]["score"] > 0.9
    assert got[1001]["lang_pred"] == "bb" and got[1001]["score"] > 0.7
    assert got[1002]["lang_pred"] in ("aa", "bb") and got[1003]["lang_pred"] == got[1004]["lang_pred"] == "und" and got[1004]["score"] == 0
    sums = langid.long_sums(net, pa.array([r[1] for r in rows]))
    assert all(abs(v[:-1].sum() - v[-1]) < 1e-3 * v[-1] for v in sums.values())
