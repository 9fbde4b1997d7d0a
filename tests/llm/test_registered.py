"""Every registered query over whole tables against its contract: rows, columns and what plain code says of them."""

import collections
import math
import re
from hashlib import sha256
from zlib import crc32

import pytest
from test_pages import plain
from test_text_operators import brute_components, brute_lines, shingles

from tidemark.llm import pieces, toxicity
from tidemark.llm.queries import queries

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^ \t-\r]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return queries()[name](spark, SF).collect()


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_op1_fingerprints(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op1_fingerprints")}
    order = sorted(docs)
    assert sorted(got) == order
    for d, nxt in zip(order, [*order[1:], order[0]], strict=True):
        text, n = docs[d] or "", len(docs[d] or "")
        edited = text[: n - n // 4] + (docs[nxt] or "")[: n // 4]
        r = got[d]
        assert r["n_chars"] == n and r["edited_sha256"] == sha256(edited.encode()).hexdigest() and 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    assert len({r["fingerprint"] for r in got.values()}) == len({t or "" for t in docs.values()})


def test_op3_packing(spark, docs):
    got, tokens, taken = run(spark, "op3_packing"), collections.Counter(), collections.Counter()
    for r in got:
        tokens[r["doc_id"]] += r["n_tokens"]
        taken[r["bucket"], r["batch"], r["slot"]] += 1
        assert 0 < r["n_tokens"] <= r["bucket"] and (r["slot"] + 1) * r["bucket"] <= max(16_384, r["bucket"])
    assert tokens == {d: len(WORDS.findall(t or "")) + 1 for d, t in docs.items()} and set(taken.values()) == {1}


def test_op4_minhash(spark, docs):
    want = brute_components(list(docs.items()))
    assert {r["doc_id"]: (r["component_id"], r["kept"], r["n_shingles"]) for r in run(spark, "op4_minhash")} == {d: (want[d], want[d] == d, len(shingles(t))) for d, t in docs.items()}


def test_op5_lines(spark, docs):
    assert collections.Counter((r["doc_id"], r["line_no"], r["n_links"], r["kept"]) for r in run(spark, "op5_lines")) == brute_lines(list(docs.items()))


def test_op7_hmm(spark, docs):
    words = {d: [*WORDS.findall(lowered(t)), "\n"] for d, t in docs.items()}
    held = {d: crc32(str(d).encode()) % 10 == 0 for d in docs}
    count = collections.Counter(w for d, x in words.items() if not held[d] for w in x)
    total, distinct = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in run(spark, "op7_hmm")}
    assert sorted(got) == sorted(docs)
    for d, x in words.items():
        r = got[d]
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in x)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(x), sum(count[w] > 0 for w in x), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # context tells something


def test_op8_main_text(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    got = run(spark, "op8_main_text")
    assert {r["page_id"]: r["text"] for r in got} == plain(rows) and all(r["n_chars"] == len(r["text"]) for r in got) and all(r["text"] for r in got)


def test_op9_pieces(spark, docs):
    got, vocabulary = {r["doc_id"]: r for r in run(spark, "op9_pieces")}, pieces.Vocabulary(pieces.MODEL)
    assert sorted(got) == sorted(docs)
    for d, text in docs.items():
        r = got[d]
        assert (r["ids"] is None) == (text is None) and (text is None or r["lossless"] and r["n_pieces"] == len(r["ids"]) and vocabulary.decode(r["ids"]) == text)


def test_op10_toxicity(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op10_toxicity")}
    model = toxicity.model_for(spark, SF)
    assert sorted(got) == sorted(docs)
    for d, text in docs.items():
        held = sorted({model.index[f] for w in toxicity.words(text) for f in toxicity.features_of(w) if f in model.index})
        over = model.exceed([model.weights[held].sum() if held else 0.0])[0]
        edges = [1.0, *over, 0.0]
        shares = [a - b for a, b in zip(edges, edges[1:], strict=False)]
        r = got[d]
        assert r["p_toxic"] == pytest.approx(over[0]) and r["expected_severity"] == pytest.approx(over.sum()) and r["toxic"] == (r["p_toxic"] > 0.5)
        assert r["grade"] == max(range(len(shares)), key=lambda g: (shares[g], -g))


@pytest.mark.parametrize("name", ["op2_language", "op6_topk", "op11_neighbours", "op12_manifest", "op13_ranked"])
def test_columns_of_the_others(spark, name):
    want = {
        "op2_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op6_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
        "op11_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
        "op12_manifest": dict.fromkeys(("leaf", "subroot", "root", "proof_sha256", "folded_root"), "string") | {"doc_id": "bigint", "verified": "boolean"},
        "op13_ranked": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    }[name]
    assert want.items() <= dict(queries()[name](spark, SF).dtypes).items()
