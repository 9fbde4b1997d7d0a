"""The pipeline's stages on the smallest tables: what each drops, and that columns stay."""

from pathlib import Path

import corpus_pipeline
from oracle import difference
from test_text_operators import brute_components, brute_lines

from tidemark import storage
from tidemark.llm import linededup, minhash
from tidemark.llm import queries as registered

SF = "/root/testdata/sf0.001"


def brute_either(now, then):
    """Components of documents that share a group now or then."""
    out = {d: d for d in now}
    moved = True
    while moved:
        moved = False
        for groups in (now, then):
            least = {}
            for d, c in groups.items():
                least[c] = min(least.get(c, d), out[d])
            for d, c in groups.items():
                if least[c] < out[d]:
                    out[d], moved = least[c], True
    return out


def test_what_came_counts_only_for_its_own_document(spark):
    """Texts that aren't what is left of the document of that id are judged as they are."""
    text = lambda k: "\n".join(f"line {k} of the text number {i} here" for i in range(30))
    came = spark.createDataFrame([(1, text(1)), (2, text(1) + "\nmore"), (3, text(3)), (4, text(3) + "\nmore"), (5, text(5)), (5, text(6)), (6, text(5)), (None, text(5))], "doc_id long, text string")
    docs = [(1, text(1), 9), (2, "more", 9), (3, text(3), 9), (4, "other words", 9), (5, "line 5 of the text number 1 here", 9), (6, text(5), 9), (7, "more", 9)]
    out = minhash.keep_one_of_each(spark.createDataFrame(docs, "doc_id long, text string, component long"), came)
    # 2 came as a copy of 1, and 7 is a copy of 2; 4 is another text than the one of that id; two texts came as 5
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4, 5, 6] and out.columns == ["doc_id", "text", "component"]


def test_stages(spark):
    originals = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, function in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = function(spark, docs, SF)
        assert out.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert 0 < len(after) <= len(before)
        if name == "near_duplicates":
            came = [(d, originals[d]) for d, _ in before]
            want = brute_either(brute_components(before), brute_components(came))
            assert set(after) == {d for d in want if want[d] == d} and len(after) < sum(d == c for d, c in brute_components(before).items())
        if name == "lines":
            kept = {(d, i) for (d, i, _, k) in brute_lines(before) if k}
            for d, text in before:
                own = [line for i, line in enumerate(text.split("\n")) if (d, i) in kept] if text else []
                assert after.get(d, "") == "\n".join(own) or not "".join(own).strip()
        docs = spark.createDataFrame(out.collect(), out.schema)
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in final.collect()} == {r["doc_id"] for r in docs.collect()}


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_sql_of_exact_search(spark):
    assert not difference(registered.queries()["op6_topk"](spark, SF), registered.oracle_sql()["op6_topk"], SF)


def test_intermediate_tables_of_texts_do_not_stay(spark):
    """pipeline: every table that a stage had written stayed on disk until the end of the run."""
    shared = Path(storage.shared_dir(spark).removeprefix("file://"))
    there = set(shared.iterdir())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, lines = minhash.near_duplicates(docs), linededup.judged_lines(docs)
    left = {p.name.split("-")[0] for p in set(shared.iterdir()) - there}
    assert not left & {"classes", "banded", "dealt", "members", "rest", "distinctlines", "pairs", "firsts", "linelinks"} and {"signed", "names", "lines"} <= left
    assert kept.count() == docs.count() and lines.where("kept").count() > 0
