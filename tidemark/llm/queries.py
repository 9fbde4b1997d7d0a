"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.balltree import OP6_SQL, op6_topk
from tidemark.llm.curves import op11_neighbours
from tidemark.llm.hmm import op7_hmm
from tidemark.llm.hostpaths import op8_main_text
from tidemark.llm.langid import op2_language
from tidemark.llm.lcp import op1_fingerprints
from tidemark.llm.linededup import op5_lines
from tidemark.llm.manifest import OP12_SQL, op12_manifest
from tidemark.llm.minhash import op4_minhash
from tidemark.llm.packing import op3_packing
from tidemark.llm.pieces import op9_pieces
from tidemark.llm.threshold import OP13_SQL, op13_ranked
from tidemark.llm.toxicity import op10_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_language": op2_language,
        "op3_packing": op3_packing,
        "op4_minhash": op4_minhash,
        "op5_lines": op5_lines,
        "op6_topk": op6_topk,
        "op7_hmm": op7_hmm,
        "op8_main_text": op8_main_text,
        "op9_pieces": op9_pieces,
        "op10_toxicity": op10_toxicity,
        "op11_neighbours": op11_neighbours,
        "op12_manifest": op12_manifest,
        "op13_ranked": op13_ranked,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_topk": OP6_SQL, "op12_manifest": OP12_SQL, "op13_ranked": OP13_SQL}
