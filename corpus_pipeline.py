"""A corpus pipeline of five operators; each stage works on what the stage before it kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import stage, table
from tidemark.llm.langid import keep_identified
from tidemark.llm.linededup import drop_repeated_lines
from tidemark.llm.minhash import keep_one_of_each
from tidemark.llm.packing import pack
from tidemark.llm.toxicity import drop_toxic, model_for
from tidemark.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined or doubtful go."""
    ship(spark)
    return keep_identified(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of predicted severity over 0 go; the model learns from the labels."""
    return drop_toxic(docs, model_for(spark, sf_dir))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, exactly or nearly, leave the texts; emptied documents go."""
    ship(spark)
    return drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, by the texts as they are now and as they came."""
    ship(spark)
    return keep_one_of_each(docs, table(spark, sf_dir, "documents"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all that is left in padded batches."""
    ship(spark)
    return pack(docs)


STAGES = [("language", language), ("toxicity", toxicity), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", packing)]

#: Trained networks, an edit join and components of a graph aren't SQL; the tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, writing what each keeps and reading it again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        docs = stage(docs, name) if k < len(STAGES) - 1 else docs
    return docs
