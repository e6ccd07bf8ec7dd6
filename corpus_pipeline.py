"""The corpus pipeline: rejects poor and toxic documents, keeps one of each near-duplicate group, packs the rest.

In every stage a null text counts as empty, texts of any length are read whole, an empty table gives an empty one, and
columns besides id, text and source are carried along unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenpass.llm import packing, quality, simhash, toxicity
from lumenpass.llm.common import documents, written
from lumenpass.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the line field scores at least 0.5, fitted on the labels of those given.

    Empty and null texts have a score like any others (one empty line). Repeated rows share their fate; rows without an
    id are scored, but never used for fitting. Without labels of both kinds all score alike: 0.5 or more if none is 0.
    """
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below 0.5 for toxicity, fitted on the labels of those given.

    Empty and null texts have a score like any others. Repeated rows share their fate; rows without an id are scored,
    but never used for fitting. Without labels of both kinds all score alike: below 0.5 unless all are 1.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by fingerprints the document with the smallest id.

    Null, empty and blank texts are one group. Of repeated rows one stays; rows that share an id, or have none, are
    judged by their texts: each group keeps one row, that of the smallest id, then fingerprint, then hash of the text.
    """
    return simhash.keep_one_of_each(docs, radius=4)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its bin of 4096 tokens.

    A null or empty text is one piece of no tokens, a text of more than 4096 tokens several pieces. Repeated rows are
    packed each; texts equal but for case never share a bin; a null source never conflicts.
    """
    return packing.pack_documents(docs, vocabulary("piece_bpe_32k.model"), capacity=4096)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: Fitted models and sequential packing can't be said in SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
