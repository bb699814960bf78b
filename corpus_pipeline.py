"""Corpus pipeline: documents to token files, one operator of loamwork.llm per stage.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read again as the next one's docs.  All but the last return the
columns of documents.  run() does the same with the shared folder of the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamwork.llm import fm_index, mixing, quality_crf, simhash, token_file
from loamwork.llm.common import staged, table

#: The line labels come out of a trained model, which SQL can't express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return quality_crf.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of 5-word shingles, that of the smallest doc_id stays."""
    return simhash.one_of_each(docs, words=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows contaminate go."""
    return fm_index.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document stands as often as the mix takes it."""
    return mixing.mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and per document what is read back from them."""
    return token_file.token_table(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what its predecessor kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
