"""Substring search over a posting table of trigrams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.writers import staged

#: Lists of so many of a pattern's rarest trigrams are read.
LISTS = 4
#: So many candidates are looked up by their ids; more are joined.
LOOKED_UP = 2000


def _grams(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: list({t[i : i + 3] for i in range(len(t) - 2)}), na_action="ignore")


def grams(x):
    """The different trigrams of a text in lower case."""
    return F.pandas_udf(_grams, "array<string>")(F.lower(x))


def write_index(df: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """Postings (gram, id), in order, and the length of each list, below path.

    Files hold ranges of (gram, id), so that a list is found by the statistics of the row groups, and a
    very common trigram's is spread over many files.
    """
    spark = df.sparkSession
    # written out, as the ranges are cut from a pass of their own over the rows
    lists = staged(df.filter(F.length(text_col) > 2).select(grams(F.col(text_col)).alias("grams"), F.col(id_col).alias("id")), "grams")
    rows = lists.select(F.explode("grams").alias("gram"), "id")
    rows.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.option("parquet.block.size", 4 << 20).parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/lists")


def candidates(spark: SparkSession, path: str, text: str) -> DataFrame | None:
    """(id) of the texts that hold the pattern's rarest trigrams; None if it has no trigram."""
    wanted = sorted({text.lower()[i : i + 3] for i in range(len(text.lower()) - 2)})
    if not wanted:
        return None
    sizes = {r.gram: r.n for r in spark.read.parquet(f"{path}/lists").filter(F.col("gram").isin(wanted)).collect()}  # one row a trigram of the pattern
    postings = spark.read.parquet(f"{path}/postings")
    if len(sizes) < len(wanted):
        return postings.limit(0).select("id")
    rare = sorted(wanted, key=sizes.get)[:LISTS]
    return postings.filter(F.col("gram").isin(rare)).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(rare)).select("id")


def search_index(df: DataFrame, id_col: str, text_col: str, path: str, text: str) -> DataFrame:
    """Rows of df, as it was indexed under path, whose text holds `text` in any case.

    Candidates come from the posting lists and are verified on the text; few are read by their ids,
    which the scan can skip to.  Patterns of less than three letters are looked for in every text.
    """
    holds = F.contains(F.lower(F.col(text_col)), F.lit(text.lower()))
    ids = candidates(df.sparkSession, path, text)
    if ids is None:
        return df.filter(holds)
    few = [r.id for r in ids.limit(LOOKED_UP + 1).collect()]
    if len(few) <= LOOKED_UP:
        return df.filter(F.col(id_col).isin(few)).filter(holds)
    return df.join(ids.withColumnRenamed("id", "__id").hint("merge"), F.col(id_col) == F.col("__id"), "left_semi").filter(holds)
