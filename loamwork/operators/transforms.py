"""Projections, filters and row-wise transforms."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import missing as M


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Old names to new; unknown old names are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def translate_condition(text: str) -> str:
    """A data-frame query string as Spark SQL: &, |, ~, ==, membership in a bracketed list."""
    text = re.sub(r"\bin\s*\[([^\]]*)\]", r"in (\1)", text)
    text = re.sub(r"&&?", " and ", text)
    text = re.sub(r"\|\|?", " or ", text)
    return re.sub(r"~(?=\s*\()", " not ", text)


def filter_rows(df: DataFrame, condition: str) -> DataFrame:
    return df.filter(translate_condition(condition))


def select(df: DataFrame, columns: list[str]) -> DataFrame:
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return df.select(*columns)


def cast(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Per column all or nothing: a column with a value that doesn't convert stays as it is.

    One aggregate over all columns decides.
    """
    types = {c: t for c, t in types.items() if c in df.columns}
    if not types:
        return df
    bad = df.agg(*[F.sum((F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).cast("long")).alias(f"b{i}") for i, (c, t) in enumerate(types.items())]).first()
    return df.withColumns({c: F.col(c).try_cast(t) for i, (c, t) in enumerate(types.items()) if not bad[i]})


def custom(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return df.transform(fn)


def sample_by_hash(df: DataFrame, key_cols: list[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """n rows of least hash: the same rows on every run, by a bounded top-n on each task."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols])), *key_cols).limit(n)


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(fraction=fraction, seed=seed)


def add_constants(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def drop_sparse_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Columns with a share of missing cells above the threshold go; one aggregate."""
    shares = df.agg(*[F.avg(M.is_missing(df, c).cast("double")).alias(f"s{i}") for i, c in enumerate(df.columns)]).first()
    return df.drop(*[c for i, c in enumerate(df.columns) if shares[i] is not None and shares[i] > threshold])


def drop_missing(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return M.normalize(df).na.drop(subset=subset)


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return M.normalize(df).na.drop("all")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    return drop_sparse_columns(df, threshold=1 - 1e-12)


def remove_infinite(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Rows with an infinity go; missing values stay."""
    for c in columns or M.floats(df):
        df = df.filter(F.col(c).isNull() | ~F.col(c).isin(float("inf"), float("-inf")))
    return df


def explode_documents(docs: DataFrame, chunks: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Documents as rows of type chunk where chunked, of type full where not, plus table rows."""
    chunk_rows = chunks.select("doc_id", F.lit("chunk").alias("type"), "chunk_index", F.col("content"))
    whole = docs.join(chunks.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti").select("doc_id", F.lit("full").alias("type"), F.lit(None).cast("long").alias("chunk_index"), F.col("text").alias("content"))
    out = chunk_rows.unionByName(whole)
    return out if tables is None else out.unionByName(tables.withColumn("type", F.lit("table")), allowMissingColumns=True)


#: Text columns in order of preference.
TEXT_ORDER = ("enhanced_content", "text_content", "content", "text")


def text_column(df: DataFrame, order=TEXT_ORDER):
    found = [F.col(c) for c in order if c in df.columns]
    if not found:
        raise ValueError("no text column")
    return F.coalesce(*found)


def long_texts(df: DataFrame, least: int = 50) -> DataFrame:
    """Rows whose first available text isn't blank and is longer than `least` characters."""
    c = text_column(df)
    return df.withColumn("long_text", c).filter((F.trim(c) != "") & (F.length(c) > least))
