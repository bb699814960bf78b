"""Orders, batches, top lists, unions and searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mark_repeats(df: DataFrame, columns: list[str], order_cols: list[str]) -> DataFrame:
    """is_repeat: a row after the first (by order_cols) of its group."""
    if not order_cols:
        raise ValueError("mark_repeats needs order_cols")
    return df.withColumn("is_repeat", F.row_number().over(Window.partitionBy(*columns).orderBy(*order_cols)) > 1)


def first_per_group(df: DataFrame, columns: list[str], order_cols: list, n: int = 1) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*columns).orderBy(*order_cols))
    return df.withColumn("rank", rn.cast("long")).filter(F.col("rank") <= n)


def batches(df: DataFrame, size: int, order_cols: list[str], group_cols: list[str] | None = None) -> DataFrame:
    """batch_index (from 0) and batch_total: groups of `size` rows in order.

    Positions are computed range by range, within groups too, so no task holds all rows of one.
    """
    from .joins import positioned, ranked

    if group_cols:
        d = ranked(df, group_cols, order_cols)
        return d.withColumns({"batch_index": F.floor((F.col("__pos") - 1) / size).cast("long"), "batch_total": F.ceil(F.col("__size") / size).cast("long")}).drop("__pos", "__size")
    d = positioned(df, order_cols)
    total = F.broadcast(df.agg(F.ceil(F.count("*") / size).cast("long").alias("batch_total")))  # one row
    return d.withColumn("batch_index", F.floor((F.col("__pos") - 1) / size).cast("long")).drop("__pos").crossJoin(total)


def latest(df: DataFrame, keys: list[str], value: str, by: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, by).alias(value))


def newest(df: DataFrame, by: str, n: int, skip: int = 0, tie: list[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(by), *tie).offset(skip).limit(n)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows by column name; what a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.toDF(*f.columns) for f in frames])


def distinct(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropDuplicates(columns) if columns else df.dropDuplicates()


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with the text in any of the columns, ignoring case."""
    safe = text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{safe}%") for c in columns]))
