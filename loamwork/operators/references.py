"""Which columns refer to which: inclusion dependencies found from the values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.writers import staged

KINDS = {T.ByteType: "number", T.ShortType: "number", T.IntegerType: "number", T.LongType: "number", T.StringType: "text", T.DateType: "day"}
CAST = {"number": "long", "text": "string", "day": "date"}


def column_values(tables: dict[str, DataFrame]) -> DataFrame:
    """(col, kind, h, n): the different non-null values of every whole-number, text and date column, by
    128 bits of hash, with their rows; col is table.column."""
    parts = []
    for name, df in tables.items():
        cols = [(f.name, KINDS[type(f.dataType)]) for f in df.schema if type(f.dataType) in KINDS]
        value = lambda c, kind: F.struct(F.lit(f"{name}.{c}").alias("col"), F.lit(kind).alias("kind"), F.when(F.col(f"`{c}`").isNotNull(), F.md5(F.col(f"`{c}`").cast(CAST[kind]).cast("string"))).alias("h"))  # noqa: B023, E731
        if cols:
            parts.append(df.select(F.explode(F.array(*[value(c, k) for c, k in cols])).alias("x")).select("x.*").filter("h IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts).groupBy("col", "kind", "h").agg(F.count("*").alias("n"))


def inclusions(tables: dict[str, DataFrame], least: float = 0.95) -> DataFrame:
    """(child, parent, n_values, n_found, coverage): pairs of columns where at least `least` of the
    child's different values stand in the parent, and the parent holds no value twice.

    Every value is sent once to where the columns that hold it meet; what goes on from there is the
    set of columns and not the value, and equal sets are counted before pairs are made of them.
    So rows of pairs follow the different sets, which are few, and no table is joined with another.
    """
    values = staged(column_values(tables), "values")
    sizes = staged(values.groupBy("col").agg(F.count("*").alias("n_values"), (F.max("n") == 1).alias("is_key")), "sizes")
    holders = values.groupBy("kind", "h").agg(F.array_sort(F.collect_list("col")).alias("cols"))  # one entry a column
    sets = holders.groupBy("cols").agg(F.count("*").alias("n"))
    child = sets.select(F.explode("cols").alias("child"), "cols", "n")
    both = child.select("child", F.explode("cols").alias("parent"), "n").filter("child <> parent")
    found = both.groupBy("child", "parent").agg(F.sum("n").alias("n_found"))
    of_child = sizes.select(F.col("col").alias("c"), "n_values").hint("merge")
    keys = sizes.filter("is_key").select(F.col("col").alias("p")).hint("merge")
    d = found.join(of_child, F.col("child") == F.col("c")).join(keys, F.col("parent") == F.col("p"), "left_semi")
    return d.withColumn("coverage", F.col("n_found") / F.col("n_values")).filter(F.col("coverage") >= least).select("child", "parent", "n_values", "n_found", "coverage")
