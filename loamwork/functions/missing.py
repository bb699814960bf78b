"""What counts as missing, and classes of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Logical types a Spark column may be declared as.
LOGICAL = {
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType, T.DecimalType),
    "boolean": (T.BooleanType,),
    "string": (T.StringType,),
    "datetime": (T.DateType, T.TimestampType, T.TimestampNTZType),
    "object": (T.StructType, T.MapType),
    "array": (T.ArrayType,),
}


def floats(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def logical_type(kind: T.DataType) -> str:
    return next((name for name, kinds in LOGICAL.items() if isinstance(kind, kinds)), "object")


def normalize(df: DataFrame) -> DataFrame:
    """NaN becomes null: the one notion of missing all operators share."""
    cols = floats(df)
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in cols}) if cols else df


def is_missing(df: DataFrame, name: str):
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if name in floats(df) else c.isNull()


def long_rows(one_row: DataFrame, names: list[str], metrics: dict[str, str], key: str = "column_name") -> DataFrame:
    """One row of `metric__i` columns to one row per name; metrics maps output name to SQL type."""
    rows = F.array(*[F.struct(F.lit(n).alias(key), *[F.col(f"{m}__{i}").cast(t).alias(m) for m, t in metrics.items()]) for i, n in enumerate(names)])
    return one_row.select(F.explode(rows).alias("r")).select("r.*")
