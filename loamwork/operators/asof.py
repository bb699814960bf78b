"""As-of join: each row with the last row of another table at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import work_path


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, suffix: str = "_asof") -> DataFrame:
    """Every row of left with the columns of the last row of right that has its keys and isn't later.

    Right's columns (but for the keys) get the suffix; without such a row they are null.  Of
    right rows at one time, that with the greatest other columns counts.  Null keys match
    nothing, null times come before all and match nothing.

    Both tables are laid out in ranges of (keys, time).  Within a range the last right row
    is carried forward; what a range that begins inside a key takes over from the ones before
    comes from one row a range.  So neither a key of very many rows nor one of the tables must fit
    in a task.
    """
    others = [c for c in right.columns if c not in keys]
    kept = [c for c in others if c != right_time]
    value = F.struct(F.col(right_time).alias(right_time), *[F.col(c) for c in kept])
    r = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), value.alias("__right"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__left"))
    r = r.filter(F.col("__t").isNotNull()).dropna(subset=keys)
    one = left.select(*keys, F.col(left_time).cast(right.schema[right_time].dataType).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__right"].dataType).alias("__right"), F.struct("*").alias("__left"))
    path = work_path(left, "asof")
    order = [*keys, "__t", "__side"]
    r.unionByName(one).repartitionByRange(*order, "__right").withColumn("__p", F.spark_partition_id()).write.parquet(path)
    rows = left.sparkSession.read.parquet(path)
    inside = Window.partitionBy("__p", *keys).orderBy("__t", "__side", "__right").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__got", F.last("__right", ignorenulls=True).over(inside))
    # one row a range and key that it ends or begins with
    key = F.struct(*keys)
    ends = left.sparkSession.read.parquet(path).groupBy("__p").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    tails = rows.join(F.broadcast(ends.select(F.col("__p").alias("p2"), "hi")), (F.col("__p") == F.col("p2")) & key.eqNullSafe(F.col("hi"))).groupBy(F.col("__p").alias("tail"), "hi").agg(F.max(F.struct("__t", "__right")).alias("m"), F.max(F.when(F.col("__right").isNotNull(), F.struct("__t", "__right"))).alias("best"))
    heads = ends.select(F.col("__p").alias("head"), "lo")
    carried = heads.join(F.broadcast(tails), (F.col("tail") < F.col("head")) & F.col("lo").eqNullSafe(F.col("hi"))).groupBy("head", "lo").agg(F.max("best")["__right"].alias("__carry"))
    carried = F.broadcast(carried)  # at most one row a range
    rows = rows.filter("__side = 1").join(carried, (F.col("__p") == F.col("head")) & key.eqNullSafe(F.col("lo")), "left")
    got = F.coalesce("__got", "__carry")
    return rows.select("__left.*", *[got[c].alias(c + suffix) for c in others])
