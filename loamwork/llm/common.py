"""Shared pieces of the training-data operators: ids, staging, size-checked joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A side is broadcast only after its rows were counted and are at most this many.
BROADCAST_ROWS = 20_000
#: The same for a side of one long a row.
BROADCAST_IDS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: spark.checkpoint.dir.

    Where that is unset, a local session gets a folder of its own; a cluster must name one,
    as its executors don't see each other's disks.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="loamwork-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def staged(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_by_hash(df: DataFrame, cols: list[str], n: int, by: str) -> DataFrame:
    """At most n distinct rows of cols, half of them of each value of the boolean `by`: those of
    least hash.

    Copies count once, so what is chosen follows the different rows and not how often each
    stands.  Only hashes below a bound go on: it lets through about four times what is asked
    for of each value, and is widened if fewer came.  What the tasks hand on follows n and not
    their number, and it is the same on every run.
    """
    h = F.xxhash64(*cols)
    rows = df.select(*cols, h.alias("__h"))
    half = max(n // 2, 1)
    there = {r[0]: r[1] for r in rows.filter(F.col(by).isNotNull()).groupBy(by).agg(F.approx_count_distinct("__h", 0.02)).collect()}
    chosen = None
    for value, different in sorted(there.items()):
        own, share = rows.filter(F.col(by) == value), 4 * half / max(different, 1)
        while True:
            near = own.filter(F.col("__h") < F.lit(int(-(1 << 63) + (1 << 64) * share))) if share < 1 else own
            near = near.distinct()
            if share >= 1 or near.count() >= half:
                break
            share *= 4
        near = near.orderBy("__h", *cols).limit(half).select(*cols)
        chosen = near if chosen is None else chosen.unionByName(near)
    return chosen if chosen is not None else rows.limit(0).select(*cols)


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join with a staged side: broadcast it if its counted rows are few, else sort-merge.

    Keys compare null-safe.  `small` must be cheap to read again (see `staged`).
    """
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    renamed = small.select(*[F.col(c).alias(f"__k_{c}") if c in on else F.col(c) for c in small.columns])
    side = renamed.hint("broadcast" if few else "merge")
    cond = None
    for c in on:
        one = big[c].eqNullSafe(side[f"__k_{c}"])
        cond = one if cond is None else cond & one
    return big.join(side, cond, how).drop(*[f"__k_{c}" for c in on])


def ids_serve(rows: DataFrame, id_col: str = "doc_id") -> bool:
    """True if no id is null and none is repeated."""
    return not rows.groupBy(id_col).count().filter(F.col(id_col).isNull() | (F.col("count") > 1)).limit(1).take(1)


def in_order(rows: DataFrame, id_col: str, *more: str) -> DataFrame:
    """Rows dealt by range in order of id (nulls first), a hash of the text (and `more`), then these.

    Ranges are found from a sample of short keys.  The last key only splits equal rows, so
    that a third of all rows with one id and one text doesn't meet in one task.
    """
    row = fresh(rows, "__row")
    tie, apart = F.xxhash64("text", *more), F.xxhash64(F.col(row))
    keyed = rows.withColumn(row, F.monotonically_increasing_id())
    return keyed.repartitionByRange(id_col, tie, apart).sortWithinPartitions(id_col, tie, "text", *more).drop(row)


def doc_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """((rid, text), named): rid is a unique long in ascending doc_id order; named puts
    doc_id back in the place of rid.

    Where the ids are unique and present they serve as they are.  Otherwise (null or
    repeated ids) the rows are put in order of id (nulls first), a hash of the text, then text,
    and numbered;
    equal rows are numbered in turn, so each counts as a document of its own.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if ids_serve(d):
        return d.withColumnRenamed("doc_id", "rid"), lambda out: out.withColumnRenamed("rid", "doc_id")
    rows = in_order(d, "doc_id")
    rows = staged(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "docrows")
    names = rows.select(F.col("rid").alias("rid2"), "doc_id")

    def named(out: DataFrame) -> DataFrame:
        return out.join(names.hint("merge"), F.col("rid") == F.col("rid2")).select("doc_id", *[c for c in out.columns if c != "rid"])

    return rows.select("rid", "text"), named


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def with_rid(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """(docs with a unique column, its name): the id itself, or a number where ids are null or repeated."""
    rid = fresh(docs, "__rid")
    if ids_serve(docs, id_col):
        return docs.withColumn(rid, F.col(id_col).cast("long")), rid
    return staged(in_order(docs, id_col).withColumn(rid, F.monotonically_increasing_id()), "rids"), rid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
