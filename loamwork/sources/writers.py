"""Sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def work_path(df: DataFrame, label: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir.

    Where that is unset, a local session gets a folder of its own; a cluster must name one.
    """
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="loamwork-")
        spark.sparkContext.setCheckpointDir(where)
    return f"{where}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: df as a table in the shared folder, read back."""
    path = work_path(df, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_records(df: DataFrame, path: str, mode: str = "error") -> None:
    """A JSON file for each row.  Tasks put their files in place themselves, or the driver would move one after another at the end."""
    df.write.mode(mode).option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").json(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "error", metadata: dict[str, str] | None = None) -> None:
    """Parquet, snappy; metadata becomes a table of its own beside it.

    Rows of a partition value meet in few tasks first, hot values in several, so that files
    are neither many nor huge.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode(mode).option("compression", "snappy")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    if metadata:
        df.sparkSession.createDataFrame(list(metadata.items()), "key string, value string").withColumn("written", F.current_timestamp()).coalesce(1).write.mode(mode).parquet(path.rstrip("/") + "_metadata")


def write_jdbc(df: DataFrame, url: str, table: str, tasks: int = 8, types: str | None = None, mode: str = "error", properties: dict[str, str] | None = None) -> None:
    """A table over JDBC through at most `tasks` connections; `types` overrides column types of a new table."""
    w = df.write.mode(mode).format("jdbc").options(url=url, dbtable=table, numPartitions=str(tasks), **(properties or {}))
    (w.option("createTableColumnTypes", types) if types else w).save()
