"""Jobs over streams; each also takes a batch table where its operators allow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pii_masking


def timed(df: DataFrame, column: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Event time as TIMESTAMP (zone-less times are UTC) with a watermark."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def checked_ingest(df: DataFrame, rules: dict[str, str], text_cols: list[str] = (), redact: bool = False) -> DataFrame:
    """failed_rules of every row, PII flags of text columns, and redaction if asked; no state."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(F.expr(cond), F.lit(False)), F.lit(name)) for name, cond in rules.items()]), lambda x: x.isNotNull())
    df = df.withColumn("failed_rules", F.array_join(failed, ","))
    if text_cols:
        df = pii_masking.flag(df, list(text_cols))
        df = pii_masking.redact(df, list(text_cols)) if redact else df
    return df


def deduplicated(df: DataFrame, keys: list[str], column: str = "ts", delay: str = "1 hour") -> DataFrame:
    """One row per key within the watermark; state is let go behind it."""
    d = timed(df, column, delay)
    return d.dropDuplicatesWithinWatermark(keys) if d.isStreaming else d.dropDuplicates(keys)


def quality_counts(df: DataFrame, keys: list[str], bad: str, column: str = "ts", size: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """window_start, keys, n_rows, n_bad over tumbling or sliding windows."""
    w = F.window(column, size, slide) if slide else F.window(column, size)
    g = timed(df, column, delay).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n_rows"), F.sum(F.expr(bad).cast("long")).alias("n_bad"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "n_rows", "n_bad")


def sessions(df: DataFrame, user: str, column: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    g = timed(df, column, delay).groupBy(F.session_window(column, gap).alias("w"), user).agg(F.count("*").alias("n_events"))
    return g.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def alerts(counts: DataFrame, rate: float) -> DataFrame:
    return counts.withColumn("bad_rate", F.col("n_bad") / F.col("n_rows")).filter(F.col("bad_rate") > rate)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> int:
    """Drain what is there into Parquet; returns the rows dropped as late."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return late_rows(q)


def for_each_batch(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    q = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def late_rows(query) -> int:
    return sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])
