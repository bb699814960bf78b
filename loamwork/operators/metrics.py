"""Run metrics: usage, costs, performance, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Price per million tokens in and out by model.
PRICES = {
    "claude-sonnet-4-20250514": (3.0, 15.0),
    "gpt-4-turbo": (10.0, 30.0),
    "gpt-3.5-turbo": (0.5, 1.5),
    "gemini-pro": (0.5, 1.5),
}
#: Price per hour of compute, and storage.
HOURLY = {"small": 0.10, "medium": 0.25, "large": 0.50}
GB_PER_ROW, GB_MONTH = 0.0001, 0.02


def performance(executions: DataFrame, keys: list[str]) -> DataFrame:
    ok = F.col("status") == "completed"
    return executions.groupBy(*keys).agg(
        F.count("*").alias("executions"),
        F.sum(ok.cast("long")).alias("successful"),
        F.sum((F.col("status") == "failed").cast("long")).alias("failed"),
        F.round(100 * F.avg(ok.cast("double")), 4).alias("success_pct"),
        F.round(F.avg("execution_time_seconds"), 4).alias("avg_seconds"),
        F.round(F.avg("rows_processed"), 4).alias("avg_rows"),
        F.round(F.avg("llm_cost_usd"), 6).alias("avg_cost"),
        F.sum("rows_processed").cast("long").alias("total_rows"),
    )


def model_key():
    p, m = F.col("provider"), F.col("model")
    return F.when((p == "openai") & F.contains(m, F.lit("gpt-4")), "gpt-4-turbo").when((p == "openai") & F.contains(m, F.lit("gpt-3.5")), "gpt-3.5-turbo").when(p == "google", "gemini-pro").otherwise(m)


def llm_cost(usage: DataFrame, prices=PRICES, default=(1.0, 1.0)) -> DataFrame:
    """cost_usd of every usage row: its tokens at its model's price, or the default."""
    table = F.create_map(*[x for k, v in prices.items() for x in (F.lit(k), F.array(F.lit(v[0]), F.lit(v[1])))])
    price = F.coalesce(F.element_at(table, model_key()), F.array(F.lit(default[0]), F.lit(default[1])))
    return usage.withColumn("cost_usd", F.round(F.col("prompt_tokens") / 1e6 * price[0] + F.col("completion_tokens") / 1e6 * price[1], 6))


def run_cost(executions: DataFrame, size: str = "small") -> DataFrame:
    """total_cost of every run: model, compute and a day of storage."""
    compute = F.round(F.col("execution_time_seconds") / 3600 * HOURLY.get(size, 0.10), 6)
    return executions.withColumn("total_cost", F.round(F.col("llm_cost_usd") + compute + F.col("rows_processed") * GB_PER_ROW * GB_MONTH / 30, 4))


def cost_timeline(costs: DataFrame, time_col: str = "ts", cost_col: str = "cost_usd", unit: str = "day") -> DataFrame:
    """bucket, cost, n over a dense range of days, weeks or months; empty buckets are zero."""
    d = costs.groupBy(F.date_trunc(unit, time_col).cast("date").alias("bucket")).agg(F.sum(cost_col).alias("cost"), F.count("*").alias("n"))
    step = {"day": F.expr("interval 1 day"), "week": F.expr("interval 7 days"), "month": F.expr("interval 1 month")}[unit]
    dense = d.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b", step)).alias("bucket"))
    return dense.join(d.hint("merge"), "bucket", "left").select("bucket", F.round(F.coalesce("cost", F.lit(0.0)), 6).alias("cost"), F.coalesce("n", F.lit(0)).alias("n"))


def cost_by(costs: DataFrame, key: str, cost_col: str = "cost_usd") -> DataFrame:
    """Cost and share by provider, pipeline or the like."""
    d = costs.groupBy(key).agg(F.sum(cost_col).alias("cost"), F.count("*").alias("n"))
    total = F.broadcast(d.agg(F.sum("cost").alias("total")))  # one row
    return d.crossJoin(total).select(key, F.round("cost", 6).alias("cost"), "n", F.round(100 * F.col("cost") / F.nullif("total", F.lit(0.0)), 4).alias("share_pct"))


def daily_usage(usage: DataFrame) -> DataFrame:
    return usage.groupBy(F.to_date("ts").alias("day"), "provider", "model").agg(F.count("*").alias("requests"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).cast("long").alias("tokens"), F.round(F.sum("cost_usd"), 6).alias("cost"))


def daily_trend(executions: DataFrame, time_col: str = "ts") -> DataFrame:
    return executions.groupBy(F.to_date(time_col).alias("day")).agg(F.count("*").alias("total"), F.sum((F.col("status") == "completed").cast("long")).alias("successful"), F.sum((F.col("status") == "failed").cast("long")).alias("failed"))


def last_failures(executions: DataFrame, n: int = 10, time_col: str = "ts") -> DataFrame:
    return executions.filter("status = 'failed'").orderBy(F.desc(time_col), "execution_id").limit(n)


def duration_histogram(executions: DataFrame, edges=(1, 5, 10, 30, 60, 300)) -> DataFrame:
    """status, le, n: runs by the first edge at or above their seconds; null beyond the last."""
    e = F.get(F.filter(F.array(*[F.lit(float(x)) for x in edges]), lambda x: F.col("execution_time_seconds") <= x), F.lit(0))
    return executions.groupBy("status", e.alias("le")).agg(F.count("*").alias("n"))


def counts_by_label(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.groupBy(*labels).agg(F.count("*").alias("n"))
