"""Profiles as states: sketches of each day kept in a table, merged instead of reading the data again.

A state holds exact counts, a HyperLogLog sketch of the different values, for numbers a KLL sketch of the
distribution with least and greatest value, and for text the most frequent values.  States of any
days merge into the state of all of them, so a profile or a drift against a baseline reads
some kilobytes a day.

Errors (stated, tested): distinct values 1.6 % standard error with lg_k 12 (few values are exact);
ranks within 0.7 %, twice the 99 % bound of k 800 (the sketch draws at random, so two
of the same data differ within it); frequent values are exact while a column has no more
than TRACKED different ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import missing as M

LG_K, KLL_K, TRACKED = 12, 800, 1000
RANK_ERROR, DISTINCT_ERROR = 0.007, 0.016


def states(df: DataFrame, day, columns: list[str] | None = None) -> DataFrame:
    """(day, column_name, n_rows, n_null, different, ranks, lo, hi, frequent): one row a day and column.

    `day` is an expression of the day a row counts for.  One pass over the table.
    """
    df = M.normalize(df)
    cols = columns or df.columns
    numbers = set(M.numeric(df))
    d = df.withColumn("__day", day)
    aggs = [F.count("*").alias("n_rows")]
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        number = x.cast("double") if c in numbers else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if c in numbers else x.cast("string")
        aggs += [
            F.struct(
                F.lit(c).alias("column_name"),
                F.count_if(x.isNull()).alias("n_null"),
                F.hll_sketch_agg(x.cast("string"), LG_K).alias("different"),
                (F.kll_sketch_agg_double(F.when(~F.isnan(number), number), KLL_K) if c in numbers else F.lit(None).cast("binary")).alias("ranks"),
                F.min(number).alias("lo"),
                F.max(number).alias("hi"),
                (F.call_function("approx_top_k_accumulate", text, F.lit(TRACKED)) if c not in numbers else F.lit(None)).alias("frequent"),
            ).alias(f"c{i}")
        ]
    wide = d.groupBy(F.col("__day").alias("day")).agg(*aggs)
    parts = []
    for i, c in enumerate(cols):
        s = wide.select("day", "n_rows", f"c{i}.*")
        parts.append(s.drop("frequent") if c in numbers else s)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merged(state: DataFrame, by: list[str] = ()) -> DataFrame:
    """States merged into one for each column (and each value of `by`)."""
    aggs = [F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.hll_union_agg("different").alias("different"), F.kll_merge_agg_double("ranks").alias("ranks"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    keys = [*by, "column_name"]
    out = state.groupBy(*keys).agg(*aggs)
    if "frequent" not in state.columns:
        return out
    # that aggregate takes no nulls, which numbers have there
    text = state.filter("frequent IS NOT NULL").groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.call_function("approx_top_k_combine", "frequent", F.lit(TRACKED)).alias("frequent"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return out.join(text.hint("merge"), on, "left").drop(*[f"__{k}" for k in keys])


def profile(state: DataFrame, probs: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """column_name, n_rows, null_count, unique_count, and of numbers min, max and quantiles q25, q50, ..."""
    q = [F.when(F.col("lo").isNotNull(), F.kll_sketch_get_quantile_double("ranks", F.lit(p))).alias(f"q{round(100 * p)}") for p in probs]
    return state.select(*[c for c in state.columns if c not in ("n_null", "different", "ranks", "lo", "hi", "frequent")], F.col("n_null").alias("null_count"), F.hll_sketch_estimate("different").alias("unique_count"), F.col("lo").alias("min"), F.col("hi").alias("max"), *q)


def frequent(state: DataFrame, k: int = 5) -> DataFrame:
    """column_name, value, n: the k most frequent values of each text column."""
    return state.filter("frequent IS NOT NULL").select("column_name", F.explode(F.call_function("approx_top_k_estimate", "frequent", F.lit(k))).alias("x")).select("column_name", F.col("x.item").alias("value"), F.col("x.count").alias("n"))


def drift(state: DataFrame, baseline: DataFrame, bins: int = 10) -> DataFrame:
    """column_name, psi: the population stability index of numeric columns over the baseline's equal-width bins.

    Shares of bins are differences of ranks in the two sketches; neither table is read.
    """
    ends = baseline.filter("lo IS NOT NULL").select("column_name", "lo", "hi").collect()  # one row a column; ranks are asked for at fixed values
    out = None
    for c, lo, hi in ends:
        edges = [lo + (hi - lo) * i / bins for i in range(1, bins)]
        both = state.filter((F.col("column_name") == c) & F.col("lo").isNotNull()).select("column_name", "ranks").crossJoin(F.broadcast(baseline.filter(F.col("column_name") == c).select(F.col("ranks").alias("base"))))  # one row each
        ranks = {s: [F.lit(0.0), *[F.kll_sketch_get_rank_double(s, F.lit(x)) for x in edges], F.lit(1.0)] for s in ("ranks", "base")}
        share = lambda s, i: F.greatest(ranks[s][i + 1] - ranks[s][i], F.lit(1e-4))  # noqa: B023, E731
        psi = sum(((share("ranks", i) - share("base", i)) * F.log(share("ranks", i) / share("base", i)) for i in range(bins)), F.lit(0.0))
        part = both.select("column_name", psi.alias("psi"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else state.sparkSession.createDataFrame([], "column_name string, psi double")
