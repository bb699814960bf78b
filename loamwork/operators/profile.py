"""Profiles: counts, moments, quantiles, correlations, histograms, insights.

Statistics of all columns go through one aggregate; exact distinct counts and whole-row
repeats run apart.  `exact=False` trades exact quantiles and distinct counts for sketches.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import missing as M
from ..functions.missing import long_rows
from . import gram
from .order_stats import distinct_counts, quantiles


def group_aggregate(df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """output name -> (column, function); rows with a null key are left out."""
    df = df.na.drop(subset=keys)
    return df.groupBy(*keys).agg(*[getattr(F, fn)(c).alias(name) for name, (c, fn) in aggs.items()])


def nulls_distinct(df: DataFrame, exact: bool = True) -> DataFrame:
    """column_name, n_rows, null_count, null_pct, unique_count, unique_pct."""
    df = M.normalize(df)
    cols = df.columns
    row = df.agg(F.count("*").alias("n"), *[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"m{i}") for i, c in enumerate(cols)], *[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"u{i}") for i, c in enumerate(cols) if not exact])
    if exact:
        row = row.crossJoin(F.broadcast(distinct_counts(df, cols)))  # one row each
    out = row.select("*", *[x for i in range(len(cols)) for x in (F.col("n").alias(f"n_rows__{i}"), F.coalesce(f"m{i}", F.lit(0)).alias(f"null_count__{i}"), F.col(f"u{i}").alias(f"unique_count__{i}"), F.when(F.col("n") > 0, F.round(100 * F.col(f"m{i}") / F.col("n"), 6)).alias(f"null_pct__{i}"), F.when(F.col("n") > 0, F.round(100 * F.col(f"u{i}") / F.col("n"), 6)).alias(f"unique_pct__{i}"))])
    return long_rows(out, cols, {"n_rows": "long", "null_count": "long", "null_pct": "double", "unique_count": "long", "unique_pct": "double"})


def numeric_stats(df: DataFrame, columns: list[str] | None = None, exact: bool = True, digits: int = 4) -> DataFrame:
    """column_name, n, mean, std, min, q25, q50, q75, max of the numeric columns."""
    df = M.normalize(df)
    cols = columns or M.numeric(df)
    quarts = quantiles(df, cols, [0.25, 0.5, 0.75], exact)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        aggs += [F.count(x).alias(f"n__{i}"), F.avg(x).alias(f"mean__{i}"), F.stddev_samp(x).alias(f"std__{i}"), F.min(x).alias(f"min__{i}"), F.max(x).alias(f"max__{i}")]
    row = df.agg(*aggs)
    row = row.select("*", *[F.lit(quarts[c][k] if c in quarts else None).cast("double").alias(f"{name}__{i}") for i, c in enumerate(cols) for k, name in enumerate(("q25", "q50", "q75"))])
    metrics = ("mean", "std", "min", "q25", "q50", "q75", "max")
    out = long_rows(row, cols, {"n": "long", **dict.fromkeys(metrics, "double")})
    return out.withColumns({m: F.round(m, digits) for m in metrics})


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """column_name, rank, value, n: the k most frequent values, ties by value; rank 1 is the mode.

    Columns are counted one after the other in one long table, so only counts are ranked.
    """
    parts = [df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).count().withColumn("column_name", F.lit(c)) for c in columns]
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("count"), "value"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k).select("column_name", F.col("rank").cast("long"), "value", F.col("count").alias("n"))


def string_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, avg_length, max_length, empty_strings, whitespace_issues."""
    from ..functions.text import strip

    cols = columns or M.strings(df)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        aggs += [F.round(F.avg(F.length(x)), 6).alias(f"avg_length__{i}"), F.max(F.length(x)).alias(f"max_length__{i}"), F.coalesce(F.sum((x == "").cast("long")), F.lit(0)).alias(f"empty_strings__{i}"), F.coalesce(F.sum((strip(x) != x).cast("long")), F.lit(0)).alias(f"whitespace_issues__{i}")]
    return long_rows(df.agg(*aggs), cols, {"avg_length": "double", "max_length": "long", "empty_strings": "long", "whitespace_issues": "long"})


def correlations(df: DataFrame, columns: list[str] | None = None, digits: int = 6) -> DataFrame:
    """column_a, column_b, corr of every pair, over rows that have both; one scan at any width."""
    df = M.normalize(df)
    cols = columns or M.numeric(df)
    pairs = list(combinations(cols, 2))
    if len(pairs) > 12:  # wider aggregates fall out of code generation
        return gram.correlations(df, cols).withColumn("corr", F.round("corr", digits))
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.round(F.nanvl(F.col(f"c{i}"), F.lit(None).cast("double")), digits).alias("corr")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(rows).alias("r")).select("r.*")


def shape(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, skewness, kurtosis, corrected for bias."""
    df = M.normalize(df)
    aggs = []
    for i, c in enumerate(columns):
        n = F.count(c)
        g, k = F.skewness(c), F.kurtosis(c)
        aggs += [F.when(n > 2, g * F.sqrt(n * (n - 1)) / (n - 2)).alias(f"skewness__{i}"), F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6)).alias(f"kurtosis__{i}")]
    out = long_rows(df.agg(*aggs), columns, {"skewness": "double", "kurtosis": "double"})
    return out.withColumns({m: F.round(m, 6) for m in ("skewness", "kurtosis")})


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """bin (1..bins), n: equal widths, right-closed, the least value in the first."""
    d = M.normalize(df).filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    edges = F.broadcast(d.agg(F.min("x").alias("lo"), F.max("x").alias("hi")))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.greatest(F.ceil((F.col("x") - F.col("lo")) / width), F.lit(1)), F.lit(bins)))
    return d.crossJoin(edges).groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def completeness(df: DataFrame) -> DataFrame:
    """One row: completeness, the share of cells that aren't missing."""
    df = M.normalize(df)
    filled = sum((F.count(F.col(f"`{c}`")) for c in df.columns), F.lit(0))
    return df.agg(F.when(F.count("*") > 0, filled / (F.count("*") * len(df.columns))).alias("completeness"))


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: n_rows, n_distinct, n_duplicates; nulls compare equal."""
    g = df.groupBy(*(columns or df.columns)).count()
    return g.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates"))


def identifier_columns(profile: DataFrame) -> DataFrame:
    """Of a nulls_distinct profile: columns with as many values as rows."""
    return profile.filter("n_rows > 0 AND unique_count = n_rows").select("column_name")


def insights(df: DataFrame, exact: bool = True) -> DataFrame:
    """column_name, insight: much missing, almost unique text, constant."""
    texts = M.strings(df)
    p = nulls_distinct(df, exact)
    kinds = F.filter(
        F.array(
            F.when(F.col("null_pct") > 20, F.lit("high_missing")),
            F.when(F.col("column_name").isin(texts or [""]) & (F.col("unique_pct") > 95), F.lit("high_cardinality")),
            F.when(F.col("unique_count") == 1, F.lit("constant")),
        ),
        lambda x: x.isNotNull(),
    )
    return p.select("column_name", F.explode(kinds).alias("insight"))


def type_histogram(df: DataFrame) -> DataFrame:
    """dtype, n: number of columns of each type."""
    return df.sparkSession.createDataFrame([(t,) for _, t in df.dtypes], "dtype string").groupBy("dtype").agg(F.count("*").alias("n"))


def redundancy(df: DataFrame, columns: list[str] | None = None, limit: float = 0.9) -> DataFrame:
    """One row: 1 minus the share of column pairs with an absolute correlation above limit."""
    c = correlations(df, columns, 12)
    return c.agg(F.coalesce(1 - F.avg((F.abs(F.coalesce("corr", F.lit(0.0))) > limit).cast("double")), F.lit(1.0)).alias("redundancy"))


def information_preservation(inputs: list[DataFrame], output: DataFrame) -> float:
    n = sum(len(d.columns) for d in inputs)
    return min(1.0, len(output.columns) / n) if n else 1.0


def fusion_score(inputs: list[DataFrame], output: DataFrame, coherence: float = 0.85) -> DataFrame:
    """One row: the four parts and their mean."""
    kept = information_preservation(inputs, output)
    d = completeness(output).crossJoin(redundancy(output))
    d = d.withColumn("preservation", F.lit(kept)).withColumn("coherence", F.lit(coherence))
    return d.withColumn("fusion_score", (F.col("completeness") + F.col("preservation") + F.col("redundancy") + F.col("coherence")) / 4)


def variance_top_k(df: DataFrame, k: int = 50, threshold: int = 100) -> DataFrame:
    """Beyond `threshold` columns keep the k numeric ones of largest variance and the others."""
    if len(df.columns) <= threshold:
        return df
    nums = M.numeric(df)
    row = M.normalize(df).agg(*[F.var_samp(F.col(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(nums)]).first()
    best = sorted(nums, key=lambda c: (-(row[nums.index(c)] if row[nums.index(c)] is not None else -1.0), c))[:k]
    return df.select(*[f"`{c}`" for c in df.columns if c not in nums or c in best])


def trend(df: DataFrame, value: str, position: str) -> DataFrame:
    """One row: mean, std and linear slope of value against an explicit position column."""
    return df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.regr_slope(F.col(value), F.col(position)).alias("slope"))


def issue_summary(issues: DataFrame) -> DataFrame:
    """Counts by type, by severity and by column, in one pass: dimension, value, n."""
    g = issues.groupingSets([["issue_type"], ["severity"], ["column_name"]], "issue_type", "severity", "column_name").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    dim = F.when(F.col("gid") == 3, "issue_type").when(F.col("gid") == 5, "severity").otherwise("column_name")
    val = F.when(F.col("gid") == 3, F.col("issue_type")).when(F.col("gid") == 5, F.col("severity")).otherwise(F.col("column_name"))
    return g.select(dim.alias("dimension"), val.alias("value"), "n")
