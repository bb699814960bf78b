"""Pearson correlations of many columns from one pass: sums of products, added over batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "a int, b int, n double, sa double, sb double, saa double, sbb double, sab double, odd double"
OUT_PA = pa.schema([("a", pa.int32()), ("b", pa.int32()), *[(c, pa.float64()) for c in ("n", "sa", "sb", "saa", "sbb", "sab", "odd")]])


def _sums(width: int, shift: list[float]):
    """Each task's sums over the rows that have both columns of a pair, of values less `shift`."""
    upper = np.triu_indices(width, 1)

    def run(batches):
        n, s, q, p, odd = np.zeros((5, width, width))
        for rb in batches:
            x = np.column_stack([np.asarray(rb.column(i).fill_null(float("nan")), dtype=np.float64) for i in range(width)]) - np.array(shift)
            infinite = np.isinf(x)
            here = (~np.isnan(x)).astype(np.float64)
            x = np.where(np.isfinite(x), x, 0.0)
            n += here.T @ here
            s += x.T @ here
            q += (x * x).T @ here
            p += x.T @ x
            if infinite.any():
                one = infinite.astype(np.float64).T @ here
                odd += one + one.T
        a, b = upper
        cols = [a.astype(np.int32), b.astype(np.int32), n[a, b], s[a, b], s[b, a], q[a, b], q[b, a], p[a, b], odd[a, b]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=OUT_PA)

    return run


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_a, column_b, corr of every pair, over the rows that have both; null where it isn't defined.

    One scan at any width.  A task holds 40 bytes for each pair of columns, twice, and sends a row for
    each; rows are added under the pair.  Values are taken less one of the column's own, found
    among the first rows, so that large means don't swamp small differences.
    """
    d = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    near = d.limit(1000).agg(*[F.first(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)), ignorenulls=True).alias(c) for c in d.columns]).first()
    parts = d.mapInArrow(_sums(len(columns), [x if x is not None else 0.0 for x in near]), OUT)
    t = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab", "odd")])
    va, vb = F.col("saa") - F.col("sa") ** 2 / F.col("n"), F.col("sbb") - F.col("sb") ** 2 / F.col("n")
    least = lambda v, s: v > s * 1e-15  # noqa: E731  what rounding leaves of a constant
    fine = (F.col("odd") == 0) & (F.col("n") > 1) & least(va, F.col("saa")) & least(vb, F.col("sbb"))
    corr = F.when(fine, F.greatest(F.least((F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(va * vb), F.lit(1.0)), F.lit(-1.0)))
    names = F.array(*[F.lit(c) for c in columns])
    return t.select(F.get(names, F.col("a")).alias("column_a"), F.get(names, F.col("b")).alias("column_b"), corr.alias("corr"))
