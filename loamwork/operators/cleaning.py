"""Cleaning and outlier treatment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import missing as M
from ..functions import text as X
from .order_stats import modes, quantiles


def remove_duplicates(df: DataFrame, columns: list[str] | None = None, order_cols: list[str] | None = None) -> DataFrame:
    """Whole-row repeats go; with columns, the first by order_cols of each group stays."""
    if columns is None:
        return df.dropDuplicates()
    if not order_cols:
        raise ValueError("keep first needs order_cols")
    rn = F.row_number().over(Window.partitionBy(*columns).orderBy(*order_cols))
    return df.withColumn("__rn", rn).filter("__rn = 1").drop("__rn")


def strip_whitespace(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.withColumns({c: X.strip(F.col(f"`{c}`")) for c in columns or M.strings(df)})


def standardize_case(df: DataFrame, case: str = "lower", columns: list[str] | None = None) -> DataFrame:
    fn = {"lower": F.lower, "upper": F.upper, "title": X.title}[case]
    return df.withColumns({c: fn(F.col(f"`{c}`")) for c in columns or M.strings(df)})


def drop_missing(df: DataFrame, profile: str = "validator", threshold: float = 0.5, critical: list[str] | None = None) -> DataFrame:
    from .transforms import drop_missing as drop_rows
    from .transforms import drop_sparse_columns

    if profile == "task":
        return drop_rows(df)
    df = drop_sparse_columns(df, threshold)
    return drop_rows(df, [c for c in critical or [] if c in df.columns] or None) if critical else df


def fill_missing(df: DataFrame, profile: str = "validator", values: dict | None = None) -> DataFrame:
    """Validator: a given value, else the median, else the mode (lowest of equals), else "Unknown".
    Task: the mean, else empty text."""
    d = M.normalize(df)
    values = dict(values or {})
    nums, texts = M.numeric(d), M.strings(d)
    nums, asked = [c for c in nums if c not in values], [c for c in texts if c not in values]
    if profile == "validator":
        values |= {c: q[0] for c, q in quantiles(d, nums, [0.5]).items()}
        values |= {c: v for c, v in modes(d, asked).items() if v is not None}
    elif nums:
        row = d.agg(*[F.avg(c).alias(f"f{i}") for i, c in enumerate(nums)]).first()
        values |= {c: row[i] for i, c in enumerate(nums) if row[i] is not None}
    for c in texts:
        values.setdefault(c, "Unknown" if profile == "validator" else "")
    kinds = dict(d.dtypes)
    out = {}
    for c, v in values.items():
        if c in d.columns:
            whole = kinds[c] in ("tinyint", "smallint", "int", "bigint") and isinstance(v, float) and v != int(v)
            out[c] = F.coalesce(F.col(c).cast("double") if whole else F.col(c), F.lit(v) if whole else F.lit(v).cast(kinds[c]))
    return d.withColumns(out) if out else d


def fix_types(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """numeric, datetime (failures to null), string; category changes nothing."""
    fns = {"numeric": lambda c: c.try_cast("double"), "datetime": lambda c: F.try_to_timestamp(c.cast("string")), "string": lambda c: c.cast("string"), "category": lambda c: c}
    return df.withColumns({c: fns[k](F.col(f"`{c}`")) for c, k in kinds.items() if c in df.columns})


def remove_outliers(df: DataFrame, columns: list[str] | None = None, threshold: float = 3.0, mode: str = "joint") -> DataFrame:
    """z-scores beyond the threshold go: statistics once for all columns (joint), or anew on what
    each column has left (sequential, a job per column)."""
    cols = columns or M.numeric(df)
    for group in [cols] if mode == "joint" else [[c] for c in cols]:
        d = M.normalize(df)
        row = d.agg(*[x for i, c in enumerate(group) for x in (F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"))]).first()
        for i, c in enumerate(group):
            if row[f"s{i}"]:
                df = df.filter(F.coalesce(F.abs((F.col(c) - row[f"m{i}"]) / row[f"s{i}"]) <= threshold, F.lit(True)))
    return df


def fences(df: DataFrame, columns: list[str], method: str, threshold: float, ddof: int, exact: bool) -> dict[str, tuple[float, float]]:
    d = M.normalize(df)
    quarts = quantiles(d, columns, [0.25, 0.75], exact) if method != "zscore" else {}
    row = d.agg(F.lit(0).alias("none"), *[x for i, c in enumerate(columns) for x in (F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), (F.stddev_pop(c) if ddof == 0 else F.stddev_samp(c)).alias(f"s{i}"))]).first()
    out = {}
    for i, c in enumerate(columns):
        if (row[f"n{i}"] or 0) < 3:
            continue
        if method == "zscore":
            if row[f"s{i}"]:
                out[c] = (row[f"m{i}"] - threshold * row[f"s{i}"], row[f"m{i}"] + threshold * row[f"s{i}"])
        else:
            q1, q3 = quarts[c]
            out[c] = (q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1))
    return out


def outliers(df: DataFrame, columns: list[str] | None = None, method: str = "zscore", action: str = "flag", threshold: float = 3.0, ddof: int = 0, exact: bool = True) -> DataFrame:
    """flag: <col>_outlier and is_outlier; remove: rows with any; cap: to the fences (iqr only)."""
    if action == "cap" and method != "iqr":
        raise ValueError("cap needs the iqr method")
    edges = fences(df, columns or M.numeric(df), method, threshold, ddof, exact)
    out_of = {c: F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False)) for c, (lo, hi) in edges.items()}
    if action == "cap":
        return df.withColumns({c: F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)) for c, (lo, hi) in edges.items()})
    any_ = F.lit(False)
    for e in out_of.values():
        any_ = any_ | e
    if action == "remove":
        return df.filter(~any_)
    return df.withColumns({f"{c}_outlier": e for c, e in out_of.items()} | {"is_outlier": any_})


def table_cleanup(df: DataFrame) -> DataFrame:
    """Empty rows and columns go, text is stripped, whole columns become numbers or times."""
    from .transforms import drop_empty_columns, drop_empty_rows

    df = strip_whitespace(drop_empty_columns(drop_empty_rows(df)))
    cols = M.strings(df)
    if not cols:
        return df
    row = df.agg(*[x for i, c in enumerate(cols) for x in (F.count(c).alias(f"n{i}"), F.count(F.col(c).try_cast("double")).alias(f"d{i}"), F.count(F.try_to_timestamp(F.col(c))).alias(f"t{i}"))]).first()
    out = {}
    for i, c in enumerate(cols):
        n, d, t = (row[f"{k}{i}"] for k in "ndt")
        if n and d == n:
            out[c] = F.col(c).try_cast("double")
        elif n and t == n:
            out[c] = F.try_to_timestamp(F.col(c))
    return df.withColumns(out) if out else df


def clean(df: DataFrame, duplicates: bool = True, strip: bool = True, missing: str = "fill", case: str | None = None, invalid: bool = False, profile: str = "task") -> DataFrame:
    """The cleaning preset: repeats, white space, missing values, case, infinities."""
    from .transforms import remove_infinite

    if duplicates:
        df = remove_duplicates(df)
    if strip:
        df = strip_whitespace(df)
    if missing == "drop":
        df = drop_missing(df, profile)
    elif missing == "fill":
        df = fill_missing(df, profile)
    if case:
        df = standardize_case(df, case)
    return remove_infinite(df) if invalid else df
