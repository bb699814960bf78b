"""Quality checks of the task, dataset, connector and document profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import missing as M
from .checks import issues
from .order_stats import distinct_counts, quantiles


def cell_counts(df: DataFrame):
    """(rows, columns, missing by column, repeated rows) in two aggregates."""
    from .profile import duplicate_rows

    d = M.normalize(df)
    row = d.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.col(f"`{c}`").isNull().cast("long")), F.lit(0)).alias(f"m{i}") for i, c in enumerate(d.columns)]).first()
    return row.n, len(d.columns), {c: row[i + 1] for i, c in enumerate(d.columns)}, duplicate_rows(d).first().n_duplicates


def task_quality(df: DataFrame, factor: float = 1.5, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """(issues, one row with quality_score, n_rows, n_columns, missing_cells, duplicate_rows)."""
    n, k, missing, dup = cell_counts(df)
    sev = lambda r: "critical" if r > 0.5 else "high" if r > 0.2 else "medium"
    out = [("missing_values", sev(m / n), c, m, m / n, None) for c, m in missing.items() if m]
    if dup:
        out.append(("duplicates", "medium", None, dup, dup / n, None))
    d, cols = M.normalize(df), M.numeric(df)
    if cols and n:
        quarts = quantiles(d, cols, [0.25, 0.75], exact)
        fences = {c: (lo - factor * (hi - lo), hi + factor * (hi - lo)) for c, (lo, hi) in quarts.items()}
        if fences:
            two = d.agg(*[F.coalesce(F.sum(((F.col(c) < lo) | (F.col(c) > hi)).cast("long")), F.lit(0)).alias(f"o{i}") for i, (c, (lo, hi)) in enumerate(fences.items())]).first()
            out += [("outliers", "low", c, two[i], two[i] / n, {"lower_bound": float(lo), "upper_bound": float(hi)}) for i, (c, (lo, hi)) in enumerate(fences.items()) if two[i]]
    cells, gone = n * k, sum(missing.values())
    score = max(0.0, 100 - 100 * (gone + dup * k) / cells) if cells else 0.0
    spark = df.sparkSession
    return issues(spark, out), spark.createDataFrame([(round(score, 6), n, k, gone, dup)], "quality_score double, n_rows long, n_columns long, missing_cells long, duplicate_rows long")


def dataset_quality(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row with overall_score, column_name and score of every column)."""
    n, k, missing, dup = cell_counts(df)
    distinct = distinct_counts(df, df.columns).first()
    cells = n * k
    overall = 100 - 30 * (sum(missing.values()) / cells if cells else 0) - 20 * (dup / n if n else 0)
    cols = [(c, round(max(0.0, 100 - 50 * (m / n if n else 0) - (30 if distinct[i] == 1 and n > 1 else 0)), 2)) for i, (c, m) in enumerate(missing.items())]
    spark = df.sparkSession
    return spark.createDataFrame([(round(max(0.0, overall), 2), n, k)], "overall_score double, n_rows long, n_columns long"), spark.createDataFrame(cols, "column_name string, score double")


def basic_check(df: DataFrame) -> DataFrame:
    n, _, missing, dup = cell_counts(df)
    out = [("missing_values", "high" if m / n > 0.1 else "medium", c, m, m / n, None) for c, m in missing.items() if m]
    return issues(df.sparkSession, out + ([("duplicates", "medium", None, dup, dup / n, None)] if dup else []))


def connector_check(df: DataFrame) -> DataFrame:
    """level, message: an empty table, repeated column names, columns over half missing."""
    out = []
    if len(set(df.columns)) < len(df.columns):
        out.append(("error", "repeated column names"))
        df = df.toDF(*[f"{c}_{i}" for i, c in enumerate(df.columns)])
    n, _, missing, _ = cell_counts(df)
    if not n:
        out.append(("error", "empty table"))
    out += [("warning", f"{c}: more than half missing") for c, m in missing.items() if n and m / n > 0.5]
    return df.sparkSession.createDataFrame(out, "level string, message string")


def validate_rules(df: DataFrame, rules: list[dict], fail_on_error: bool = False) -> DataFrame:
    """rule, column_name, n_violations of not_null, unique, range and regex rules."""
    exprs = []
    for r in rules:
        c = F.col(f"`{r['column']}`")
        if r["type"] == "not_null":
            e = F.sum(M.is_missing(df, r["column"]).cast("long"))
        elif r["type"] == "unique":
            e = F.count("*") - F.count_distinct(c) - F.max(c.isNull().cast("long"))
        elif r["type"] == "range":
            e = F.sum((F.coalesce(c < F.lit(r.get("min")), F.lit(False)) | F.coalesce(c > F.lit(r.get("max")), F.lit(False))).cast("long"))
        elif r["type"] == "regex":
            e = F.sum((~F.coalesce(F.rlike(c.cast("string"), F.lit(f"^(?:{r['pattern']})")), F.lit(False))).cast("long"))
        else:
            raise ValueError(f"unknown rule {r['type']}")
        exprs.append(F.coalesce(e, F.lit(0)))
    row = df.agg(*[e.alias(f"e{i}") for i, e in enumerate(exprs)]).first()
    found = [(r["type"], r["column"], row[i]) for i, r in enumerate(rules)]
    if fail_on_error and any(n for *_, n in found):
        raise ValueError("; ".join(f"{t} {c}: {n}" for t, c, n in found if n))
    return df.sparkSession.createDataFrame(found, "rule string, column_name string, n_violations long")


def schema_validation(df: DataFrame, spec: dict, strict: bool = False) -> DataFrame:
    """level, kind, column_name, n: required and extra columns, types, unique, not_null, min, max."""
    out = []
    soft = "error" if strict else "warning"
    cols = spec.get("columns", {})
    out += [("error", "missing_column", c, 1) for c in spec.get("required", []) if c not in df.columns]
    out += [(soft, "extra_column", c, 1) for c in df.columns if cols and c not in cols]
    rules = []
    for c, s in cols.items():
        if c not in df.columns:
            continue
        if s.get("type") and not isinstance(df.schema[c].dataType, M.LOGICAL[s["type"]]):
            out.append((soft, "type", c, 1))
        rules += [{"type": k, "column": c} for k in ("unique", "not_null") if s.get(k)]
        if s.get("min") is not None or s.get("max") is not None:
            rules.append({"type": "range", "column": c, "min": s.get("min"), "max": s.get("max")})
    if rules:
        out += [("error", r.rule, r.column_name, r.n_violations) for r in validate_rules(df, rules).collect() if r.n_violations]
    return df.sparkSession.createDataFrame(out, "level string, kind string, column_name string, n long")


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(len(df.columns)).alias("n_columns"), (F.col("n_rows") > 0).alias("has_data"))


def document_quality(docs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Completeness and richness of parsed documents (text, n_tables, n_keys), and who passes."""
    has_text = F.length(F.coalesce("text", F.lit(""))) > 0
    comp = ((F.col("n_tables") > 0).cast("int") + has_text.cast("int") + (F.col("n_keys") > 0).cast("int")) / 3
    rich = 0.4 * (F.col("n_tables") > 0).cast("int") + 0.3 * (F.length(F.coalesce("text", F.lit(""))) > 100).cast("int") + 0.3 * (F.col("n_keys") > 5).cast("int")
    d = docs.withColumns({"completeness": comp, "richness": rich})
    d = d.withColumn("overall", 0.3 * F.col("completeness") + 0.4 * F.col("richness") + 0.3)
    return d.withColumn("passed", F.col("overall") >= threshold)


def pass_through(df: DataFrame) -> tuple[DataFrame, object]:
    """The table unchanged, with an observation that counts its rows when it is used."""
    from pyspark.sql import Observation

    seen = Observation()
    return df.observe(seen, F.count("*").alias("n_rows")), seen

