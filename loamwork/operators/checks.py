"""Quality checks, validator profile: one issue row per finding, scores, gate.

All checks that need only counts share one aggregate over the table; outliers need a second
one, with the first one's statistics as literals.  Distinct counts run apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import missing as M
from ..functions.text import strip
from .order_stats import distinct_counts, quantiles

ISSUE = "issue_type string, severity string, column_name string, n_affected long, ratio double, metrics map<string,double>"

#: Weights of severities.
WEIGHTS = {"critical": 10.0, "high": 5.0, "medium": 2.0, "low": 1.0, "info": 0.5}
#: Hints in column names.
ID_HINTS = ("id", "key", "code", "number", "identifier")
DATE_HINTS = ("date", "time", "datetime", "timestamp", "created", "updated", "modified")
#: Date formats by prefix, tried in order.
DATE_FORMATS = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", r"^[0-9]{2}/[0-9]{2}/[0-9]{4}", r"^[0-9]{2}-[0-9]{2}-[0-9]{4}", r"^[0-9]{4}/[0-9]{2}/[0-9]{2}")
#: PII patterns of the validator profile.
PII = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "credit_card": r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    "ip_address": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
}
#: The same with phone numbers in more formats.
PII_EXTENDED = PII | {"phone": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\b\d{3}[ .-]?)\d{3}[ .-]?\d{4}\b"}
#: Advice by issue type.
ADVICE = {
    "pii_detected": "CRITICAL: Remove or mask PII data immediately to ensure compliance",
    "duplicates": "Remove duplicate rows to improve data quality and reduce storage",
    "missing_values": "Handle missing values in columns: {}. Consider imputation or removal.",
    "outliers": "Review outliers to determine if they are errors or valid extreme values",
}


def issues(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ISSUE)


def missing_severity(ratio: float) -> str:
    return "critical" if ratio > 0.5 else "high" if ratio > 0.2 else "medium" if ratio > 0.1 else "low"


def check_missing(df: DataFrame) -> DataFrame:
    cols = df.columns
    row = df.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(M.is_missing(df, c).cast("long")), F.lit(0)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return issues(df.sparkSession, [("missing_values", missing_severity(row[i + 1] / row.n), c, row[i + 1], row[i + 1] / row.n, None) for i, c in enumerate(cols) if row[i + 1]])


def check_duplicates(df: DataFrame) -> DataFrame:
    from .profile import duplicate_rows

    r = duplicate_rows(M.normalize(df)).first()
    if not r.n_duplicates:
        return issues(df.sparkSession, [])
    ratio = r.n_duplicates / r.n_rows
    return issues(df.sparkSession, [("duplicates", "high" if ratio > 0.05 else "medium", None, r.n_duplicates, ratio, None)])


def check_identifiers(df: DataFrame, exact: bool = True) -> DataFrame:
    """Repeats in id-like columns; a second null is a repeat."""
    d = M.normalize(df)
    row = d.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(d.columns)], *[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"u{i}") for i, c in enumerate(d.columns) if not exact])
    if exact:
        row = row.crossJoin(F.broadcast(distinct_counts(d, d.columns)))  # one row each
    row = row.first()
    out = []
    for i, c in enumerate(d.columns):
        u, filled = row[f"u{i}"], row[f"c{i}"]
        if any(h in c.lower() for h in ID_HINTS) or (row.n > 100 and u / row.n > 0.95):
            repeats = row.n - u - (1 if filled < row.n else 0)
            if repeats > 0:
                out.append(("duplicates", "critical", c, repeats, repeats / row.n, None))
    return issues(df.sparkSession, out)


def check_outliers(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """z-scores beyond 3, and quartile fences where they find over 1.5 times as many."""
    d = M.normalize(df)
    cols = columns or M.numeric(d)
    quarts = quantiles(d, cols, [0.25, 0.75], exact)
    one = d.agg(F.lit(0).alias("none"), *[x for i, c in enumerate(cols) for x in (F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"))]).first()
    aggs, use = [F.lit(0).alias("none")], []
    for i, c in enumerate(cols):
        n, m, s = (one[f"{k}{i}"] for k in "nms")
        q = quarts.get(c)
        if n is None or n < 10 or not s:
            continue
        lo, hi = q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0])
        use.append((i, c, n, lo, hi, q[1] > q[0]))
        aggs += [F.sum((F.abs((F.col(c) - F.lit(m)) / F.lit(s)) > 3).cast("long")).alias(f"z{i}"), F.sum(((F.col(c) < lo) | (F.col(c) > hi)).cast("long")).alias(f"f{i}")]
    two = d.agg(*[F.max(a).alias("none") if k == 0 else a for k, a in enumerate(aggs)]).first()
    out = []
    for i, c, n, lo, hi, wide in use:
        z, f = two[f"z{i}"] or 0, two[f"f{i}"] or 0
        if z:
            out.append(("outliers", "medium", c, z, z / n, {"threshold": 3.0}))
        if wide and f > 1.5 * z:
            out.append(("outliers", "low", c, f, f / n, {"lower_bound": float(lo), "upper_bound": float(hi)}))
    return issues(df.sparkSession, out)


def date_format_id(c):
    out = F.when(F.rlike(c, F.lit(DATE_FORMATS[0])), 0)
    for i, p in enumerate(DATE_FORMATS[1:], 1):
        out = out.when(F.rlike(c, F.lit(p)), i)
    return out


def check_formats(df: DataFrame, low_cardinality: int = 1000) -> DataFrame:
    """Date mixes, numbers as text, white space, case variants: exclusive branches per text column.

    Counts of all columns come from one aggregate over the whole table; case variants from a
    count of values per column.
    """
    cols = M.strings(df)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        fmt = date_format_id(x)
        aggs += [F.count(x).alias(f"n{i}"), F.count(x.try_cast("double")).alias(f"num{i}"), F.coalesce(F.sum((strip(x) != x).cast("long")), F.lit(0)).alias(f"ws{i}"), *[F.coalesce(F.sum((fmt == k).cast("long")), F.lit(0)).alias(f"d{k}_{i}") for k in range(len(DATE_FORMATS))]]
    if not cols:
        return issues(df.sparkSession, [])
    row = df.agg(*aggs).first()
    out, plain = [], []
    for i, c in enumerate(cols):
        n = row[f"n{i}"]
        if not n:
            continue
        if any(h in c.lower() for h in DATE_HINTS):
            counts = [row[f"d{k}_{i}"] for k in range(len(DATE_FORMATS))]
            un = n - sum(counts)
            if sum(k > 0 for k in counts) > 1 or un > 0.1 * n:
                out.append(("inconsistent_formats", "medium", c, un, un / n, {"formats": float(sum(k > 0 for k in counts))}))
        elif row[f"num{i}"] / n > 0.8:
            if row[f"num{i}"] < n:
                out.append(("inconsistent_formats", "high", c, n - row[f"num{i}"], 1 - row[f"num{i}"] / n, None))
        else:
            plain.append(c)
            if row[f"ws{i}"]:
                out.append(("inconsistent_formats", "low", c, row[f"ws{i}"], row[f"ws{i}"] / n, None))
    for c, values, mixed in case_variants(df, plain):
        if values < low_cardinality and mixed:
            out.append(("inconsistent_formats", "medium", c, mixed, mixed / values, None))
    return issues(df.sparkSession, out)


def case_variants(df: DataFrame, columns: list[str]) -> list[tuple[str, int, int]]:
    """(column, values, values that differ from another in case only) of each column, in one pass."""
    if not columns:
        return []
    pairs = df.select(F.posexplode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("i", "v")).filter("v IS NOT NULL").distinct()
    low = pairs.groupBy("i", F.lower("v").alias("l")).agg(F.count("*").alias("k"))
    g = low.groupBy("i").agg(F.sum("k").alias("values"), F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("mixed"))
    return [(columns[r.i], r["values"], r.mixed) for r in g.orderBy("i").collect()]


def check_schema(df: DataFrame, required: list[str] = (), types: dict[str, str] | None = None) -> DataFrame:
    """Missing required columns, and columns of another logical type than declared."""
    out = [("invalid_values", "critical", None, 1, 1.0, None) for c in required if c not in df.columns]
    for c, t in (types or {}).items():
        if c in df.columns and not isinstance(df.schema[c].dataType, M.LOGICAL[t]) and not (t == "object" and c in M.strings(df)):
            out.append(("schema_violations", "high", c, 1, 1.0, None))
    return issues(df.sparkSession, out)


def pii_counts(df: DataFrame, columns: list[str] | None = None, patterns: dict[str, str] | None = None) -> DataFrame:
    """column_name, pii_type, n of every column and type with hits; a full scan in one aggregate."""
    cols, patterns = columns or M.strings(df), patterns or PII
    keys = [(c, t) for c in cols for t in patterns]
    if not keys:
        return df.sparkSession.createDataFrame([], "column_name string, pii_type string, n long")
    row = df.agg(*[F.coalesce(F.sum(F.rlike(F.col(f"`{c}`"), F.lit(patterns[t])).cast("long")), F.lit(0)).alias(f"k{i}") for i, (c, t) in enumerate(keys)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("pii_type"), F.col(f"k{i}").alias("n")) for i, (c, t) in enumerate(keys)])
    return row.select(F.explode(rows).alias("r")).select("r.*").filter("n > 0")


def check_pii(df: DataFrame, columns: list[str] | None = None, patterns: dict[str, str] | None = None) -> DataFrame:
    return pii_counts(df, columns, patterns).select(F.lit("pii_detected").alias("issue_type"), F.lit("critical").alias("severity"), "column_name", F.col("n").alias("n_affected"), F.lit(None).cast("double").alias("ratio"), F.map_from_arrays(F.array(F.col("pii_type")), F.array(F.col("n").cast("double"))).alias("metrics"))


def check_rules(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Range and pattern rules as data; nulls pass a range and fail a pattern.  One aggregate."""
    conds = []
    for r in rules:
        c = F.col(f"`{r['column']}`")
        if r["type"] == "range":
            bad = F.coalesce((c < r["min"]) if r.get("min") is not None else F.lit(False), F.lit(False)) | F.coalesce((c > r["max"]) if r.get("max") is not None else F.lit(False), F.lit(False))
        elif r["type"] == "regex":
            bad = ~F.coalesce(F.rlike(c.cast("string"), F.lit(f"^(?:{r['pattern']})")), F.lit(False))
        elif r["type"] == "enum":
            bad = ~F.coalesce(c.isin(*r["values"]), F.lit(True))
        elif r["type"] == "predicate":
            bad = ~F.coalesce(F.expr(r["condition"]), F.lit(True))
        else:
            raise ValueError(f"unknown rule {r['type']}")
        conds.append(F.coalesce(F.sum(bad.cast("long")), F.lit(0)))
    row = df.agg(F.count("*").alias("n"), *[c.alias(f"r{i}") for i, c in enumerate(conds)]).first()
    return issues(df.sparkSession, [("business_rule_violations", "high", r["column"], row[i + 1], row[i + 1] / row.n, None) for i, r in enumerate(rules) if row[i + 1]])


def check_encoding(df: DataFrame) -> DataFrame:
    """Text cells with a replacement character."""
    cols = M.strings(df)
    if not cols:
        return issues(df.sparkSession, [])
    row = df.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.contains(F.col(f"`{c}`"), F.lit("�")).cast("long")), F.lit(0)).alias(f"e{i}") for i, c in enumerate(cols)]).first()
    return issues(df.sparkSession, [("encoding_issues", "medium", c, row[i + 1], row[i + 1] / row.n, None) for i, c in enumerate(cols) if row[i + 1]])


def drift(df: DataFrame, baseline: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """One row: the population stability index over the baseline's equal-width bins."""
    e = baseline.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    width = (float(e.hi) - float(e.lo)) / bins or 1.0
    b = F.least(F.greatest(F.ceil((F.col(column) - float(e.lo)) / width), F.lit(1)), F.lit(bins)).alias("bin")
    share = lambda d, name: d.filter(F.col(column).isNotNull()).groupBy(b).count().withColumn(name, F.col("count") / F.sum("count").over(Window.partitionBy())).select("bin", name)  # noqa: E731  at most `bins` rows
    j = share(baseline, "p").join(share(df, "q"), "bin", "full")
    p, q = F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(1e-4)), F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(1e-4))
    return j.agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def first_violations(df: DataFrame, condition, order_cols: list[str], n: int = 100) -> DataFrame:
    """The first n rows, by order_cols, that meet a condition."""
    if not order_cols:
        raise ValueError("first_violations needs order_cols")
    return df.filter(condition).orderBy(*order_cols).limit(n)


def validate(df: DataFrame, schema: dict | None = None, rules: list[dict] | None = None, exact: bool = True) -> DataFrame:
    """All issues of a table."""
    parts = [check_missing(df), check_duplicates(df), check_identifiers(df, exact), check_outliers(df, exact=exact), check_formats(df), check_pii(df)]
    if schema:
        parts.append(check_schema(df, schema.get("required", ()), schema.get("types")))
    if rules:
        parts.append(check_rules(df, rules))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def weighted(found: DataFrame) -> DataFrame:
    w = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    return found.withColumn("weight", F.coalesce(F.element_at(w, F.col("severity")), F.lit(1.0)))


def column_scores(df: DataFrame, found: DataFrame) -> DataFrame:
    """column_name, score of every column."""
    cols = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column_name string")
    w = weighted(found).groupBy("column_name").agg(F.sum("weight").alias("w"))
    return cols.join(w, "column_name", "left").select("column_name", F.greatest(F.lit(0.0), 100 - 5 * F.coalesce("w", F.lit(0.0))).alias("score"))


def overall_score(df: DataFrame, found: DataFrame) -> DataFrame:
    """One row: overall_score, completeness, n_issues, n_critical."""
    from .profile import completeness

    w = weighted(found).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"), F.count("*").alias("n_issues"), F.coalesce(F.sum((F.col("severity") == "critical").cast("long")), F.lit(0)).alias("n_critical"))
    base = F.greatest(F.lit(0.0), 100 - F.least(2 * F.col("w"), F.lit(100.0)))
    return completeness(df).crossJoin(w).select((base * 0.8 + 20 * F.col("completeness")).alias("overall_score"), "completeness", "n_issues", "n_critical")


def recommendations(found: DataFrame) -> DataFrame:
    """issue_type, advice for every type present that has one; missing columns are listed, five at most."""
    d = found.groupBy("issue_type").agg(F.array_join(F.slice(F.array_sort(F.collect_set("column_name")), 1, 5), ", ").alias("cols"))
    advice = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])
    return d.select("issue_type", F.replace(F.element_at(advice, F.col("issue_type")), F.lit("{}"), F.col("cols")).alias("advice")).filter("advice IS NOT NULL")


def gate(score: DataFrame, minimum: float = 70.0, fail_on_critical: bool = True) -> DataFrame:
    """One row: passed and why not."""
    critical = F.lit(fail_on_critical) & (F.col("n_critical") > 0)
    return score.select((~critical & (F.col("overall_score") >= minimum)).alias("passed"), F.when(critical, "critical issues").when(F.col("overall_score") < minimum, "score below minimum").otherwise("").alias("reason"))
