"""PII masking of table columns: partial masks, tokens, blanks, flags, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import missing as M
from .checks import PII, pii_counts

DEFAULT_TYPES = ("ssn", "phone", "email", "credit_card")
#: Patterns and replacement texts of the task profile.
TASK_PII = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b|\b\d{9}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+?1[-.]?)?\(?[0-9]{3}\)?[-.]?[0-9]{3}[-.]?[0-9]{4}\b",
    "credit_card": r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12}|(?:2131|1800|35\d{3})\d{11})\b",
    "ip_address": r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
}
TOKENS = {"ssn": "XXX-XX-XXXX", "email": "****@****.***", "phone": "XXX-XXX-XXXX", "credit_card": "XXXX-XXXX-XXXX-XXXX"}


def hit(c, types=DEFAULT_TYPES, patterns=PII):
    out = F.lit(False)
    for t in types:
        out = out | F.rlike(c, F.lit(patterns[t]))
    return out


def mask(df: DataFrame, columns: list[str] | None = None, types=DEFAULT_TYPES, mark: str = "*") -> DataFrame:
    """Cells with a hit keep their first and last character; two or fewer are masked whole."""
    out = {}
    for c in columns or M.strings(df):
        x = F.col(f"`{c}`")
        n = F.length(x)
        out[c] = F.when(hit(x, types), F.when(n <= 2, F.repeat(F.lit(mark), n)).otherwise(F.concat(F.left(x, F.lit(1)), F.repeat(F.lit(mark), n - 2), F.right(x, F.lit(1))))).otherwise(x)
    return df.withColumns(out)


def drop_columns(df: DataFrame, types=DEFAULT_TYPES) -> DataFrame:
    found = {r.column_name for r in pii_counts(df, patterns={t: PII[t] for t in types}).collect()}
    return df.drop(*found)


def flag(df: DataFrame, columns: list[str] | None = None, types=DEFAULT_TYPES) -> DataFrame:
    return df.withColumns({f"{c}_has_pii": F.coalesce(hit(F.col(f"`{c}`"), types), F.lit(False)) for c in columns or M.strings(df)})


def redact(df: DataFrame, columns: list[str] | None = None, types=("ssn", "email", "phone", "credit_card")) -> DataFrame:
    """Matches become the token of their type, type after type."""
    out = {}
    for c in columns or M.strings(df):
        x = F.col(f"`{c}`")
        for t in types:
            if t in TOKENS:
                x = F.regexp_replace(x, TASK_PII[t], TOKENS[t])
        out[c] = x
    return df.withColumns(out)


def blank(df: DataFrame, columns: list[str] | None = None, types=tuple(TASK_PII)) -> DataFrame:
    return df.withColumns({c: F.when(hit(F.col(f"`{c}`"), types, TASK_PII), F.lit("")).otherwise(F.col(f"`{c}`")) for c in columns or M.strings(df)})


def report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, pii_type, n in the task profile."""
    return pii_counts(df, columns, TASK_PII)
