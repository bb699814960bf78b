"""Modality fusion: prefix, align, weigh, combine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import missing as M
from ..functions import text as X
from .profile import variance_top_k


def prefixed(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{name}_{c}" for c in df.columns if c not in keys})


def early(modalities: dict[str, DataFrame], keys: list[str], how: str = "inner", k: int = 50, threshold: int = 100) -> DataFrame:
    """Columns prefixed by modality, aligned by key, the numeric ones of largest variance if many."""
    frames = [prefixed(d, n, keys) for n, d in modalities.items()]
    return variance_top_k(reduce(lambda a, b: a.join(b, keys, how), frames), k, threshold)


def attention(modalities: dict[str, DataFrame], weights: dict[str, float], keys: list[str]) -> DataFrame:
    """Numeric columns times their modality's weight, full outer by key."""
    scaled = {n: d.withColumns({c: F.col(c) * F.lit(float(weights.get(n, 1.0))) for c in M.numeric(d) if c not in keys}) for n, d in modalities.items()}
    return reduce(lambda a, b: a.join(b, keys, "full"), [prefixed(d, n, keys) for n, d in scaled.items()])


def late(modalities: dict[str, DataFrame], keys: list[str], fn: str = "avg") -> DataFrame:
    """Each modality aggregated to the key, then joined in full."""
    done = []
    for n, d in modalities.items():
        cols = [c for c in M.numeric(d) if c not in keys]
        done.append(d.groupBy(*keys).agg(*[getattr(F, fn)(c).alias(f"{n}_{c}") for c in cols], F.count("*").alias(f"{n}_rows")))
    return reduce(lambda a, b: a.join(b, keys, "full"), done)


def hybrid(modalities: dict[str, DataFrame], keys: list[str], groups: list[list[str]] | None = None) -> DataFrame:
    """Early within each declared group of modalities, late over the groups."""
    groups = groups or [list(modalities)]
    return late({"_".join(g): early({n: modalities[n] for n in g}, keys) for g in groups}, keys)


def hierarchical(modalities: dict[str, DataFrame], keys: list[str], levels: list[list[list[str]]]) -> DataFrame:
    """Level after level groups fuse early; what a level doesn't name passes through."""
    now = dict(modalities)
    for level in levels:
        named = {n for g in level for n in g}
        now = {"_".join(g): early({n: now[n] for n in g}, keys) for g in level} | {n: d for n, d in now.items() if n not in named}
    return early(now, keys) if len(now) > 1 else next(iter(now.values()))


def text_features(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumns({"text_length": F.length(column).cast("long"), "word_count": X.word_count(F.col(column))})


def modalities_of(exploded: DataFrame) -> dict[str, DataFrame]:
    """Tables and texts of exploded documents as modalities of their own."""
    return {k: exploded.filter(F.col("type").isin(*v)) for k, v in {"tables": ["table"], "text": ["chunk", "full"]}.items()}


def to_schema(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Exactly the declared columns and types: what is missing or doesn't convert is null."""
    return df.select(*[(F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in schema.items()])
