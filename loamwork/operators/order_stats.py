"""Exact quantiles, distinct counts and modes of many columns, without a map of all values.

No aggregate here gathers a column's values in one task: values are counted under shuffled
keys, and quantiles are cornered by brackets.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Size of a sketch, whose points are off by a quarter of a percent of the rows (99 of 100 times);
#: brackets are SLACK wide to either side, and proved.
SKETCH_K, SLACK = 2048, 0.003
#: A bracket with more rows than this is narrowed again before its values are read.
BRACKET_ROWS = 5000


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: u0, u1, ... exact numbers of different non-null values of the columns.

    One pass: (column, value) pairs, each as 96 bits of hash, are made distinct under a
    shuffled key and counted by column.
    """
    if not columns:
        return df.sparkSession.range(1).select()
    value = lambda c: F.when(c.isNotNull(), F.struct(F.xxhash64(c).alias("h"), F.hash(c).alias("g")))
    pairs = df.select(F.posexplode(F.array(*[value(F.col(f"`{c}`")) for c in columns])).alias("i", "v")).filter("v IS NOT NULL")
    each = pairs.select("i", "v.h", "v.g").groupBy("i", "h", "g").agg(F.lit(1).alias("one"))
    return each.groupBy("i").agg(F.count("*").alias("n")).agg(*[F.coalesce(F.max(F.when(F.col("i") == i, F.col("n"))), F.lit(0)).alias(f"u{i}") for i in range(len(columns))])


def modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """The most frequent value of each column (the lowest of equals), as text, or None.

    One pass at any number of columns: (column, value) rows are counted under a shuffled key.
    """
    if not columns:
        return {}
    numbers = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}

    def value(i, c):
        x = F.col(f"`{c}`")
        x = (x + F.lit(0.0)).cast(df.schema[c].dataType) if c in floats else x  # no negative zero
        number = x.cast("double") if c in numbers else F.lit(None).cast("double")
        return F.when(x.isNotNull(), F.struct(F.lit(i).alias("i"), number.alias("x"), F.length(x.cast("string")).alias("n") if c in numbers else F.lit(0).alias("n"), x.cast("string").alias("v")))

    rows = df.select(F.explode(F.array_compact(F.array(*[value(i, c) for i, c in enumerate(columns)]))).alias("r"))
    counts = rows.groupBy("r").count()
    # in order of the number, or of the text
    top = counts.groupBy("r.i").agg(F.min(F.struct((-F.col("count")).alias("k"), "r.x", "r.n", "r.v"))["v"].alias("v"))
    return {**dict.fromkeys(columns), **{columns[r.i]: r.v for r in top.collect()}}


class Bracket:
    """Where the values of ranks low and high of column i lie: from a to b.

    `below` rows are under a, `at_a` equal it, `inside` lie strictly between, `at_b` equal b.
    """

    def __init__(self, i: int, p: float, n: int, a: float, b: float):
        self.i, self.place = i, p * (n - 1)
        self.low, self.high = math.floor(self.place), math.ceil(self.place)
        self.a, self.b = a, b
        self.below = self.at_a = self.inside = self.at_b = 0

    def take(self, below: int, at_a: int, inside: int, at_b: int) -> bool:
        """Whether these counts prove that both ranks lie within; ends that no rank needs fall together."""
        self.below, self.at_a, self.inside, self.at_b = below, at_a, inside, at_b if self.a < self.b else 0
        if not below <= self.low <= self.high < below + at_a + inside + self.at_b:
            return False
        if self.high < below + at_a:
            self.b = self.a
        elif self.low >= below + at_a + inside:
            self.a = self.b
        return True

    def narrowed(self, least: float, most: float) -> None:
        """New ends from the values inside; an end that a rank stands on stays."""
        self.a, self.b = (self.a if self.low < self.below + self.at_a else least), (self.b if self.high >= self.below + self.at_a + self.inside else most)

    def value(self, inside: list[tuple[float, int]]) -> float:
        """Linear between the two ranks, from (value, rows) pairs of the values inside."""
        if self.a == self.b:
            return self.a
        at, found = self.below, []
        for v, n in [(self.a, self.at_a), *sorted(inside), (self.b, self.at_b)]:
            at += n
            while len(found) < 2 and at > (self.low, self.high)[len(found)]:
                found.append(v)
        x, y = found
        return x if self.low == self.high or x == y else (self.high - self.place) * x + (self.place - self.low) * y


def quantiles(df: DataFrame, columns: list[str], probs: list[float], exact: bool = True) -> dict[str, list[float]]:
    """Quantiles of each numeric column that has values, linear between neighbours.

    A sketch brackets every quantile within a few thousandths of the rows; a count of the rows
    below, at the ends and inside proves the bracket, which is narrowed while it holds too many
    rows; the different values inside are then read.  Values of very many rows end up as ends,
    so what lies inside is always a small share.  Without `exact` a sketch answers alone.
    """
    if not columns:
        return {}
    d = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    d = d.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in d.columns])
    if not exact:
        row = d.agg(*[F.percentile_approx(c, probs, 10000).alias(c) for c in d.columns]).first()
        return {c: row[i] for i, c in enumerate(columns) if row[i] is not None}
    first = d.agg(*[x for c in d.columns for x in (F.count(c).alias(f"n{c}"), F.kll_sketch_agg_double(c, SKETCH_K).alias(f"s{c}"))])
    ends = lambda p: (F.lit(max(0.0, p - SLACK)), F.lit(min(1.0, p + SLACK)))
    row = first.select(*[f"nv{i}" for i in range(len(columns))], *[F.when(F.col(f"nv{i}") > 0, F.kll_sketch_get_quantile_double(f"sv{i}", e)).alias(f"q{i}_{k}_{side}") for i in range(len(columns)) for k, p in enumerate(probs) for side, e in enumerate(ends(p))]).first()
    brackets = [Bracket(i, p, row[f"nv{i}"], row[f"q{i}_{k}_0"], row[f"q{i}_{k}_1"]) for i in range(len(columns)) if row[f"nv{i}"] for k, p in enumerate(probs)]
    prove(d, brackets)
    while wide := [b for b in brackets if b.inside > BRACKET_ROWS and b.a < b.b]:
        inner = d.agg(*[F.kll_sketch_agg_double(F.when(within(b), F.col(f"v{b.i}")), SKETCH_K).alias(f"s{k}") for k, b in enumerate(wide)])
        share = lambda b, rank: (rank - b.below - b.at_a) / b.inside
        row = inner.select(*[F.kll_sketch_get_quantile_double(f"s{k}", F.lit(min(1.0, max(0.0, x)))).alias(f"b{k}_{side}") for k, b in enumerate(wide) for side, x in enumerate((share(b, b.low) - SLACK, share(b, b.high + 1) + SLACK))]).first()
        for k, b in enumerate(wide):
            b.narrowed(row[f"b{k}_0"], row[f"b{k}_1"])
        prove(d, wide)
    open_ = [b for b in brackets if b.a < b.b and b.inside]
    counts: dict[int, list] = {b.i: [] for b in brackets}
    if open_:
        inside = {i: reduce(or_, [within(b) for b in open_ if b.i == i]) for i in sorted({b.i for b in open_})}
        kept = F.array_compact(F.array(*[F.when(x, F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("v"))) for i, x in inside.items()]))
        for r in d.select(F.explode(kept).alias("x")).groupBy("x.i", "x.v").count().collect():  # BRACKET_ROWS a bracket
            counts[r.i].append((r.v, r["count"]))
    out: dict[str, list[float]] = {}
    for b in brackets:
        out.setdefault(columns[b.i], []).append(b.value([x for x in counts[b.i] if b.a < x[0] < b.b]))
    return out


def within(b: Bracket):
    v = F.col(f"v{b.i}")
    return (v > b.a) & (v < b.b)


def prove(d: DataFrame, brackets: list[Bracket]) -> None:
    """Count the rows of each bracket; one that misses its ranks is opened and counted again."""
    if not brackets:
        return
    v = lambda b: F.col(f"v{b.i}")
    row = d.agg(*[F.count_if(x).alias(f"{name}{k}") for k, b in enumerate(brackets) for name, x in (("below", v(b) < b.a), ("a", v(b) == b.a), ("inside", within(b)), ("b", v(b) == b.b))]).first()
    missed = [b for k, b in enumerate(brackets) if not b.take(row[f"below{k}"], row[f"a{k}"], row[f"inside{k}"], row[f"b{k}"])]
    for b in missed:
        b.a, b.b = -math.inf, math.inf
    prove(d, missed)
