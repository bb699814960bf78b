"""Places of regular-expression matches, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import functions as F

PART = 256


def bind(value, fn):
    """fn(value) with value evaluated once: a lambda's argument isn't computed again."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def total(lengths):
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def located(text, pattern):
    """array<struct<start,end,m>> of the leftmost non-overlapping matches; code points, end exclusive.

    What stands between the matches comes from split, the matches from regexp_extract_all;
    starts are running sums of both lengths, by parts of 256 so that a text with very many
    matches stays cheap.  Null text gives null.  The pattern is a string or a column.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, pattern, F.lit(0))

    def places(b, m):
        sizes = F.zip_with(F.slice(b, F.lit(1), F.size(m)), m, lambda x, y: F.length(x) + F.length(y))
        return bind(sizes, lambda s: bind(parts(s), lambda p: F.transform(m, lambda y, i: place(b, s, p, y, i))))

    def parts(s):
        return F.transform(F.sequence(F.lit(0), (F.size(s) / PART).cast("int")), lambda k: total(F.slice(s, k * PART + 1, F.lit(PART))))

    def place(b, s, p, y, i):
        k = (i / PART).cast("int")
        start = total(F.slice(p, F.lit(1), k)) + total(F.slice(s, k * PART + 1, i - k * PART)) + F.length(F.get(b, i))
        return bind(start, lambda x: F.struct(x.alias("start"), (x + F.length(y)).alias("end"), y.alias("m")))

    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    return F.when(F.rlike(text, pattern), bind(between, lambda b: bind(found, lambda m: places(b, m)))).otherwise(F.when(text.isNotNull(), none))
