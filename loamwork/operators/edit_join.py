"""Joins of strings within a few edits of each other, without a blocking key.

A string cut into d + 1 segments keeps one of them whole in every string within d edits, and
keeps it near its place: if it is the i-th that is whole (from 0), at most i edits lie before it
and at most d - i behind.  Strings are indexed under their d + 1 segments; each string looks
up, for every length within d of its own, the substrings at the few places a segment can have moved to.
What meets is verified by the edit distance with a threshold.

A segment that very many strings share makes a long list.  Such a list is split again: both
sides' rest behind the segment (or before the last one) is within the edits left for it, so it
is cut into segments in the same way and the list is keyed by these too, level by level, until
no list is long or the rest is no longer than the edits left.  Such a list can be long yet: its
members need not be near, as what lies on the other side of a segment isn't compared.

Strings too short to be cut (d code points or fewer) meet on what is left of them and of strings up
to 2 d long after deleting up to d code points.

Equal strings are one class from the start: pairs are pairs of different strings.  Distances
count code points.  Null strings match nothing, an empty string is a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.writers import staged

#: A list of more index rows is split by a further segment.
LONG_LIST = 64


def _cut(length: Column, parts: Column, i: Column) -> tuple[Column, Column]:
    """(start from 0, size) of the i-th of even parts of a string; the longer ones come last."""
    small = F.floor(length / parts)
    long_from = parts - length % parts
    return (i * small + F.greatest(i - long_from, F.lit(0))).cast("int"), (small + F.when(i >= long_from, 1).otherwise(0)).cast("int")


def _entry(key: Column, length: Column, i: Column, e: Column, rest: Column, start: Column, size: Column) -> Column:
    """One key of a string, and what is left to compare beyond it: (key, rest, e)."""
    piece = F.substring(rest, start + 1, size)
    last = i >= e
    left, right = F.substring(rest, F.lit(1), start), F.substring(rest, start + size + 1, F.length(rest))
    return F.struct(F.xxhash64(key, length, i, piece).alias("key"), F.when(last, left).otherwise(right).alias("rest"), F.when(last, e).otherwise(e - i).cast("int").alias("e"))


def _whole(key: Column, length: Column) -> Column:
    """The key of rests that are too short to be cut; they aren't split further."""
    return F.struct(F.xxhash64(key, length, F.lit(-1), F.lit("")).alias("key"), F.lit(None).cast("string").alias("rest"), F.lit(-1).alias("e"))


def _indexed(rows: DataFrame) -> DataFrame:
    """(text, key, rest, e): the segments of each row's rest under its key."""
    n, e, key, rest = F.length("rest"), F.col("e"), F.col("key"), F.col("rest")

    def one(i):
        start, size = _cut(n, e + 1, i)
        return _entry(key, n, i, e, rest, start, size)

    made = F.when(n > e, F.transform(F.sequence(F.lit(0), e), one)).otherwise(F.array(_whole(key, n)))
    return rows.select("text", F.explode(made).alias("x")).select("text", "x.*")


def _probed(rows: DataFrame, shorter_only: bool) -> DataFrame:
    """(text, key, rest, e): every key under which a string within the edits can be indexed."""
    n, e, key, rest = F.length("rest"), F.col("e"), F.col("key"), F.col("rest")

    def segment(length, i):
        start, size = _cut(length, e + 1, i)
        moved = n - length
        lo = F.greatest(F.lit(0), start - i, start + moved - (e - i))
        hi = F.least(n - size, start + i, start + moved + (e - i))
        none = F.array().cast("array<struct<key:bigint,rest:string,e:int>>")
        return F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda at: _entry(key, length, i, e, rest, at, size))).otherwise(none)

    def of_length(length):
        return F.when(length > e, F.flatten(F.transform(F.sequence(F.lit(0), e), lambda i: segment(length, i)))).otherwise(F.array(_whole(key, length)))

    top = n if shorter_only else n + e
    made = F.flatten(F.transform(F.sequence(F.greatest(n - e, F.lit(0)), top), of_length))
    return rows.select("text", F.explode(F.array_distinct(made)).alias("x")).select("text", "x.*")


def _rests_near(edits: int) -> Column:
    """Whether the rests of an entry and a probe are within the edits left for them; rests that aren't cut are."""
    near = F.lit(True)
    for e in range(edits + 1):
        within = F.col("rest_a") == F.col("rest_b") if e == 0 else F.levenshtein("rest_a", "rest_b", e) >= 0
        near = F.when(F.col("e_a") == e, within).otherwise(near)
    return near


def _verified(index: DataFrame, probes: DataFrame, edits: int, same: bool) -> DataFrame:
    """(a, b, edits) of what meets under a key; rests are compared before whole strings are, as they are shorter."""
    rests = [c for c in ("rest", "e") if c in index.columns]
    a, b = (d.select(F.col("key").alias(f"k{x}"), F.col("text").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in rests]) for d, x in ((index, "a"), (probes, "b")))
    cond = F.col("ka") == F.col("kb")
    if rests:
        cond &= _rests_near(edits)
    if same:
        cond &= (F.length("a") < F.length("b")) | (F.length("a") == F.length("b")) & (F.col("a") < F.col("b"))
    near = F.levenshtein("a", "b", edits)
    return a.join(b.hint("merge"), cond & (near >= 0)).select("a", "b", near.alias("edits"))


def _leftovers(texts: DataFrame, edits: int, longest: int) -> DataFrame:
    """(text, key) of strings up to `longest`: what stays of each after up to `edits` deletions."""
    seen = F.array("text")
    for _ in range(edits):
        cut = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
        none = F.array().cast("array<string>")
        seen = F.array_distinct(F.concat(seen, F.flatten(F.transform(seen, lambda x: F.when(F.length(x) > 0, cut(x)).otherwise(none)))))
    return texts.filter(F.length("text") <= longest).select("text", F.explode(seen).alias("left")).select("text", F.xxhash64("left").alias("key"))


def _near(left: DataFrame, right: DataFrame, edits: int, same: bool, long_list: int) -> DataFrame:
    """(a, b, edits) of distinct texts; with `same`, left is right and every pair comes once."""
    if edits < 0:
        raise ValueError("edits is at least 0")
    root = lambda d: d.select("text", F.lit(0).cast("long").alias("key"), F.col("text").alias("rest"), F.lit(edits).alias("e"))
    index = _indexed(root(left.filter(F.length("text") > edits)))
    probes = _probed(root(right.filter(F.length("text") > 0)), same)
    found = None
    while True:  # a rest gets shorter at each level
        index = staged(index, "segments")
        lists = staged(index.filter("e >= 0").groupBy("key").count().filter(F.col("count") > long_list).select(F.col("key").alias("crowded")), "lists")
        if not lists.limit(1).take(1):
            part = _verified(index, probes, edits, same)
            found = part if found is None else found.unionByName(part)
            break
        probes = staged(probes, "probes")
        on = F.col("key") == F.col("crowded")
        apart = [d.join(lists.hint("merge"), on, "left_anti") for d in (index, probes)]
        part = _verified(*apart, edits, same)
        found = part if found is None else found.unionByName(part)
        rest = [d.join(lists.hint("merge"), on, "left_semi") for d in (index, probes)]
        index, probes = _indexed(rest[0]), _probed(rest[1], False)
    # one of the two is too short to be cut: both are then at most twice `edits` long
    short = [_leftovers(d, edits, 2 * edits) for d in (left, right)]
    few = short[0].filter(F.length("text") <= edits)
    found = found.unionByName(_verified(few, short[1], edits, same))
    if not same:
        few = short[1].filter(F.length("text") <= edits)
        found = found.unionByName(_verified(short[0], few, edits, same))
    return found.distinct()


def edit_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str, edits: int = 2, long_list: int = LONG_LIST) -> DataFrame:
    """(a, b, edits): all different values of left_col and right_col within `edits` of each other, equal ones included."""
    return _near(left.select(F.col(left_col).alias("text")).dropna().distinct(), right.select(F.col(right_col).alias("text")).dropna().distinct(), edits, False, long_list)


def _classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return staged(df.filter(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias("text")).agg(F.min(id_col).alias("class_id"), F.count("*").alias("members")), "classes")


def edit_pairs(df: DataFrame, id_col: str, text_col: str, edits: int = 2, long_list: int = LONG_LIST) -> DataFrame:
    """(id_a, id_b, edits, n_a, n_b): pairs of different strings within `edits`, named by the least id that has them."""
    classes = _classes(df, id_col, text_col)
    of = lambda side: classes.select(F.col("text").alias(f"t{side}"), F.col("class_id").alias(f"i{side}"), F.col("members").alias(f"m{side}")).hint("merge")
    both = _near(classes.select("text"), classes.select("text"), edits, True, long_list).join(of("a"), F.col("a") == F.col("ta")).join(of("b"), F.col("b") == F.col("tb"))
    first = F.col("ia") < F.col("ib")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    return both.select(pick("ia", "ib", "id_a"), pick("ib", "ia", "id_b"), "edits", pick("ma", "mb", "n_a"), pick("mb", "ma", "n_b"))


def edit_links(df: DataFrame, id_col: str, text_col: str, edits: int = 2, long_list: int = LONG_LIST) -> DataFrame:
    """Every row with class_id (the least id of its string) and n_links (different strings within `edits`); null strings have neither."""
    classes = _classes(df, id_col, text_col)
    pairs = _near(classes.select("text"), classes.select("text"), edits, True, long_list)
    n = pairs.select(F.explode(F.array("a", "b")).alias("t")).groupBy("t").agg(F.count("*").alias("n_links"))
    of = classes.join(n.hint("merge"), F.col("text") == F.col("t"), "left").select(F.col("text").alias("__text"), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return df.join(of.hint("merge"), F.col(text_col) == F.col("__text"), "left").drop("__text")
