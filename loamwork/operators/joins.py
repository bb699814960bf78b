"""Joins: named inputs, alignment by position, references, fuzzy matches, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import staged, work_path

#: Ids (one long a row) are broadcast only after they were counted and are at most this many.
FEW_IDS = 500_000
#: Longs of parities that stand for a set of shingles before it is compared.
BITS = 4


def join_step(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    if how not in ("inner", "outer", "left", "right"):
        raise ValueError(f"unknown join type {how}")
    return left.join(right, keys, how)


def positioned(df: DataFrame, order_cols: list[str], name: str = "__pos") -> DataFrame:
    """A dense position by order_cols.

    Ranges of the order are numbered apart: positions are counts of earlier ranges plus a
    row number within the range, so no task holds all rows.
    """
    if not order_cols:
        raise ValueError("positions need order_cols")
    # written out: the range numbers must be the same for counting and numbering
    path = work_path(df, "ranges")
    df.repartitionByRange(*order_cols).withColumn("__p", F.spark_partition_id()).write.parquet(path)
    parts = df.sparkSession.read.parquet(path)
    counts = parts.groupBy("__p").count()
    before = counts.select("__p", (F.sum("count").over(Window.orderBy("__p")) - F.col("count")).alias("__before"))  # one row per range
    numbered = parts.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*order_cols)))
    return numbered.join(F.broadcast(before), "__p").withColumn(name, F.col("__before") + F.col("__n")).drop("__p", "__n", "__before")


def ranked(df: DataFrame, group_cols: list[str], order_cols: list[str]) -> DataFrame:
    """__pos (from 1) within each group, and __size, the group's rows; a group may hold most rows."""
    d = positioned(df, [*group_cols, *order_cols])
    groups = d.groupBy(*[F.col(c).alias(f"__{c}") for c in group_cols]).agg((F.min("__pos") - 1).alias("__start"), F.count("*").alias("__size"))
    cond = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group_cols]
    return d.join(groups.hint("merge"), cond).withColumn("__pos", F.col("__pos") - F.col("__start")).drop("__start", *[f"__{c}" for c in group_cols])


def align(left: DataFrame, right: DataFrame, how: str = "inner", keys: list[str] | None = None, order: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """Side by side by key or by position; clashing names get _left and _right."""
    if keys is None:
        if order is None:
            raise ValueError("align needs keys or order columns")
        left, right, keys = positioned(left, order[0]), positioned(right, order[1]), ["__pos"]
    clash = set(left.columns) & set(right.columns) - set(keys)
    left = left.withColumnsRenamed({c: f"{c}_left" for c in clash})
    right = right.withColumnsRenamed({c: f"{c}_right" for c in clash})
    return left.join(right, keys, how).drop("__pos")


def column_concat(left: DataFrame, right: DataFrame, order: tuple[list[str], list[str]]) -> DataFrame:
    return align(left, right, "full", order=order)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose key has no parent; null keys aren't orphans."""
    keys = parent.select(F.col(parent_key).alias("__parent")).distinct()
    return child.filter(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("__parent"), "left_anti")


def fuzzy_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str, block, threshold: float = 0.8) -> DataFrame:
    """Pairs in one block with an edit similarity of at least `threshold`.

    `block` maps a column to its blocking key, or is a pair of keys, one for each side; pairs are
    made only within a block.  `edit_join` needs no blocks.
    """
    key_a, key_b = block if isinstance(block, tuple) else (block(F.col(left_col)), block(F.col(right_col)))
    a = left.withColumn("__block", F.expr(key_a) if isinstance(key_a, str) else key_a)
    b = right.withColumn("__block", F.expr(key_b) if isinstance(key_b, str) else key_b)
    longest = F.greatest(F.length(F.col(left_col)), F.length(F.col(right_col)))
    # the edits are at least the difference of the lengths
    near = longest - F.least(F.length(F.col(left_col)), F.length(F.col(right_col))) <= F.round(longest * (1 - threshold), 9)
    score = F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(F.col(left_col), F.col(right_col)) / longest)
    return a.join(b.hint("merge"), "__block").filter(near).withColumn("similarity", score).filter(F.col("similarity") >= threshold).drop("__block")


def shingle_sets(df: DataFrame, text_col: str, words: int = 5) -> DataFrame:
    """(id, g): the distinct hashed word shingles of each text; fewer words are one shingle."""
    w = F.split(F.trim(F.lower(F.col(text_col))), r"\s+")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - words + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, words), " ")))
    return df.select("id", w.alias("w")).select("id", F.array_distinct(grams).alias("g"))


def of_ids(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows whose id is (or, left_anti, isn't) among staged ids (column __x)."""
    few = ids.limit(FEW_IDS + 1).count() <= FEW_IDS
    return rows.join(ids.hint("broadcast" if few else "merge"), F.col("id") == F.col("__x"), how)


def distinct_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, text) of the least id of each text, and (id, rep): every id beside that least one; null texts are left out.

    Texts are told apart by SHA-256, so that none is moved.
    """
    marked = staged(rows.filter("text IS NOT NULL").select("id", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("d")), "digests")
    least = marked.groupBy(F.col("d").alias("d2")).agg(F.min("id").alias("rep"))
    reps = staged(marked.join(least.hint("merge"), F.col("d") == F.col("d2")).select("id", "rep"), "reps")
    copies = staged(reps.filter("id <> rep").select(F.col("id").alias("__x")), "copies")
    return of_ids(rows.filter("text IS NOT NULL"), copies, "left_anti"), reps


def linkable_sets(df: DataFrame, text_col: str, similarity: float, words: int = 5) -> DataFrame:
    """`shingle_sets`, staged, without sets that can't reach this Jaccard similarity with any other.

    A set of n shares all but n - ceil(similarity * n) of its shingles with one that it links to.
    So of its shingles in a fixed part of all, no more than that are in no other set.  Only that
    part is moved; a set with too few shingles in it stays.
    """
    part = round(1000 * min(1.0, 2 * (1 - similarity)))
    n = F.size("g")
    away = n - F.ceil(F.round(n * similarity, 9))
    some = shingle_sets(df, text_col, words).select("id", away.cast("int").alias("away"), F.filter("g", lambda x: F.pmod(x, F.lit(1000)) < part).alias("s"))
    # written out: the shingles are made once for both that follow
    some = staged(some.select("id", (F.size("s") - F.col("away")).cast("int").alias("least"), "s"), "parts")
    free = some.filter("least <= 0").select("id")
    some = some.select("id", "least", F.explode("s").alias("key"))
    met = some.withColumn("c", F.count("key").over(Window.partitionBy("key"))).filter("c > 1 AND least > 0")
    enough = met.groupBy("id", "least").count().filter("count >= least").select("id")
    ids = staged(enough.unionByName(free).withColumnRenamed("id", "__x"), "linkable")
    return staged(shingle_sets(of_ids(df, ids), text_col, words), "shingles")


def prefix_keys(sets: DataFrame, similarity: float) -> DataFrame:
    """(id, n, alone, bits, key): the shingles of each set that a set of this Jaccard similarity must share one of.

    With shingles in one order, rarest first, two such sets share one of the first
    n - ceil(similarity * n) + 1 of each; shingles that stand in one text only come first and
    meet nothing. `alone` is their number, `bits` are the parities of the others, dealt over 64 * BITS (see `reachable`).
    """
    posts = sets.select("id", F.size("g").alias("n"), F.explode("g").alias("key"))
    common = posts.groupBy("key").count().filter("count > 1").select(F.col("key").alias("key2"), "count")
    word, bit = F.pmod("key", F.lit(BITS)), F.expr("shiftleft(1L, CAST(shiftrightunsigned(key, 58) AS INT))")
    parities = F.array(*[F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))) for i in range(BITS)])
    shared = posts.join(common.hint("merge"), F.col("key") == F.col("key2")).groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("count", "key"))).alias("s"), parities.alias("bits"))
    alone = F.col("n") - F.size("s")
    prefix = F.col("n") - F.ceil(F.round(F.col("n") * similarity, 9)) + 1 - alone
    return shared.filter(prefix > 0).select("id", "n", alone.alias("alone"), "bits", F.explode(F.slice("s", F.lit(1), prefix.cast("int"))["key"]).alias("key"))


def reachable(a: str, b: str, similarity: float) -> Column:
    """Whether sets of these (n, alone, bits), columns with {} for the name in `a` and `b`, can have this Jaccard similarity.

    No less is in one of them only than what is in no other set at all and one for each bit that differs.
    """
    n, m = (F.col(x.format("n")) for x in (a, b))
    apart = F.col(a.format("alone")) + F.col(b.format("alone"))
    for i in range(BITS):
        apart += F.bit_count(F.col(a.format("bits"))[i].bitwiseXOR(F.col(b.format("bits"))[i]))
    return (F.least(n, m) >= F.round(F.greatest(n, m) * similarity, 9)) & ((n + m - apart) / (n + m + apart) >= similarity)


def jaccard_of(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """id_a, id_b, similarity of those pairs (id_a, id_b) that reach it."""
    pairs = staged(pairs, "candidates")
    sets = of_ids(sets, staged(pairs.select(F.explode(F.array("id_a", "id_b")).alias("__x")).distinct(), "ids"))
    x, y = sets.select(F.col("id").alias("ia"), F.col("g").alias("ga")), sets.select(F.col("id").alias("ib"), F.col("g").alias("gb"))
    both = pairs.join(x.hint("merge"), F.col("id_a") == F.col("ia")).join(y.hint("merge"), F.col("id_b") == F.col("ib")).withColumn("k", F.size(F.array_intersect("ga", "gb")))
    return both.withColumn("similarity", F.col("k") / (F.size("ga") + F.size("gb") - F.col("k"))).filter(F.col("similarity") >= similarity).select("id_a", "id_b", "similarity")


def shingle_pairs(df: DataFrame, id_col: str, text_col: str, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """id_a, id_b, similarity: all pairs whose word-shingle sets have at least this Jaccard similarity.

    Texts should be distinct: equal ones are pairs like any other.  A group of k near copies
    has up to k * (k - 1) / 2 pairs; `groups.similar_groups` gives groups without them.
    """
    d = linkable_sets(df.select(F.col(id_col).alias("id"), F.col(text_col).alias(text_col)), text_col, similarity, words)
    keys = prefix_keys(d, similarity)
    a, b = (keys.select(*[F.col(c).alias(f"{c}_{x}") for c in keys.columns]) for x in "ab")
    pairs = a.join(b.hint("merge"), (F.col("key_a") == F.col("key_b")) & (F.col("id_a") < F.col("id_b")) & reachable("{}_a", "{}_b", similarity)).select("id_a", "id_b").distinct()
    return jaccard_of(pairs, d, similarity)


def catalog_join(datasets: DataFrame, files: DataFrame, key: str, file_id: str) -> DataFrame:
    """Every dataset with its sorted list of files."""
    lists = files.groupBy(key).agg(F.array_sort(F.collect_list(file_id)).alias("files"))
    return datasets.join(lists, key, "left").withColumn("n_files", F.coalesce(F.size("files"), F.lit(0)).cast("long"))


def tag_by_file(rows: DataFrame, catalog: DataFrame, path_col: str = "file_path") -> DataFrame:
    """The catalog's columns to rows that carry their file's path."""
    return rows.join(catalog, path_col, "left")


def attach_stats(df: DataFrame, **stats) -> DataFrame:
    """Every row beside the one-row aggregate of the table; one row is broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*[v.alias(k) for k, v in stats.items()])))
