"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash.  Tokens (here words) are summed by source
and leading hash bits; the bucket in which a source's running sum passes its budget is the
only one refined, by the next bits, until it holds a single hash.  What is taken is then a
plain filter `hash < threshold` per source: no sort, nothing but sums leaves a task, and a
larger budget takes a superset of a smaller one.

Targets: sources by code point (null last) weigh `weights`, repeating, and share all words;
a target stops at `epochs` times its source's words and the excess is shared again by weight.
A target of q whole epochs and a rest takes every document q times and those under the
threshold once more.  The document at the threshold is taken if that brings the source
nearer to its target.

Null texts and texts without words have size 0 and take 0 words.  Null sources are a source.
Where ids are unique and present, a document's hash is that of its id; in a table where some
are null or repeated, that of its id, text, source and its number among equal rows, so that
rows of one id are taken apart and every source still comes near its target.  An empty table
gives no rows.  Other columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, ids_serve, in_order, join_checked, staged

WEIGHTS, EPOCHS, SEED = (5, 2, 1), 3, "mix"
HASH_BITS, STEP = 60, 10


def hash60(*parts, seed: str = SEED):
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def hashed(docs: DataFrame, seed: str = SEED) -> tuple[DataFrame, str]:
    """(docs with a column, its name): the fixed hash of each row.

    Equal rows are numbered within each part of the sorted table, from where the parts before
    it end, so a third of all rows may be equal.
    """
    name, number = fresh(docs, "__h"), fresh(docs, "__n")
    if ids_serve(docs):
        return docs.withColumn(name, hash60(F.col("doc_id").cast("long"), seed=seed)), name
    rows = staged(in_order(docs, "doc_id", "source").withColumn(number, F.monotonically_increasing_id()), "ordered")
    keyed = rows.select(F.col(number).alias("n1"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text", "source").alias("tie"), F.shiftright(number, 33).alias("part"))
    parts = keyed.groupBy("id", "tie", "part").agg(F.count("*").alias("n"), F.min("n1").alias("low"))
    before = F.sum("n").over(Window.partitionBy("id", "tie").orderBy("part")) - F.col("n")
    parts = parts.select(F.col("id").alias("id2"), F.col("tie").alias("tie2"), F.col("part").alias("part2"), "low", before.alias("before"))
    met = keyed.join(parts.hint("merge"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("tie") == F.col("tie2")) & (F.col("part") == F.col("part2")))
    own = met.select(F.col("n1").alias("__own"), hash60(F.col("id"), F.col("tie"), F.col("n1") - F.col("low") + F.col("before"), seed=seed).alias(name)).hint("merge")
    return rows.join(own, rows[number] == own["__own"]).select(*[rows[c] for c in docs.columns], own[name]), name


def sizes_of(rows: DataFrame, name: str) -> DataFrame:
    """(doc_id, source, size, h) of every row; `name` holds its hash."""
    return rows.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.col(name).alias("h"))


def targets(totals: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    One row per source: the windows below run over sources, not documents.  Capped sources
    are those of the least cap per weight; the first whose share by weight stays under its
    cap sets the share of all that follow.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (place % len(weights) + 1).cast("int")).cast("long")
    t = totals.withColumn("weight", w).withColumn("cap", F.col("source_size") * epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    t = t.withColumns(
        {
            "all_words": F.sum("source_size").over(whole),
            "capped": F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"),
            "sharing": F.sum("weight").over(whole) - F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("weight"),
        }
    )
    t = t.withColumn("share", (F.col("all_words") - F.col("capped")).cast("double") / F.col("sharing"))
    t = t.withColumn("level", F.min(F.when(F.col("share") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "share"))).over(whole)["share"])
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return t.select("source", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, q, tau) from staged sizes and goals."""
    q = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = staged(goals.withColumn("q", q).withColumn("budget", F.col("target") - F.col("q") * F.col("source_size")), "goals")
    at = goals.select("source", "budget", F.lit(0.0).alias("base"))
    rows, done = sizes.select("source", "size", "h"), None
    for level in range(HASH_BITS // STEP):
        bucket = F.shiftright("h", HASH_BITS - STEP * (level + 1))
        sums = rows.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high"))
        sums = join_checked(sums, at, ["source"], "inner")
        run = F.sum("words").over(Window.partitionBy("source").orderBy("b"))
        over = sums.withColumn("after", F.col("base") + run).filter(F.col("after") > F.col("budget"))
        first = over.groupBy("source").agg(F.min_by(F.struct("b", "words", "low", "high", "after", "budget"), "b").alias("x")).select("source", "x.*")
        first = staged(first.withColumn("base", F.col("after") - F.col("words")), "boundary")
        nearer = F.abs(F.col("after") - F.col("budget")) < F.abs(F.col("base") - F.col("budget"))
        settled = first.filter("low = high").select("source", (F.col("low") + nearer.cast("long")).alias("tau"))
        done = settled if done is None else done.unionByName(settled)
        left = first.filter("low < high")
        if not left.limit(1).take(1):
            break
        at = left.select("source", "budget", "base")
        edge = left.select("source", F.col("b").alias("edge"))
        rows = join_checked(rows, edge, ["source"], "inner").filter(bucket == F.col("edge")).select("source", "size", "h")
    done = staged(done, "thresholds")
    # a source whose budget no bucket passes is taken whole once more
    return join_checked(goals, done, ["source"]).select("source", "source_size", "target", "q", F.coalesce("tau", F.lit(1 << HASH_BITS)).alias("tau"))


def plan_of(rows: DataFrame, name: str, weights=WEIGHTS, epochs: int = EPOCHS) -> tuple[DataFrame, DataFrame]:
    """(sizes of the hashed rows, one row per source with its target and threshold), both staged."""
    sizes = staged(sizes_of(rows, name), "sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    return sizes, staged(thresholds(sizes, targets(totals, weights, epochs)), "plan")


def repeats_of(h, epochs: int):
    return F.least(F.col("q") + (h < F.col("tau")).cast("long"), F.lit(epochs))


def mix(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, repeats, taken) for every row of docs."""
    sizes, plan = plan_of(*hashed(docs, seed), weights, epochs)
    out = join_checked(sizes, plan, ["source"], "inner").withColumn("repeats", repeats_of(F.col("h"), epochs))
    return out.select("doc_id", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def mixture(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The rows of docs, with all their columns, as often as the mix takes each.

    Texts stay where they are: sources' thresholds come to them.
    """
    found, name = hashed(docs, seed)
    plan = plan_of(found, name, weights, epochs)[1].select(F.col("source").alias("__source"), F.col("q"), F.col("tau"))
    rows = found.select(F.struct(*docs.columns).alias("__row"), F.col("source").cast("string").alias("__source"), F.col(name).alias("__h"))
    out = join_checked(rows, plan, ["__source"], "inner").withColumn("__n", repeats_of(F.col("__h"), epochs).cast("int"))
    return out.filter("__n > 0").select("__row", F.explode(F.array_repeat(F.lit(0), F.col("__n")))).select("__row.*")


def oracle(weights=WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> str:
    """The same rows in DuckDB SQL, by sorting."""
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ({list(weights)})[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1)::INT]::BIGINT AS weight FROM d GROUP BY source),
c AS (SELECT *, {epochs} * source_size AS cap, sum(source_size) OVER () AS total,
             sum({epochs} * source_size) OVER o - {epochs} * source_size AS capped,
             sum(weight) OVER () - sum(weight) OVER o + weight AS sharing
      FROM s WINDOW o AS (ORDER BY ({epochs} * source_size)::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT (total - capped)::DOUBLE / sharing AS share FROM c WHERE (total - capped)::DOUBLE / sharing <= cap::DOUBLE / weight ORDER BY cap::DOUBLE / weight, source NULLS LAST LIMIT 1),
g AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, (SELECT share FROM l) * weight), cap::DOUBLE) AS target FROM c),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS q FROM g),
h AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
r AS (SELECT h.source, h.h, words, sum(words) OVER (PARTITION BY h.source ORDER BY h.h) AS after, target - q * source_size AS budget
      FROM h JOIN b ON h.source IS NOT DISTINCT FROM b.source),
t AS (SELECT source, min(h) AS h, arg_min(abs(after - budget) < abs(after - words - budget), h)::INT AS inside FROM r WHERE after > budget GROUP BY source)
SELECT d.doc_id, d.size, b.source_size, b.target,
       d.size * least({epochs}, b.q + CASE WHEN t.h IS NULL OR d.h < t.h + t.inside THEN 1 ELSE 0 END)::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN t ON d.source IS NOT DISTINCT FROM t.source AND t.h IS NOT NULL"""
