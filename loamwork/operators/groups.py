"""Groups of similar rows: connected components over verified links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.writers import staged
from .joins import distinct_texts, jaccard_of, linkable_sets, prefix_keys, reachable


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of (u, v): every node of a link with the least node reachable from it.

    Rounds of large stars (later neighbours are hung on the least neighbour) and small stars
    (earlier ones too) until a round changes nothing.  Every round is a table in the shared
    folder; no group of links is gathered anywhere.
    """
    hung = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(rounds):
        for large in (True, False):
            around = hung.unionByName(hung.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else hung
            least = around.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("w"), F.least("u", "low").alias("low"))
            met = around.join(least.hint("merge"), F.col("u") == F.col("w"))
            moved = met.filter("v > u") if large else met
            new = moved.select(F.col("v").alias("u"), F.col("low").alias("v"))
            if not large:
                new = new.unionByName(met.select("u", F.col("low").alias("v")))
            hung = new.filter("u <> v").distinct()
        hung = staged(hung, "links")
        now = hung.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            ends = hung.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
            return ends.unionByName(ends.select(F.col("root").alias("node"), "root").distinct())
        seen = now
    raise RuntimeError("components did not settle")


#: Rounds of leaders before members of different components are compared one by one.
LEADERS = 6


def _mixed(keys: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(key, id, n, alone, bits, part): the lists with each member's component, without lists of one component."""
    if roots is None:
        lists = keys.withColumn("part", F.col("id"))
    else:
        lists = keys.join(roots.hint("merge"), F.col("id") == F.col("node"), "left").withColumn("part", F.coalesce("root", "id")).drop("node", "root")
    several = lists.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select(F.col("key").alias("key2"))
    return staged(lists.join(several.hint("merge"), F.col("key") == F.col("key2"), "left_semi"), "lists")


def _leader_pairs(lists: DataFrame, turn: int, similarity: float) -> DataFrame:
    """(id_a, id_b): each list's leader of this turn beside the members of other components."""
    lead = lists.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "id").alias("h"), "id", "n", "alone", "bits", "part")).alias("lead")).select(F.col("key").alias("key2"), "lead")
    met = lists.join(lead.hint("merge"), (F.col("key") == F.col("key2")) & (F.col("part") != F.col("lead.part")) & reachable("{}", "lead.{}", similarity))
    return met.select(F.least("id", "lead.id").alias("id_a"), F.greatest("id", "lead.id").alias("id_b")).distinct()


def _cross_pairs(lists: DataFrame, similarity: float) -> DataFrame:
    """(id_a, id_b): members of a list that are in different components.

    Who isn't of a list's largest component is set beside all others; lists of one component
    drop out, so a crowd of near copies is never paired with itself.
    """
    sizes = lists.groupBy("key", "part").count()
    top = sizes.groupBy("key").agg(F.max_by("part", F.struct("count", "part")).alias("top"), F.count("*").alias("parts")).filter("parts > 1").select(F.col("key").alias("key2"), "top")
    mixed = lists.join(top.hint("merge"), F.col("key") == F.col("key2")).drop("key2")
    a, b = (mixed.select(*[F.col(c).alias(f"{c}_{x}") for c in mixed.columns]) for x in "ab")
    once = (F.col("part_b") == F.col("top_b")) | (F.col("id_a") < F.col("id_b"))
    met = a.filter("part_a <> top_a").join(b.hint("merge"), (F.col("key_a") == F.col("key_b")) & (F.col("part_a") != F.col("part_b")) & once & reachable("{}_a", "{}_b", similarity))
    return met.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def similar_groups(df: DataFrame, id_col: str, text_col: str, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """(id, group_id, n_rows): each row's group and its size; group_id is the least id of the group.

    Texts link if the Jaccard similarity of their word-shingle sets is at least `similarity`;
    a group is all that links reach.  Equal texts are one node.  Texts aren't moved, nor the
    shingles of those that can't link.  Candidates are the lists of an exact prefix filter.  Each list's members are first verified against a leader, another one
    each round, which draws a crowd of near copies together with comparisons that grow with
    the crowd and not with its square; lists of one component drop out.  What is left after
    LEADERS rounds, or when a round links nothing, is compared pair by pair across components.  Nothing
    is missed: pairs left out are connected already.
    Rows of null text are groups of their own; ids must be unique.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    firsts, reps = distinct_texts(rows)
    sets = linkable_sets(firsts, "text", similarity, words)
    keys = staged(prefix_keys(sets, similarity), "keys")
    roots, lists = None, _mixed(keys, None)
    for turn in range(LEADERS + 1):
        pairs = _cross_pairs(lists, similarity) if turn == LEADERS else _leader_pairs(lists, turn, similarity)
        found = staged(jaccard_of(pairs, sets, similarity).select(F.col("id_a").alias("u"), F.col("id_b").alias("v")), "links")
        if not found.limit(1).take(1):
            if turn < LEADERS:
                found = jaccard_of(_cross_pairs(lists, similarity), sets, similarity).select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))
            turn = LEADERS
        roots = staged(components(found if roots is None else found.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))), "roots")
        if turn == LEADERS:
            break
        lists = _mixed(keys, roots)
        if not lists.limit(1).take(1):
            break
    of = reps.join(roots.hint("merge"), F.col("rep") == F.col("node"), "left").select("id", F.coalesce("root", "rep").alias("group_id"))
    named = staged(of.unionByName(rows.filter("text IS NULL").select("id", F.col("id").alias("group_id"))), "groups")
    sizes = named.groupBy(F.col("group_id").alias("g")).agg(F.count("*").alias("n_rows"))
    return named.join(sizes.hint("merge"), F.col("group_id") == F.col("g")).select("id", "group_id", "n_rows")
