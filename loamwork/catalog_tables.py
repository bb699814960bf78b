"""Registered queries over several tables and over states of tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, union
from .operators import asof, profile, profile_state, references, text_index
from .sources import writers

STAR = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey", "n_regionkey", "n_name"],
    "customer": ["c_custkey", "c_nationkey", "c_name"],
    "supplier": ["s_suppkey", "s_nationkey", "s_name"],
    "part": ["p_partkey", "p_size", "p_brand"],
    "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
}
TEXT = {"n_name", "c_name", "s_name", "p_brand"}
VALUES_SQL = union([f"SELECT '{t}.{c}' AS col, '{'text' if c in TEXT else 'number'}' AS kind, {c}::VARCHAR AS v FROM {t} WHERE {c} IS NOT NULL" for t, cs in STAR.items() for c in cs])


@query(f"""WITH a AS (SELECT col, kind, v, count(*) AS n FROM ({VALUES_SQL}) GROUP BY 1, 2, 3), s AS (SELECT col, count(*) AS n_values, max(n) = 1 AS is_key FROM a GROUP BY col),
f AS (SELECT x.col AS child, y.col AS parent, count(*) AS n_found FROM a x JOIN a y ON x.v = y.v AND x.kind = y.kind AND x.col <> y.col GROUP BY 1, 2)
SELECT child, parent, c.n_values, n_found, round(n_found / c.n_values::DOUBLE, 6) AS coverage FROM f JOIN s c ON c.col = child JOIN s p ON p.col = parent AND p.is_key WHERE n_found / c.n_values::DOUBLE >= 0.9""")
def references_found(get):
    """Which key columns of the star schema refer to which, found from their values."""
    found = references.inclusions({t: get(t).select(*cs) for t, cs in STAR.items()}, 0.9)
    return found.withColumn("coverage", F.round("coverage", 6))


@query("""WITH p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), e AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase')
SELECT event_id, e.user_id, round(p.value, 4) AS value_asof, epoch_us(e.ts) - epoch_us(p.ts) AS since_us FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_purchases(get):
    """Each event with its user's last purchase before it."""
    e = get("events")
    p = e.filter("event_type = 'purchase'").select("user_id", "ts", "value")
    d = asof.asof_join(e.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts"), p, ["user_id"], "ts", "ts")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return d.select("event_id", "user_id", F.round("value_asof", 4).alias("value_asof"), (us("ts") - us("ts_asof")).alias("since_us"))


@query("""WITH r AS (SELECT l_partkey, l_shipdate, max(l_extendedprice) AS price FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem WHERE l_returnflag <> 'R')
SELECT l_orderkey, l_linenumber, price AS price_asof FROM k ASOF LEFT JOIN r ON k.l_partkey = r.l_partkey AND k.l_shipdate >= r.l_shipdate""")
def asof_prices(get):
    """Each line with the price of its part's last return up to then; the dearer one of a day counts."""
    d = get("lineitem")
    r = d.filter("l_returnflag = 'R'").select("l_partkey", "l_shipdate", F.col("l_extendedprice").alias("price"))
    k = d.filter("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return asof.asof_join(k, r, ["l_partkey"], "l_shipdate", "l_shipdate").select("l_orderkey", "l_linenumber", "price_asof")


PHRASES = ["The ", "aND", "zqx", "e.", "2024", "user@"]


@query(union([f"SELECT '{p}' AS phrase, doc_id FROM documents WHERE contains(lower(text), lower('{p}'))" for p in PHRASES]))
def search_indexed(get):
    """Documents that hold a phrase in any case, by a posting table of trigrams."""
    d = get("documents").select("doc_id", "text")
    path = writers.work_path(d, "trigrams")
    text_index.write_index(d, "doc_id", "text", path)
    out = None
    for p in PHRASES:
        part = text_index.search_index(d, "doc_id", "text", path, p).select(F.lit(p).alias("phrase"), "doc_id")
        out = part if out is None else out.unionByName(part)
    return out


def _stored(get, label: str):
    """A table of the events' daily states, written once."""
    d = get("events").select("ts", "user_id", "value", "event_type", "props")
    return writers.staged(profile_state.states(d, F.to_date("ts"), ["user_id", "value", "event_type", "props"]), label)


@query("""SELECT 'user_id' AS column_name, count(*) AS n_rows, count(*) - count(user_id) AS null_count, min(user_id)::DOUBLE AS min, max(user_id)::DOUBLE AS max, true AS distinct_within, true AS ranks_within FROM events
UNION ALL SELECT 'value', count(*), count(*) - count(value), min(value), max(value), true, true FROM events
UNION ALL SELECT 'event_type', count(*), count(*) - count(event_type), NULL, NULL, true, NULL FROM events UNION ALL SELECT 'props', count(*), count(*) - count(props), NULL, NULL, true, NULL FROM events""")
def profile_from_states(get):
    """A profile out of merged daily states; whether its estimates keep their stated errors is measured on the table."""
    p = profile_state.profile(profile_state.merged(_stored(get, "states")))
    e = get("events")
    exact = profile.nulls_distinct(e.select("user_id", "value", "event_type", "props")).select(F.col("column_name").alias("c"), F.col("unique_count").alias("u"))
    q = p.filter("q50 IS NOT NULL").select("column_name", F.posexplode(F.array("q25", "q50", "q75")).alias("k", "q"))
    long = e.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in ("user_id", "value")])).alias("x")).select("x.*").filter("v IS NOT NULL")
    # the share of values up to a quantile, and of those below it
    at = long.join(F.broadcast(q), F.col("c") == F.col("column_name")).groupBy("c", "k").agg(F.avg((F.col("v") <= F.col("q")).cast("int")).alias("upto"), F.avg((F.col("v") < F.col("q")).cast("int")).alias("under"))  # six rows
    p_of, e_ = (F.col("k") + 1) / 4, profile_state.RANK_ERROR
    ranks = at.groupBy(F.col("c").alias("c2")).agg(F.every((F.col("upto") >= p_of - e_) & (F.col("under") <= p_of + e_)).alias("ranks_within"))
    d = p.join(exact.hint("merge"), F.col("column_name") == F.col("c")).join(ranks.hint("merge"), F.col("column_name") == F.col("c2"), "left")
    within = F.abs(F.col("unique_count") - F.col("u")) <= F.greatest(3 * profile_state.DISTINCT_ERROR * F.col("u"), F.lit(0.5))
    return d.select("column_name", "n_rows", "null_count", "min", "max", within.alias("distinct_within"), "ranks_within")


@query("SELECT 'event_type' AS column_name, event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def frequent_from_states(get):
    return profile_state.frequent(profile_state.merged(_stored(get, "states"))).filter("column_name = 'event_type'")


@query("""WITH h AS (SELECT min(ts)::DATE + ((max(ts)::DATE - min(ts)::DATE) // 2)::INT AS half FROM events), e AS (SELECT value, ts::DATE > half AS late FROM events, h WHERE value IS NOT NULL),
w AS (SELECT min(value) AS lo, (max(value) - min(value)) / 10 AS w FROM e WHERE NOT late),
b AS (SELECT least(greatest(ceil((value - lo) / w), 1), 10) AS bin, late FROM e, w),
p AS (SELECT bin, count(*) FILTER (NOT late) / (SELECT count(*) FROM b WHERE NOT late)::DOUBLE AS p, count(*) FILTER (late) / (SELECT count(*) FROM b WHERE late)::DOUBLE AS q FROM b GROUP BY bin)
SELECT 'value' AS column_name, round(sum((greatest(q, 0.0001) - greatest(p, 0.0001)) * ln(greatest(q, 0.0001) / greatest(p, 0.0001))), 1) AS psi FROM p""")
def drift_from_states(get):
    """Drift of the later half of the days against the earlier, from stored states alone."""
    s = _stored(get, "states")
    lo, hi = s.agg(F.min("day"), F.max("day")).first()
    half = lo + (hi - lo) // 2
    d = profile_state.drift(profile_state.merged(s.filter(F.col("day") > F.lit(half))), profile_state.merged(s.filter(F.col("day") <= F.lit(half))))
    return d.filter("column_name = 'value'").select("column_name", F.round("psi", 1).alias("psi"))
