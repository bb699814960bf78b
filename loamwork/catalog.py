"""Registered queries of the library's own operators, each beside its DuckDB SQL.

A query is (spark, sf_dir) -> DataFrame over the whole given tables, or over tables derived
from them (`plans.derived`).  Queries whose results SQL can't express have no SQL and are
tested against hand-made or brute-force results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions.missing import long_rows
from .operators import assembly, checks, cleaning, documents, edit_join, fusion, groups, joins, metrics, ordering, pii_masking, profile, task_checks, transforms
from .plans import pipeline
from .plans.derived import spark_table, with_derived
from .sources import readers
from .streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, derived: tuple[str, ...] = ()):
    """Register fn(get) under its name; get(name) is a given or derived table."""

    def add(fn):
        from .plans.derived import DERIVED

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda n: spark_table(spark, sf_dir, n) if n in DERIVED else table(spark, sf_dir, n))

        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = with_derived(sql, *derived) if derived else sql
        return fn

    return add


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_NUMBERS = LINEITEM[:8]


def filled_counts(df: DataFrame) -> DataFrame:
    """column_name, n: which columns there are, and how many values each has."""
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n__{i}") for i, c in enumerate(df.columns)])
    return long_rows(row, df.columns, {"n": "long"})


def stats_sql(tab: str, cols: list[str]) -> str:
    return union([f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS min, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS q50, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q75, round(max({c})::DOUBLE, 4) AS max FROM {tab}" for c in cols])


# ---------------------------------------------------------------- profiles


@query(union([f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS null_count, round(100.0 * (count(*) - count({c})) / count(*), 6) AS null_pct, count(DISTINCT {c}) AS unique_count, round(100.0 * count(DISTINCT {c}) / count(*), 6) AS unique_pct FROM lineitem" for c in LINEITEM]))
def profile_nulls(get):
    return profile.nulls_distinct(get("lineitem"))


@query(stats_sql("lineitem", LINE_NUMBERS))
def profile_numeric(get):
    return profile.numeric_stats(get("lineitem"))


@query(
    union([f"SELECT '{c}' AS column_name, rank, value, n FROM (SELECT {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM orders WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 5" for c in ("o_orderstatus", "o_orderpriority")])
)
def profile_topk(get):
    return profile.top_values(get("orders"), ["o_orderstatus", "o_orderpriority"])


@query(union([f"SELECT '{c}' AS column_name, round(avg(length({c})), 6) AS avg_length, max(length({c})) AS max_length, count(*) FILTER ({c} = '') AS empty_strings, count(*) FILTER (regexp_matches({c}, '^\\s|\\s$')) AS whitespace_issues FROM documents" for c in ("text", "lang", "source")]))
def profile_strings(get):
    return profile.string_stats(get("documents"))


@query("SELECT * FROM (" + union([f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[i + 1 :]]) + ")")
def correlations(get):
    return profile.correlations(get("lineitem"))


@query("SELECT 'value' AS column_name, round(skewness(value), 6) AS skewness, round(kurtosis(value), 6) AS kurtosis FROM events")
def moments(get):
    return profile.shape(get("events"), ["value"])


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT least(greatest(ceil((value - lo) / ((hi - lo) / 10)), 1), 10)::BIGINT AS bin, count(*) AS n FROM events, e GROUP BY 1""")
def histogram10(get):
    return profile.histogram(get("events"), "value")


@query("SELECT round((count(c_custkey) + count(c_acctbal) + count(c_mktsegment) + count(c_nationkey)) / (4.0 * count(*)), 6) AS completeness FROM dirty_customer", ("dirty_customer",))
def completeness(get):
    return profile.completeness(get("dirty_customer")).select(F.round("completeness", 6).alias("completeness"))


@query("SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_distinct, sum(n - 1)::BIGINT AS n_duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)")
def duplicate_rows(get):
    return profile.duplicate_rows(get("documents"), ["text", "lang"])


@query("""WITH p AS (SELECT 'c_custkey' AS column_name, false AS texts, count(*) AS n, count(c_custkey) AS f, count(DISTINCT c_custkey) AS u FROM dirty_customer
 UNION ALL SELECT 'c_acctbal', false, count(*), count(c_acctbal), count(DISTINCT c_acctbal) FROM dirty_customer
 UNION ALL SELECT 'c_mktsegment', true, count(*), count(c_mktsegment), count(DISTINCT c_mktsegment) FROM dirty_customer
 UNION ALL SELECT 'c_nationkey', false, count(*), count(c_nationkey), count(DISTINCT c_nationkey) FROM dirty_customer
 UNION ALL SELECT 'one', true, count(*), count(*), 1 FROM dirty_customer)
SELECT column_name, 'high_missing' AS insight FROM p WHERE 100.0 * (n - f) / n > 20
UNION ALL SELECT column_name, 'high_cardinality' FROM p WHERE texts AND 100.0 * u / n > 95
UNION ALL SELECT column_name, 'constant' FROM p WHERE u = 1""", ("dirty_customer",))
def insights(get):
    return profile.insights(get("dirty_customer").withColumn("one", F.lit("x")))


@query("SELECT 1.0 - avg(CASE WHEN abs(c) > 0.9 THEN 1.0 ELSE 0.0 END) AS redundancy FROM (" + union([f"SELECT corr({a}, {b}) AS c FROM lineitem" for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[i + 1 :]]) + ")")
def redundancy(get):
    return profile.redundancy(get("lineitem"))


@query("SELECT l_extendedprice, l_partkey, l_orderkey, l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def variance_topk(get):
    return profile.variance_top_k(get("lineitem"), k=3, threshold=5)


@query("SELECT column_name, n FROM (" + union([f"SELECT '{c}' AS column_name, {f'var_samp({c})' if c in LINE_NUMBERS else 'NULL'} AS v, count({c}) AS n FROM lineitem" for c in LINEITEM]) + ") QUALIFY v IS NULL OR row_number() OVER (PARTITION BY v IS NULL ORDER BY v DESC, column_name) <= 4")
def variance_columns(get):
    return filled_counts(profile.variance_top_k(get("lineitem").select(*LINEITEM), k=4, threshold=5))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1), n AS (SELECT v, row_number() OVER (ORDER BY day) AS pos FROM d)
SELECT round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(regr_slope(v, pos), 4) AS slope FROM n""")
def trend(get):
    d = get("events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    t = profile.trend(joins.positioned(d, ["day"], "pos"), "v", "pos")
    return t.select(*[F.round(c, 4).alias(c) for c in t.columns])


@query("SELECT o_orderpriority, count(o_orderkey) AS n, round(avg(o_totalprice), 4) AS mean_price, max(o_totalprice) AS top_price FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def group_aggregate(get):
    d = profile.group_aggregate(get("orders"), ["o_orderpriority"], {"n": ("o_orderkey", "count"), "mean_price": ("o_totalprice", "avg"), "top_price": ("o_totalprice", "max")})
    return d.withColumn("mean_price", F.round("mean_price", 4))


ISSUES_SQL = """WITH i AS (SELECT CASE WHEN status = 'failed' THEN 'invalid_values' ELSE 'outliers' END AS issue_type, CASE WHEN execution_time_seconds > 100 THEN 'high' ELSE 'low' END AS severity, concat('p', pipeline_id::VARCHAR) AS column_name FROM executions)
SELECT 'issue_type' AS dimension, issue_type AS value, count(*) AS n FROM i GROUP BY issue_type UNION ALL SELECT 'severity', severity, count(*) FROM i GROUP BY severity UNION ALL SELECT 'column_name', column_name, count(*) FROM i GROUP BY column_name"""


@query(ISSUES_SQL, ("executions",))
def issue_summary(get):
    i = get("executions").select(F.when(F.col("status") == "failed", "invalid_values").otherwise("outliers").alias("issue_type"), F.when(F.col("execution_time_seconds") > 100, "high").otherwise("low").alias("severity"), F.concat(F.lit("p"), F.col("pipeline_id").cast("string")).alias("column_name"))
    return profile.issue_summary(i)


# ---------------------------------------------------------------- transforms, joins, orders


@query("SELECT l_orderkey AS order_id, l_quantity AS qty, l_returnflag FROM lineitem WHERE l_quantity > 40 AND l_returnflag IN ('A', 'R')")
def filter_select_rename(get):
    d = transforms.filter_rows(get("lineitem"), "l_quantity > 40 & l_returnflag in ['A', 'R']")
    return transforms.rename(transforms.select(d, ["l_orderkey", "l_quantity", "l_returnflag"]), {"l_orderkey": "order_id", "l_quantity": "qty", "nothing": "x"})


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, total_text FROM dirty_orders", ("dirty_orders",))
def safe_cast(get):
    d = get("dirty_orders").select("o_orderkey", "total_text")
    return transforms.cast(d, {"o_orderkey": "string", "total_text": "double"})


@query("SELECT event_id, user_id, event_type FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 1000")
def hash_sample(get):
    return transforms.sample_by_hash(get("events"), ["event_id"], 1000).select("event_id", "user_id", "event_type")


@query("SELECT c_custkey AS key, c_name AS name, c_acctbal AS bal, NULL::INTEGER AS size FROM customer UNION ALL SELECT p_partkey, p_name, NULL, p_size FROM part")
def union_by_name(get):
    return ordering.union_all([get("customer").selectExpr("c_custkey AS key", "c_name AS name", "c_acctbal AS bal"), get("part").selectExpr("p_partkey AS key", "p_name AS name", "p_size AS size")])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1")
def dedup_keep_first(get):
    d = cleaning.remove_duplicates(get("lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) > 1 AS is_repeat FROM lineitem")
def mark_repeats(get):
    return ordering.mark_repeats(get("lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "is_repeat")


@query("SELECT doc_id, source, floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 5)::BIGINT AS batch_index, ceil(count(*) OVER (PARTITION BY source) / 5.0)::BIGINT AS batch_total FROM documents")
def batch_assign(get):
    return ordering.batches(get("documents").select("doc_id", "source"), 5, ["doc_id"], ["source"])


@query("SELECT o_orderkey, floor((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) / 1000)::BIGINT AS batch_index, (SELECT ceil(count(*) / 1000.0)::BIGINT FROM orders) AS batch_total FROM orders")
def batch_whole_table(get):
    return ordering.batches(get("orders").select("o_orderkey", "o_orderdate"), 1000, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT pipeline_id, arg_max(execution_id, ts) AS execution_id FROM executions WHERE status = 'completed' GROUP BY pipeline_id", ("executions",))
def latest_completed(get):
    return ordering.latest(get("executions").filter("status = 'completed'"), ["pipeline_id"], "execution_id", "ts")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def newest_page(get):
    return ordering.newest(get("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, 40, ["o_orderkey"])


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(get):
    return ordering.distinct(get("lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%1%' OR p_type ILIKE '%an%'")
def search_parts(get):
    d = get("part").select("p_partkey", "p_name", "p_type")
    return ordering.search(d, "1", ["p_name"]).unionByName(ordering.search(d, "AN", ["p_type"])).dropDuplicates()


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 50")
def paged_read(get):
    return readers.page(get("orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 100, 50)


@query("SELECT c_custkey, c_mktsegment, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_step(get):
    o = get("orders").selectExpr("o_custkey AS c_custkey", "o_orderkey")
    return pipeline.run([{"name": "j", "type": "join", "depends_on": ["c", "o"], "config": {"inputs": ["c", "o"], "keys": ["c_custkey"], "how": "left"}}], o, {"c": get("customer").select("c_custkey", "c_mktsegment"), "o": o})["j"]


@query("""WITH a AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_custkey) AS p FROM customer), b AS (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_suppkey) AS p FROM supplier)
SELECT c_custkey, c_acctbal AS v_left, s_suppkey, s_acctbal AS v_right FROM a FULL JOIN b USING (p)""")
def align_positions(get):
    return joins.column_concat(get("customer").selectExpr("c_custkey", "c_acctbal AS v"), get("supplier").selectExpr("s_suppkey", "s_acctbal AS v"), (["c_custkey"], ["s_suppkey"]))


@query("SELECT o_orderkey, o_custkey FROM dirty_orphans WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)", ("dirty_orphans",))
def referential(get):
    return joins.orphans(get("dirty_orphans"), get("customer"), "o_custkey", "c_custkey")


@query("""SELECT a.p_partkey AS key_a, b.p_partkey AS key_b, round(1 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)), 6) AS similarity
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey
WHERE 1 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)) >= 0.6""")
def fuzzy_parts(get):
    p = get("part").select("p_partkey", "p_name", F.concat_ws("|", "p_brand", "p_type", "p_size").alias("k"))
    a, b = p.selectExpr("p_partkey AS key_a", "p_name AS name_a", "k AS k_a"), p.selectExpr("p_partkey AS key_b", "p_name AS name_b", "k AS k_b")
    d = joins.fuzzy_join(a, b, "name_a", "name_b", ("k_a", "k_b"), 0.6).filter("key_a < key_b")
    return d.select("key_a", "key_b", F.round("similarity", 6).alias("similarity"))


@query("""WITH c AS (SELECT p_name, min(p_partkey) AS k, count(*) AS n FROM part GROUP BY p_name)
SELECT a.k AS id_a, b.k AS id_b, levenshtein(a.p_name, b.p_name) AS edits, a.n AS n_a, b.n AS n_b FROM c a JOIN c b ON a.k < b.k AND levenshtein(a.p_name, b.p_name) <= 2""")
def fuzzy_names(get):
    return edit_join.edit_pairs(get("part"), "p_partkey", "p_name", 2)


@query("""WITH c AS (SELECT url, min(page_id) AS class_id FROM pages GROUP BY url), n AS (SELECT a.url, count(*) AS n FROM c a JOIN c b ON a.url <> b.url AND abs(length(a.url) - length(b.url)) <= 2 AND levenshtein(a.url, b.url) <= 2 GROUP BY a.url)
SELECT page_id, class_id, coalesce(n, 0) AS n_links FROM pages JOIN c USING (url) LEFT JOIN n USING (url)""")
def fuzzy_urls(get):
    return edit_join.edit_links(get("pages").select("page_id", "url"), "page_id", "url", 2).select("page_id", "class_id", "n_links")


@query("""SELECT a.w AS a, b.w AS b, levenshtein(a.w, b.w) AS edits FROM (SELECT DISTINCT lower(p_name) AS w FROM part) a JOIN (SELECT DISTINCT unnest(string_split(p_name, ' ')) || ' ' || lower(p_type) AS w FROM part) b ON levenshtein(a.w, b.w) <= 3""")
def fuzzy_two_tables(get):
    """Names of parts beside their words with the type, within three edits."""
    a = get("part").select(F.lower("p_name").alias("w"))
    b = get("part").select(F.explode(F.split("p_name", " ")).alias("v"), F.lower("p_type").alias("t")).select(F.concat_ws(" ", "v", "t").alias("w"))
    return edit_join.edit_join(a, b, "w", "w", 3)


@query("SELECT n_nationkey, n_name, array_to_string(list_sort(list(s_suppkey) FILTER (s_suppkey IS NOT NULL)), ',') AS files, count(s_suppkey) AS n_files FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1, 2")
def catalog_join(get):
    files = get("supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    d = joins.catalog_join(get("nation").select("n_nationkey", "n_name"), files, "n_nationkey", "s_suppkey")
    return d.withColumn("files", F.array_join("files", ","))


@query("WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) SELECT event_id, round((value - m) / s, 4) AS z FROM events, s WHERE abs((value - m) / s) > 3")
def stats_attach(get):
    d = joins.attach_stats(get("events").select("event_id", "value"), m=F.avg("value"), s=F.stddev_samp("value"))
    return d.select("event_id", F.round((F.col("value") - F.col("m")) / F.col("s"), 4).alias("z"), ((F.col("value") - F.col("m")) / F.col("s")).alias("raw")).filter("abs(raw) > 3").drop("raw")


# ---------------------------------------------------------------- quality checks

MISSING_SQL = """SELECT 'missing_values' AS issue_type, CASE WHEN r > .5 THEN 'critical' WHEN r > .2 THEN 'high' WHEN r > .1 THEN 'medium' ELSE 'low' END AS severity, column_name, n AS n_affected, round(r, 6) AS ratio FROM (
SELECT 'c_acctbal' AS column_name, count(*) - count(c_acctbal) AS n, (count(*) - count(c_acctbal)) / count(*)::DOUBLE AS r FROM dirty_customer UNION ALL
SELECT 'c_mktsegment', count(*) - count(c_mktsegment), (count(*) - count(c_mktsegment)) / count(*)::DOUBLE FROM dirty_customer) WHERE n > 0"""


def plain(found: DataFrame) -> DataFrame:
    return found.select("issue_type", "severity", "column_name", "n_affected", F.round("ratio", 6).alias("ratio"))


@query(MISSING_SQL, ("dirty_customer",))
def check_missing(get):
    return plain(checks.check_missing(get("dirty_customer")))


DUPLICATES_SQL = """SELECT 'duplicates' AS issue_type, CASE WHEN sum(n - 1) / sum(n)::DOUBLE > .05 THEN 'high' ELSE 'medium' END AS severity, NULL::VARCHAR AS column_name, sum(n - 1)::BIGINT AS n_affected, round(sum(n - 1) / sum(n)::DOUBLE, 6) AS ratio
FROM (SELECT count(*) AS n FROM dirty_customer GROUP BY c_custkey, c_acctbal, c_mktsegment, c_nationkey)"""


@query(DUPLICATES_SQL, ("dirty_customer",))
def check_duplicates(get):
    return plain(checks.check_duplicates(get("dirty_customer")))


DUP_IDS_SQL = union([f"SELECT 'duplicates' AS issue_type, 'critical' AS severity, '{c}' AS column_name, n AS n_affected, round(n / t::DOUBLE, 6) AS ratio FROM (SELECT count(*) - count(DISTINCT {c}) AS n, count(*) AS t FROM dirty_customer) WHERE n > 0" for c in ("c_custkey", "c_nationkey")])


@query(DUP_IDS_SQL, ("dirty_customer",))
def check_dup_ids(get):
    return plain(checks.check_identifiers(get("dirty_customer")))


OUTLIER_SQL = """WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS s, quantile_cont(value, .25) AS q1, quantile_cont(value, .75) AS q3, count(*) AS n FROM events),
c AS (SELECT count(*) FILTER (abs((value - m) / s) > 3) AS z, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS f, any_value(n) AS n FROM events, s)
SELECT 'outliers' AS issue_type, 'medium' AS severity, 'value' AS column_name, z AS n_affected, round(z / n::DOUBLE, 6) AS ratio FROM c WHERE z > 0 UNION ALL SELECT 'outliers', 'low', 'value', f, round(f / n::DOUBLE, 6) FROM c WHERE f > 1.5 * z"""


@query(OUTLIER_SQL)
def check_outliers(get):
    return plain(checks.check_outliers(get("events"), ["value"]))


@query("""WITH d AS (SELECT count(*) AS n, count(*) FILTER (order_date_text = 'invalid') AS un, count(*) FILTER (total_text = 'n/a') AS bad FROM dirty_orders)
SELECT 'inconsistent_formats' AS issue_type, 'medium' AS severity, 'order_date_text' AS column_name, un AS n_affected, round(un / n::DOUBLE, 6) AS ratio FROM d UNION ALL SELECT 'inconsistent_formats', 'high', 'total_text', bad, round(bad / n::DOUBLE, 6) FROM d""", ("dirty_orders",))
def check_dates_numbers(get):
    return plain(checks.check_formats(get("dirty_orders").select("order_date_text", "total_text")))


CASE_SQL = """WITH v AS (SELECT c_mktsegment AS v FROM dirty_customer WHERE c_mktsegment IS NOT NULL), w AS (SELECT count(*) FILTER (v <> trim(v)) AS n, count(*) AS t FROM v),
g AS (SELECT sum(k) AS t, sum(k) FILTER (k > 1) AS n FROM (SELECT count(DISTINCT v) AS k FROM v GROUP BY lower(v)))
SELECT 'inconsistent_formats' AS issue_type, 'low' AS severity, 'c_mktsegment' AS column_name, n AS n_affected, round(n / t::DOUBLE, 6) AS ratio FROM w UNION ALL SELECT 'inconsistent_formats', 'medium', 'c_mktsegment', n::BIGINT, round(n / t::DOUBLE, 6) FROM g"""


@query(CASE_SQL, ("dirty_customer",))
def check_whitespace_case(get):
    return plain(checks.check_formats(get("dirty_customer")))


@query("SELECT * FROM (" + union([f"SELECT 'text' AS column_name, '{t}' AS pii_type, count(*) FILTER (regexp_matches(text, '{p}')) AS n FROM documents" for t, p in checks.PII.items()]) + ") WHERE n > 0")
def check_pii(get):
    return checks.pii_counts(get("documents"), ["text"])


@query("""SELECT 'business_rule_violations' AS issue_type, 'high' AS severity, column_name, n AS n_affected, round(n / t::DOUBLE, 6) AS ratio FROM (
SELECT 'c_acctbal' AS column_name, count(*) FILTER (c_acctbal < 0 OR c_acctbal > 9000) AS n, count(*) AS t FROM dirty_customer UNION ALL
SELECT 'c_mktsegment', count(*) FILTER (NOT coalesce(regexp_matches(c_mktsegment, '^(?:[A-Z]+$)'), false)), count(*) FROM dirty_customer UNION ALL
SELECT 'c_nationkey', count(*) FILTER (c_nationkey NOT IN (1, 2, 3)), count(*) FROM dirty_customer UNION ALL
SELECT 'c_custkey', count(*) FILTER (NOT coalesce(c_custkey > c_nationkey, true)), count(*) FROM dirty_customer) WHERE n > 0""", ("dirty_customer",))
def check_rules(get):
    rules = [{"type": "range", "column": "c_acctbal", "min": 0, "max": 9000}, {"type": "regex", "column": "c_mktsegment", "pattern": "[A-Z]+$"}, {"type": "enum", "column": "c_nationkey", "values": [1, 2, 3]}, {"type": "predicate", "column": "c_custkey", "condition": "c_custkey > c_nationkey"}]
    return plain(checks.check_rules(get("dirty_customer"), rules))


@query("""WITH w AS (SELECT sum(w) AS w, count(*) AS n, count(*) FILTER (sev = 'critical') AS c FROM (
SELECT CASE WHEN r > .5 THEN 10.0 WHEN r > .2 THEN 5.0 WHEN r > .1 THEN 2.0 ELSE 1.0 END AS w, CASE WHEN r > .5 THEN 'critical' ELSE 'x' END AS sev FROM (SELECT (count(*) - count(c_acctbal)) / count(*)::DOUBLE AS r FROM dirty_customer UNION ALL SELECT (count(*) - count(c_mktsegment)) / count(*)::DOUBLE FROM dirty_customer) WHERE r > 0)),
k AS (SELECT (count(c_custkey) + count(c_acctbal) + count(c_mktsegment) + count(c_nationkey)) / (4.0 * count(*)) AS completeness FROM dirty_customer)
SELECT round(greatest(0, 100 - least(2 * w, 100)) * 0.8 + 20 * completeness, 4) AS overall_score, round(completeness, 6) AS completeness, n AS n_issues, c AS n_critical FROM w, k""", ("dirty_customer",))
def quality_score(get):
    d = get("dirty_customer")
    s = checks.overall_score(d, checks.check_missing(d))
    return s.withColumns({"overall_score": F.round("overall_score", 4), "completeness": F.round("completeness", 6)})


@query("""SELECT column_name, greatest(0.0, 100 - 5 * w)::DOUBLE AS score FROM (
SELECT 'c_acctbal' AS column_name, CASE WHEN r > .5 THEN 10 WHEN r > .2 THEN 5 WHEN r > .1 THEN 2 ELSE 1 END AS w FROM (SELECT (count(*) - count(c_acctbal)) / count(*)::DOUBLE AS r FROM dirty_customer) UNION ALL
SELECT 'c_mktsegment', CASE WHEN r > .5 THEN 10 WHEN r > .2 THEN 5 WHEN r > .1 THEN 2 ELSE 1 END FROM (SELECT (count(*) - count(c_mktsegment)) / count(*)::DOUBLE AS r FROM dirty_customer) UNION ALL SELECT 'c_custkey', 0 UNION ALL SELECT 'c_nationkey', 0)""", ("dirty_customer",))
def column_scores(get):
    d = get("dirty_customer")
    return checks.column_scores(d, checks.check_missing(d))


def outlier_sql(tab: str, c: str) -> str:
    return f"""SELECT 'outliers' AS issue_type, unnest(['medium', 'low']) AS severity, '{c}' AS column_name, unnest([z, CASE WHEN q3 > q1 AND f > 1.5 * z THEN f ELSE 0 END]) AS n_affected, n AS n_all
FROM (SELECT count(*) FILTER (abs(({c} - m) / s) > 3) AS z, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS f, any_value(n) AS n, any_value(q1) AS q1, any_value(q3) AS q3
FROM {tab}, (SELECT avg({c}) AS m, stddev_samp({c}) AS s, quantile_cont({c}::DOUBLE, .25) AS q1, quantile_cont({c}::DOUBLE, .75) AS q3, count({c}) AS n FROM {tab}))"""


#: All issues of dirty_customer that need no schema and no rules: issue_type, severity, column_name, n_affected, ratio.
ISSUES_SQL = f"""SELECT * FROM ({MISSING_SQL}) UNION ALL SELECT * FROM ({DUPLICATES_SQL})
UNION ALL SELECT * FROM ({DUP_IDS_SQL}) UNION ALL SELECT * FROM ({CASE_SQL}) WHERE n_affected > 0
UNION ALL SELECT issue_type, severity, column_name, n_affected, round(n_affected / n_all::DOUBLE, 6) AS ratio FROM ({union([outlier_sql("dirty_customer", c) for c in ("c_custkey", "c_acctbal", "c_nationkey")])}) WHERE n_affected > 0
UNION ALL SELECT 'pii_detected', 'critical', 'c_mktsegment', n, NULL FROM ({union([f"SELECT count(*) FILTER (regexp_matches(c_mktsegment, '{p}')) AS n FROM dirty_customer" for p in checks.PII.values()])}) WHERE n > 0"""
SCORE_SQL = """SELECT greatest(0, 100 - least(2 * w, 100)) * 0.8 + 20 * completeness AS score, c FROM
(SELECT coalesce(sum(CASE severity WHEN 'critical' THEN 10.0 WHEN 'high' THEN 5.0 WHEN 'medium' THEN 2.0 ELSE 1.0 END), 0) AS w, count(*) FILTER (severity = 'critical') AS c FROM i),
(SELECT (count(c_custkey) + count(c_acctbal) + count(c_mktsegment) + count(c_nationkey)) / (4.0 * count(*)) AS completeness FROM dirty_customer)"""


@query(f"""SELECT issue_type, severity, column_name, n_affected::BIGINT AS n_affected, ratio FROM ({ISSUES_SQL}) UNION ALL SELECT 'invalid_values', 'critical', NULL, 1, 1.0
UNION ALL SELECT 'business_rule_violations', 'high', 'c_acctbal', n, round(n / t::DOUBLE, 6) FROM (SELECT count(*) FILTER (c_acctbal < 0) AS n, count(*) AS t FROM dirty_customer) WHERE n > 0""", ("dirty_customer",))
def full_validation(get):
    return plain(checks.validate(get("dirty_customer"), {"required": ["c_email"]}, [{"type": "range", "column": "c_acctbal", "min": 0}]))


@query(f"""WITH i AS ({ISSUES_SQL}), s AS ({SCORE_SQL})
SELECT c = 0 AND score >= 70 AS passed, CASE WHEN c > 0 THEN 'critical issues' WHEN score < 70 THEN 'score below minimum' ELSE '' END AS reason FROM s""", ("dirty_customer",))
def validation_gate(get):
    d = get("dirty_customer")
    return checks.gate(checks.overall_score(d, checks.validate(d)))


@query(f"""WITH i AS ({ISSUES_SQL}), c AS (SELECT issue_type, array_to_string(list_sort(list(DISTINCT column_name) FILTER (column_name IS NOT NULL))[1:5], ', ') AS cols FROM i GROUP BY 1)
SELECT issue_type, replace(advice, '{{}}', coalesce(cols, '')) AS advice FROM c JOIN (SELECT unnest({list(checks.ADVICE)}) AS t, unnest({list(checks.ADVICE.values())}) AS advice) ON t = issue_type""", ("dirty_customer",))
def validation_advice(get):
    return checks.recommendations(checks.validate(get("dirty_customer")))


@query("""WITH d AS (SELECT * FROM dirty_customer), g AS (SELECT sum(n - 1) AS dup FROM (SELECT count(*) AS n FROM d GROUP BY c_custkey, c_acctbal, c_mktsegment, c_nationkey)), m AS (SELECT count(*) AS n, 4 * count(*) - count(c_custkey) - count(c_acctbal) - count(c_mktsegment) - count(c_nationkey) AS miss FROM d)
SELECT round(greatest(0, 100 - 100.0 * (miss + dup * 4) / (n * 4)), 6)::DOUBLE AS quality_score, n AS n_rows, 4::BIGINT AS n_columns, miss::BIGINT AS missing_cells, dup::BIGINT AS duplicate_rows FROM m, g""", ("dirty_customer",))
def task_quality(get):
    return task_checks.task_quality(get("dirty_customer"))[1]


@query("""WITH d AS (SELECT * FROM dirty_customer), g AS (SELECT sum(n - 1) AS dup FROM (SELECT count(*) AS n FROM d GROUP BY c_custkey, c_acctbal, c_mktsegment, c_nationkey)), m AS (SELECT count(*) AS n, 4 * count(*) - count(c_custkey) - count(c_acctbal) - count(c_mktsegment) - count(c_nationkey) AS miss FROM d)
SELECT round(100 - 30.0 * miss / (4 * n) - 20.0 * dup / n, 2)::DOUBLE AS overall_score, n AS n_rows, 4::BIGINT AS n_columns FROM m, g""", ("dirty_customer",))
def dataset_quality(get):
    return task_checks.dataset_quality(get("dirty_customer"))[0]


@query("""SELECT * FROM (SELECT 'not_null' AS rule, 'c_acctbal' AS column_name, count(*) - count(c_acctbal) AS n_violations FROM dirty_customer UNION ALL SELECT 'unique', 'c_custkey', count(*) - count(DISTINCT c_custkey) FROM dirty_customer
UNION ALL SELECT 'range', 'c_acctbal', count(*) FILTER (c_acctbal < 0 OR c_acctbal > 9000) FROM dirty_customer UNION ALL SELECT 'regex', 'c_mktsegment', count(*) FILTER (NOT coalesce(regexp_matches(c_mktsegment, '^(?:[A-Z])'), false)) FROM dirty_customer)""", ("dirty_customer",))
def validate_rules(get):
    return task_checks.validate_rules(get("dirty_customer"), [{"type": "not_null", "column": "c_acctbal"}, {"type": "unique", "column": "c_custkey"}, {"type": "range", "column": "c_acctbal", "min": 0, "max": 9000}, {"type": "regex", "column": "c_mktsegment", "pattern": "[A-Z]"}])


@query("""SELECT * FROM (SELECT 'error' AS level, 'missing_column' AS kind, c AS column_name, 1::BIGINT AS n FROM (SELECT unnest(['c_custkey', 'c_email']) AS c) WHERE c NOT IN (SELECT column_name FROM (DESCRIBE SELECT * FROM dirty_customer))
UNION ALL SELECT 'warning', 'extra_column', column_name, 1 FROM (DESCRIBE SELECT * FROM dirty_customer) WHERE column_name NOT IN ('c_custkey', 'c_acctbal', 'c_mktsegment')
UNION ALL SELECT 'warning', 'type', column_name, 1 FROM (DESCRIBE SELECT * FROM dirty_customer) WHERE column_name = 'c_mktsegment' AND column_type NOT IN ('BIGINT', 'INTEGER')
UNION ALL SELECT 'error', 'unique', 'c_custkey', count(*) - count(DISTINCT c_custkey) FROM dirty_customer UNION ALL SELECT 'error', 'not_null', 'c_acctbal', count(*) - count(c_acctbal) FROM dirty_customer UNION ALL SELECT 'error', 'range', 'c_acctbal', count(*) FILTER (c_acctbal < 0) FROM dirty_customer) WHERE n > 0""", ("dirty_customer",))
def schema_constraints(get):
    spec = {"required": ["c_custkey", "c_email"], "columns": {"c_custkey": {"type": "integer", "unique": True}, "c_acctbal": {"type": "float", "not_null": True, "min": 0}, "c_mktsegment": {"type": "integer"}}}
    return task_checks.schema_validation(get("dirty_customer"), spec)


@query("SELECT count(*) AS n_rows, (SELECT count(*) FROM (DESCRIBE events))::INT AS n_columns, count(*) > 0 AS has_data FROM events")
def row_count(get):
    return task_checks.row_count(get("events"))


@query("""WITH d AS (SELECT doc_id, text, (doc_id % 2)::INT AS t, (doc_id % 8)::INT AS k FROM documents), s AS (SELECT doc_id, ((t > 0)::INT + (length(text) > 0)::INT + (k > 0)::INT) / 3.0 AS c, 0.4 * (t > 0)::INT + 0.3 * (length(text) > 100)::INT + 0.3 * (k > 5)::INT AS r FROM d)
SELECT doc_id, round(c, 6)::DOUBLE AS completeness, round(r, 6)::DOUBLE AS richness, round(0.3 * c + 0.4 * r + 0.3, 6)::DOUBLE AS overall FROM s""")
def document_quality(get):
    d = get("documents").select("doc_id", "text", (F.col("doc_id") % 2).alias("n_tables"), (F.col("doc_id") % 8).alias("n_keys"))
    return task_checks.document_quality(d).select("doc_id", *[F.round(c, 6).alias(c) for c in ("completeness", "richness", "overall")])


# ---------------------------------------------------------------- cleaning and PII


@query("SELECT c_custkey, upper(trim(c_mktsegment)) AS c_mktsegment FROM dirty_customer", ("dirty_customer",))
def clean_strip_case(get):
    d = get("dirty_customer").select("c_custkey", "c_mktsegment")
    return cleaning.standardize_case(cleaning.strip_whitespace(d), "upper")


@query("SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '\\p{L}+|[^\\p{L}]+'), lambda x: CASE WHEN x[1] = 'ß' THEN 'Ss' ELSE upper(x[1]) END || lower(x[2:])), '')) AS title_md5 FROM documents")
def title_case(get):
    return get("documents").select("doc_id", F.md5(X.title(F.col("text"))).alias("title_md5"))


@query("""WITH s AS (SELECT quantile_cont(c_acctbal, 0.5) AS m FROM dirty_customer), k AS (SELECT c_mktsegment AS v FROM dirty_customer WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT c_custkey, round(coalesce(c_acctbal, m), 4) AS c_acctbal, coalesce(c_mktsegment, v) AS c_mktsegment FROM dirty_customer, s, k""", ("dirty_customer",))
def fill_median_mode(get):
    return cleaning.fill_missing(get("dirty_customer").select("c_custkey", "c_acctbal", "c_mktsegment")).withColumn("c_acctbal", F.round("c_acctbal", 4))


@query("SELECT o_orderkey, TRY_CAST(total_text AS DOUBLE) AS total_text FROM dirty_orders", ("dirty_orders",))
def fix_types(get):
    return cleaning.fix_types(get("dirty_orders").select("o_orderkey", "total_text"), {"total_text": "numeric"})


@query("WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) SELECT event_id, value FROM events, s WHERE abs((value - m) / s) <= 3")
def remove_outliers(get):
    return cleaning.remove_outliers(get("events").select("event_id", "value"), ["value"])


@query("WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) SELECT event_id, value < m - 3 * s OR value > m + 3 * s AS value_outlier FROM events, s")
def outlier_flag(get):
    return cleaning.outliers(get("events").select("event_id", "value"), ["value"]).select("event_id", "value_outlier")


@query("WITH s AS (SELECT quantile_cont(value, .25) AS a, quantile_cont(value, .75) AS b FROM events) SELECT event_id, round(least(greatest(value, a - 1.5 * (b - a)), b + 1.5 * (b - a)), 6) AS value FROM events, s")
def outlier_cap(get):
    return cleaning.outliers(get("events").select("event_id", "value"), ["value"], "iqr", "cap", 1.5).withColumn("value", F.round("value", 6))


@query("SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey FROM (SELECT DISTINCT c_custkey, coalesce(round(c_acctbal, 2), round((SELECT avg(c_acctbal) FROM (SELECT DISTINCT * FROM dirty_customer)), 2)) AS c_acctbal, coalesce(trim(c_mktsegment), '') AS c_mktsegment, c_nationkey FROM dirty_customer)", ("dirty_customer",))
def clean_task(get):
    return cleaning.clean(get("dirty_customer")).withColumn("c_acctbal", F.round("c_acctbal", 2))


HIT = " OR ".join(f"regexp_matches(note, '{checks.PII[t]}')" for t in pii_masking.DEFAULT_TYPES)


@query(f"SELECT c_custkey, CASE WHEN {HIT} THEN concat(left(note, 1), repeat('*', length(note) - 2), right(note, 1)) ELSE note END AS note FROM dirty_contacts", ("dirty_contacts",))
def pii_mask(get):
    return pii_masking.mask(get("dirty_contacts"))


@query(f"SELECT c_custkey, {HIT} AS note_has_pii FROM dirty_contacts", ("dirty_contacts",))
def pii_flag(get):
    return pii_masking.flag(get("dirty_contacts")).drop("note")


def redact_sql(expr: str) -> str:
    for t in ("ssn", "email", "phone", "credit_card"):
        expr = f"regexp_replace({expr}, '{pii_masking.TASK_PII[t]}', '{pii_masking.TOKENS[t]}', 'g')"
    return expr


@query(f"SELECT c_custkey, {redact_sql('note')} AS note FROM dirty_contacts", ("dirty_contacts",))
def pii_redact(get):
    return pii_masking.redact(get("dirty_contacts"))


@query("SELECT * FROM (" + union([f"SELECT 'note' AS column_name, '{t}' AS pii_type, count(*) FILTER (regexp_matches(note, '{p}')) AS n FROM dirty_contacts" for t, p in pii_masking.TASK_PII.items()]) + ") WHERE n > 0", ("dirty_contacts",))
def pii_report(get):
    return pii_masking.report(get("dirty_contacts"))


# ---------------------------------------------------------------- documents, plans, assembly

WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"


@query(f"""SELECT doc_id, {WORDS} AS analysis_word_count, length(text) AS analysis_char_count, length(text) - length(replace(text, chr(10), '')) + 1 AS analysis_line_count,
contains(lower(text), 'table') OR contains(text, '|') AS analysis_has_tables, contains(text, '#') OR contains(text, 'Chapter') OR contains(text, 'Section') OR contains(text, '1.') OR contains(text, '2.') AS analysis_has_sections FROM documents""")
def content_analysis(get):
    return documents.analyse(get("documents").select("doc_id", "text")).drop("text")


TOTALS = "SELECT source, count(*) AS n_docs, sum(length(text) // 4)::BIGINT AS tokens, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source"


@query(TOTALS)
def token_totals(get):
    return documents.token_totals(get("documents"), ["source"])


@query(f"SELECT *, CASE WHEN n_docs = 1 OR tokens < 50000 THEN 'single' WHEN n_docs > 10 AND tokens / n_docs < 5000 THEN 'batch' WHEN tokens > 150000 THEN 'chunk' ELSE 'combine' END AS strategy FROM ({TOTALS.replace('source', 'lang')})")
def strategy(get):
    return documents.choose_strategy(documents.token_totals(get("documents"), ["lang"]))


@query("SELECT source, count(*) AS n_docs, sum(length(text) // 4)::BIGINT AS tokens FROM documents GROUP BY ROLLUP (source)")
def collection_summary(get):
    return documents.collection_summary(get("documents"))


@query("""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), l AS (SELECT doc_id, CASE WHEN length(x) // 4 <= 200 THEN [x] ELSE string_split(x, chr(10)) END AS p FROM d),
e AS (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS k FROM l), o AS (SELECT doc_id, k, part, length(part) // 4 AS t FROM e),
r AS (SELECT doc_id, k, 0::BIGINT AS bin, t AS used FROM o WHERE k = 1 UNION ALL
 SELECT o.doc_id, o.k, CASE WHEN used + t > 200 THEN bin + 1 ELSE bin END, CASE WHEN used + t > 200 THEN t ELSE used + t END FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1)
SELECT doc_id, bin AS chunk_index, max(bin) OVER (PARTITION BY doc_id) + 1 AS total_chunks, tokens, content_md5 FROM
(SELECT doc_id, bin, sum(t)::BIGINT AS tokens, md5(string_agg(part, chr(10) ORDER BY o.k)) AS content_md5 FROM r JOIN o USING (doc_id, k) GROUP BY 1, 2)""")
def chunk_documents(get):
    d = documents.chunk_documents(get("documents"), 200, "\n")
    return d.select("doc_id", "chunk_index", "total_chunks", "tokens", F.md5("content").alias("content_md5"))


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, text, length(coalesce(text, '')) // 4 AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
r AS (SELECT source, k, 0::BIGINT AS bin, t AS used FROM o WHERE k = 1 UNION ALL
 SELECT o.source, o.k, CASE WHEN used + t > 20000 THEN bin + 1 ELSE bin END, CASE WHEN used + t > 20000 THEN t ELSE used + t END FROM r JOIN o ON o.source = r.source AND o.k = r.k + 1)
SELECT source, bin, count(*) AS n_docs, sum(t)::BIGINT AS tokens, md5(string_agg(chr(10) || chr(10) || '--- Document: ' || doc_id || ' ---' || chr(10) || chr(10) || coalesce(text, ''), '' ORDER BY doc_id)) AS content_md5
FROM r JOIN o USING (source, k) GROUP BY 1, 2""")
def combine_documents(get):
    d = documents.pack_documents(get("documents"), ["source"], "doc_id", 20000)
    return d.select("source", "bin", "n_docs", "tokens", F.md5("content").alias("content_md5"))


@query("""WITH b AS (SELECT source, doc_id, text, floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 5)::BIGINT AS batch_index, ceil(count(*) OVER (PARTITION BY source) / 5.0)::BIGINT AS batch_total FROM documents)
SELECT source, batch_index, batch_total, count(*) AS n_docs, md5(string_agg('=== ' || doc_id || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id)) AS content_md5 FROM b GROUP BY 1, 2, 3""")
def batch_documents(get):
    d = documents.batch_documents(get("documents"), ["source"], "doc_id")
    return d.select("source", "batch_index", "batch_total", "n_docs", F.md5("content").alias("content_md5"))


@query("""WITH c AS (SELECT source, string_agg('=== ' || doc_id || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id) AS t FROM documents GROUP BY source)
SELECT source, CASE WHEN length(t) > 3000 THEN left(t, 3000) || '...' ELSE t END AS content FROM c""")
def combined_content(get):
    return documents.combined_content(get("documents").select("source", "doc_id", "text"), ["source"], "doc_id")


ROWS_SQL = """CASE dataset_type WHEN 'qa_pairs' THEN least(5000, CASE WHEN chars > 10000 THEN greatest(100, chars // 150) WHEN chars > 5000 THEN greatest(50, chars // 120) WHEN chars > 2000 THEN greatest(30, chars // 100) ELSE greatest(20, chars // 80) END)
WHEN 'classification' THEN least(5000, CASE WHEN chars > 10000 THEN greatest(150, chars // 120) WHEN chars > 5000 THEN greatest(80, chars // 100) ELSE greatest(30, chars // 80) END)
WHEN 'ner' THEN least(2000, CASE WHEN chars > 10000 THEN greatest(80, chars // 200) WHEN chars > 5000 THEN greatest(50, chars // 180) ELSE greatest(20, chars // 150) END)
WHEN 'summarization' THEN least(1000, CASE WHEN chars > 10000 THEN greatest(30, chars // 500) WHEN chars > 5000 THEN greatest(20, chars // 400) ELSE greatest(10, chars // 300) END)
ELSE least(3000, CASE WHEN chars > 10000 THEN greatest(80, chars // 150) WHEN chars > 5000 THEN greatest(50, chars // 130) ELSE greatest(20, chars // 100) END) END"""
TYPE_ROWS = "(VALUES " + ", ".join(f"('{k}', {v[0]}, {v[1]}, {v[2]})" for k, v in documents.TYPES.items()) + ") k(dataset_type, overhead, prompt_tokens, row_tokens)"


def cost_sql(totals: str) -> str:
    return f"""a AS (SELECT t.*, k.*, tokens + prompt_tokens AS input_tokens, ({ROWS_SQL})::BIGINT AS rows FROM ({totals}) t, {TYPE_ROWS}), b AS (SELECT *, rows * row_tokens AS output_tokens FROM a)"""


@query(f"WITH {cost_sql(TOTALS)} SELECT source, dataset_type, input_tokens, output_tokens, rows, round(input_tokens * 0.0002::DOUBLE + output_tokens * 0.0005::DOUBLE, 4) AS total_cost, floor(input_tokens / 10000.0 + output_tokens / 1000.0 + 5)::BIGINT AS seconds FROM b")
def cost_by_source(get):
    d = documents.cost_estimate(documents.token_totals(get("documents"), ["source"]))
    return d.select("source", "dataset_type", "input_tokens", "output_tokens", "rows", "total_cost", "seconds")


@query(f"""WITH {cost_sql("SELECT source, count(*) AS n_docs, sum(length(text) // 4)::BIGINT AS tokens, sum(length(text) // 4)::BIGINT * 4 AS chars FROM documents GROUP BY source")},
c AS (SELECT *, CASE WHEN tokens > 150000 THEN 'chunk' WHEN n_docs > 10 THEN 'batch' ELSE 'combine' END AS strategy FROM b), e AS (SELECT *, (CASE strategy WHEN 'chunk' THEN ceil(tokens / 50000.0) WHEN 'batch' THEN ceil(n_docs / 5.0) ELSE 1 END)::BIGINT AS chunks, round(input_tokens * 0.0002::DOUBLE + output_tokens * 0.0005::DOUBLE, 4) AS one FROM c)
SELECT source, dataset_type, strategy, chunks, round(CASE WHEN strategy = 'combine' THEN one ELSE one * 1.1::DOUBLE * chunks END, 3) AS total_cost FROM e""")
def multi_doc_cost(get):
    d = documents.multi_document_cost(documents.token_totals(get("documents"), ["source"]).drop("chars"))
    return d.select("source", "dataset_type", "strategy", "chunks", F.round("total_cost", 3).alias("total_cost"))


@query("""WITH d AS (SELECT doc_id, text, length(text) AS n, greatest(1000, length(text) // 3) AS size, unnest(range(3)) AS batch FROM documents)
SELECT doc_id, batch, md5(CASE WHEN n > 2 * size THEN substr(text, least(batch * size // 2, n - size) + 1, size) ELSE text END) AS content_md5 FROM d""")
def windows(get):
    return documents.windows(get("documents").select("doc_id", "text"), 3).select("doc_id", "batch", F.md5("content").alias("content_md5"))


@query("SELECT doc_id, left(md5(concat_ws(':', source, text)), 12) AS document_id FROM documents")
def document_ids(get):
    return documents.document_ids(get("documents"), "source", "text").select("doc_id", "document_id")


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<(?:script\b[^>]*>.*?</script\s*|style\b[^>]*>.*?</style\s*)>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages""")
def document_extraction(get):
    return readers.extract_documents(get("pages"))[0].select("page_id", F.md5("text_content").alias("text_md5"))


@query("SELECT doc_id, batch_number, least(2 * length(text) // 100 + 1 - (batch_number - 1) * 100, 100)::BIGINT AS n_examples, md5(left(text, 3000)) AS content_md5 FROM (SELECT doc_id, text, unnest(range(1, greatest(ceil((2 * length(text) // 100 + 1) / 100.0), 1)::BIGINT + 1)) AS batch_number FROM documents)")
def request_preview(get):
    """How the requests of a plan begin that is shown before it is run: the limit of a prompt, from the head of each text."""
    target = F.floor(2 * F.length("text") / 100) + 1
    return assembly.request_plan(get("documents").select("doc_id", "text"), target, "qa_pairs", windowed=False).select("doc_id", "batch_number", "n_examples", F.md5("content").alias("content_md5"))


@query("""WITH d AS (SELECT doc_id, text, length(text) AS n, 2 * length(text) // 100 + 1 AS target FROM documents), b AS (SELECT *, greatest(ceil(target / 100.0), 1)::BIGINT AS batches FROM d),
w AS (SELECT *, greatest(1000, n // batches) AS size, unnest(range(1, batches + 1)) AS batch_number FROM b)
SELECT doc_id, batch_number, least(target - (batch_number - 1) * 100, 100)::BIGINT AS n_examples, md5(left(CASE WHEN n > 2 * size THEN substr(text, least((batch_number - 1) * size // 2, n - size) + 1, size) ELSE text END, 3000)) AS content_md5 FROM w""")
def request_plan_windows(get):
    target = F.floor(2 * F.length("text") / 100) + 1
    return assembly.request_plan(get("documents").select("doc_id", "text"), target, "qa_pairs").select("doc_id", "batch_number", "n_examples", F.md5("content").alias("content_md5"))


@query("""SELECT doc_id, 'list' AS parsed_as, NULL::VARCHAR AS raw_content, unnest(['q' || doc_id, 'r']) AS question, unnest(['a', lang]) AS answer FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 'data', NULL, 'q' || doc_id, source FROM documents WHERE doc_id % 5 = 1 UNION ALL SELECT doc_id, 'object', NULL, 'q' || doc_id, lang FROM documents WHERE doc_id % 5 = 2
UNION ALL SELECT doc_id, 'lines', NULL, unnest(['q' || doc_id, 'next']), unnest([lang, source]) FROM documents WHERE doc_id % 5 = 3 UNION ALL SELECT doc_id, 'raw', 'plain ' || source, NULL, NULL FROM documents WHERE doc_id % 5 = 4""")
def parse_responses(get):
    return assembly.parse_responses(get("responses"))


@query("SELECT conv_id, turn, text AS question, next AS answer FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'")
def qa_pairs(get):
    return assembly.qa_pairs(get("conversations"))


@query("""WITH n AS (SELECT min(c) AS k FROM (SELECT count(*) AS c FROM labels GROUP BY quality)), r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR), doc_id) AS rn FROM documents JOIN labels USING (doc_id))
SELECT doc_id, quality FROM r, n WHERE rn <= k""")
def balanced_labels(get):
    return assembly.balanced_labels(get("documents"), get("labels")).select("doc_id", "quality")


@query("SELECT label, count(*) AS n FROM (SELECT 'email' AS label, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) FROM documents UNION ALL SELECT 'ip', unnest(regexp_extract_all(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}')) FROM documents) GROUP BY label")
def pattern_entities(get):
    d = assembly.pattern_entities(get("documents"), {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"})
    good = d.join(get("documents").select("doc_id", F.col("text").alias("whole")).hint("merge"), "doc_id").filter(F.substr("whole", (F.col("start") + 1).cast("int"), F.length("text")) == F.col("text"))
    return good.groupBy("label").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, array_to_string(s[1:5], ' ') AS text, array_to_string(s[1:2], ' ') AS summary FROM
(SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents) WHERE len(s) >= 3""")
def lead_summaries(get):
    return assembly.lead_summaries(get("documents"))


@query("SELECT doc_id, CASE WHEN h < 80 THEN 'train' WHEN h < 90 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100 AS h FROM documents)")
def split_80_10_10(get):
    return assembly.split(get("documents"), ["doc_id"]).select("doc_id", "split")


# ---------------------------------------------------------------- fusion and metrics


@query("SELECT doc_id, d.lang AS docs_lang, d.n_chars AS docs_n_chars, l.quality AS labels_quality, l.toxic AS labels_toxic FROM documents d JOIN labels l USING (doc_id)")
def fuse_early(get):
    return fusion.early({"docs": get("documents").select("doc_id", "lang", "n_chars"), "labels": get("labels")}, ["doc_id"])


@query("SELECT doc_id, d.n_chars * 0.5::DOUBLE AS docs_n_chars, l.quality * 2.0::DOUBLE AS labels_quality, l.toxic * 2.0::DOUBLE AS labels_toxic FROM documents d FULL JOIN labels l USING (doc_id)")
def fuse_attention(get):
    return fusion.attention({"docs": get("documents").select("doc_id", "n_chars"), "labels": get("labels")}, {"docs": 0.5, "labels": 2.0}, ["doc_id"])


@query("SELECT user_id, e.v AS events_value, e.n AS events_rows, c.v AS customers_c_acctbal, c.n AS customers_rows FROM (SELECT user_id, round(avg(value), 4) AS v, count(*) AS n FROM events GROUP BY 1) e FULL JOIN (SELECT c_nationkey::BIGINT AS user_id, round(avg(c_acctbal), 4) AS v, count(*) AS n FROM customer GROUP BY 1) c USING (user_id)")
def fuse_late(get):
    d = fusion.late({"events": get("events").select("user_id", "value"), "customers": get("customer").select(F.col("c_nationkey").cast("long").alias("user_id"), "c_acctbal")}, ["user_id"])
    return d.withColumns({c: F.round(c, 4) for c in ("events_value", "customers_c_acctbal")})


@query("SELECT doc_id, length(text) AS text_length, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS word_count FROM documents")
def text_features(get):
    return fusion.text_features(get("documents").select("doc_id", "text")).drop("text")


@query("SELECT o_orderkey::VARCHAR AS entity_id, TRY_CAST(total_text AS DOUBLE) AS amount, NULL::VARCHAR AS category FROM dirty_orders", ("dirty_orders",))
def target_schema(get):
    d = get("dirty_orders").select(F.col("o_orderkey").alias("entity_id"), F.col("total_text").alias("amount"))
    return fusion.to_schema(d, {"entity_id": "string", "amount": "double", "category": "string"})


@query("""SELECT pipeline_id, count(*) AS executions, count(*) FILTER (status = 'completed') AS successful, count(*) FILTER (status = 'failed') AS failed, round(100 * avg((status = 'completed')::INT), 4) AS success_pct,
round(avg(execution_time_seconds), 4) AS avg_seconds, round(avg(rows_processed), 4) AS avg_rows, round(avg(llm_cost_usd), 6) AS avg_cost, sum(rows_processed)::BIGINT AS total_rows FROM executions GROUP BY 1""", ("executions",))
def performance(get):
    return metrics.performance(get("executions"), ["pipeline_id"])


USAGE_COST = "SELECT *, round(prompt_tokens / 1e6 * CASE provider WHEN 'anthropic' THEN 3.0 WHEN 'openai' THEN 10.0 WHEN 'google' THEN 0.5 ELSE 1.0 END + completion_tokens / 1e6 * CASE provider WHEN 'anthropic' THEN 15.0 WHEN 'openai' THEN 30.0 WHEN 'google' THEN 1.5 ELSE 1.0 END, 6) AS cost_usd FROM llm_usage"


@query(f"WITH u AS ({USAGE_COST}) SELECT provider, round(sum(cost_usd), 6) AS cost, count(*) AS n, round(100 * sum(cost_usd) / (SELECT sum(cost_usd) FROM u), 2) AS share_pct FROM u GROUP BY 1", ("llm_usage",))
def cost_by_provider(get):
    d = metrics.cost_by(metrics.llm_cost(get("llm_usage")), "provider")
    return d.select("provider", "cost", "n", F.round("share_pct", 2).alias("share_pct"))


@query(f"WITH u AS ({USAGE_COST}), d AS (SELECT CAST(ts AS DATE) AS bucket, sum(cost_usd) AS cost, count(*) AS n FROM u GROUP BY 1), r AS (SELECT unnest(range(min(bucket)::TIMESTAMP, max(bucket)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS bucket FROM d) SELECT bucket::VARCHAR AS bucket, round(coalesce(cost, 0), 6) AS cost, coalesce(n, 0) AS n FROM r LEFT JOIN d USING (bucket)", ("llm_usage",))
def cost_timeline(get):
    return metrics.cost_timeline(metrics.llm_cost(get("llm_usage"))).withColumn("bucket", F.col("bucket").cast("string"))


@query(f"WITH u AS ({USAGE_COST}) SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS bucket, round(sum(cost_usd), 6) AS cost, count(*) AS n FROM u GROUP BY 1", ("llm_usage",))
def cost_weekly(get):
    return metrics.cost_timeline(metrics.llm_cost(get("llm_usage")), unit="week").withColumn("bucket", F.col("bucket").cast("string"))


@query(f"WITH u AS ({USAGE_COST}) SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, provider, model, count(*) AS requests, sum(prompt_tokens + completion_tokens)::BIGINT AS tokens, round(sum(cost_usd), 6) AS cost FROM u GROUP BY 1, 2, 3", ("llm_usage",))
def daily_llm_usage(get):
    return metrics.daily_usage(metrics.llm_cost(get("llm_usage"))).withColumn("day", F.col("day").cast("string"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS total, count(*) FILTER (status = 'completed') AS successful, count(*) FILTER (status = 'failed') AS failed FROM executions GROUP BY 1", ("executions",))
def daily_trend(get):
    return metrics.daily_trend(get("executions")).withColumn("day", F.col("day").cast("string"))


@query("SELECT execution_id, pipeline_id FROM executions WHERE status = 'failed' ORDER BY ts DESC, execution_id LIMIT 10", ("executions",))
def last_failures(get):
    return metrics.last_failures(get("executions")).select("execution_id", "pipeline_id")


@query("SELECT pipeline_id, round(sum(round(llm_cost_usd + round(execution_time_seconds / 3600 * 0.1, 6) + rows_processed * 0.0001 * 0.02 / 30, 4)), 2) AS total_cost FROM executions GROUP BY 1", ("executions",))
def run_costs(get):
    return metrics.run_cost(get("executions")).groupBy("pipeline_id").agg(F.round(F.sum("total_cost"), 2).alias("total_cost"))


@query("SELECT status, CASE WHEN execution_time_seconds <= 1 THEN 1.0 WHEN execution_time_seconds <= 5 THEN 5.0 WHEN execution_time_seconds <= 10 THEN 10.0 WHEN execution_time_seconds <= 30 THEN 30.0 WHEN execution_time_seconds <= 60 THEN 60.0 WHEN execution_time_seconds <= 300 THEN 300.0 END::DOUBLE AS le, count(*) AS n FROM executions GROUP BY 1, 2", ("executions",))
def duration_histogram(get):
    return metrics.duration_histogram(get("executions"))


# ---------------------------------------------------------------- streams (as batches) and pipelines


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n_rows, count(*) FILTER (value > 100) AS n_bad FROM events GROUP BY 1, 2")
def quality_windows(get):
    d = jobs.quality_counts(get("events").select("ts", "event_type", "value"), ["event_type"], "value > 100")
    return d.select(F.to_date("window_start").cast("string").alias("day"), "event_type", "n_rows", "n_bad")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, count(*) AS n_sessions, sum(n)::BIGINT AS n_events FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY user_id""")
def session_activity(get):
    return jobs.sessions(get("events").select("user_id", "ts"), "user_id").groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n_events").alias("n_events"))


@query("SELECT event_id, concat_ws(',', CASE WHEN NOT value >= 1 THEN 'least' END, CASE WHEN NOT event_type <> 'error' THEN 'no_error' END) AS failed_rules FROM events")
def checked_ingest(get):
    return jobs.checked_ingest(get("events").select("event_id", "value", "event_type"), {"least": "value >= 1", "no_error": "event_type <> 'error'"}).select("event_id", "failed_rules")


@query("SELECT user_id % 5 AS pipeline, event_type, count(event_id) AS n FROM events WHERE value > 10 AND event_type <> 'error' GROUP BY 1, 2")
def step_pipeline(get):
    steps = [
        {"name": "keep", "type": "filter", "config": {"condition": "value > 10 & event_type != 'error'"}},
        {"name": "key", "type": "custom", "config": {"fn": lambda d: d.withColumn("pipeline", F.col("user_id") % 5)}},
        {"name": "sum", "type": "aggregate", "config": {"keys": ["pipeline", "event_type"], "aggs": {"n": ("event_id", "count")}}},
    ]
    return pipeline.run(steps, get("events"))["sum"]


NEAR_SQL = """WITH d AS (SELECT min(doc_id) AS id, string_split_regex(trim(lower(text)), '\\s+') AS w FROM documents GROUP BY text),
g AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b, round(k / (x.n + y.n - k)::DOUBLE, 6) AS similarity FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE k / (x.n + y.n - k)::DOUBLE >= 0.8"""


@query(NEAR_SQL)
def near_duplicates(get):
    """Pairs of documents of five-word shingle similarity 0.8 or more; equal texts stand for one."""
    first, _ = joins.distinct_texts(get("documents").select(F.col("doc_id").alias("id"), "text"))
    d = joins.shingle_pairs(first, "id", "text")
    return d.select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH RECURSIVE near AS ({NEAR_SQL}), c AS (SELECT text, min(doc_id) AS rep FROM documents WHERE text IS NOT NULL GROUP BY text),
e AS (SELECT id_a AS u, id_b AS v FROM near UNION SELECT id_b, id_a FROM near),
r AS (SELECT rep AS id, rep AS root FROM c UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.id),
g AS (SELECT id, min(root) AS root FROM r GROUP BY id),
d AS (SELECT doc_id, coalesce(root, doc_id) AS group_id FROM documents LEFT JOIN c USING (text) LEFT JOIN g ON g.id = rep)
SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS n_rows FROM d""")
def similar_groups(get):
    """Groups of documents that five-word shingle links of 0.8 or more connect."""
    return groups.similar_groups(get("documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query("SELECT page_id, lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)) AS host, count(*) OVER (PARTITION BY lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1))) AS pages_of_host FROM pages")
def pages_by_host(get):
    host = F.lower(F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1))
    d = get("pages").select("page_id", host.alias("host"))
    n = d.groupBy("host").agg(F.count("*").alias("pages_of_host"))
    return d.join(n.hint("merge"), "host")



# ---------------------------------------------------------------- row-wise steps


@query("SELECT c_custkey, 'night' AS load_name, 3 AS load_number FROM customer")
def constants_added(get):
    return transforms.add_constants(get("customer").select("c_custkey"), {"load_name": "night", "load_number": 3})


@query("SELECT c_custkey, c_mktsegment, c_nationkey FROM dirty_customer", ("dirty_customer",))
def sparse_columns_dropped(get):
    return transforms.drop_sparse_columns(get("dirty_customer"), 0.12)


SHARES = (0.02, 0.1, 0.12, 1.0)


@query("WITH c AS (" + union([f"SELECT '{c}' AS column_name, count({c}) AS n, count(*) AS t FROM dirty_customer" for c in ("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")]) + "), s AS (" + union([f"SELECT {x}::DOUBLE AS share" for x in SHARES]) + ") SELECT share, column_name, n FROM c, s WHERE (t - n)::DOUBLE / t <= share", ("dirty_customer",))
def sparse_columns_by_share(get):
    d = get("dirty_customer")
    return ordering.union_all([filled_counts(transforms.drop_sparse_columns(d, x)).withColumn("share", F.lit(x)) for x in SHARES])


@query("SELECT * FROM dirty_customer WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL", ("dirty_customer",))
def missing_dropped(get):
    return transforms.drop_missing(get("dirty_customer"))


@query("SELECT c_acctbal, c_mktsegment FROM dirty_customer WHERE c_acctbal IS NOT NULL OR c_mktsegment IS NOT NULL", ("dirty_customer",))
def empty_rows_dropped(get):
    return transforms.drop_empty_rows(get("dirty_customer").select("c_acctbal", "c_mktsegment"))


@query("SELECT event_id, value FROM events WHERE event_id % 10 <> 0")
def infinite_removed(get):
    return transforms.remove_infinite(get("events").select("event_id", F.when(F.col("event_id") % 10 == 0, float("inf")).otherwise(F.col("value")).alias("value")))


THIRDS = "SELECT doc_id, batch, CASE WHEN n > 2 * size THEN substr(text, least(batch * size // 2, n - size) + 1, size) ELSE text END AS content FROM (SELECT doc_id, text, length(text) AS n, greatest(1000, length(text) // 3) AS size, unnest(range(3)) AS batch FROM documents WHERE doc_id % 2 = 0)"


@query(f"SELECT doc_id, 'chunk' AS type, batch AS chunk_index, md5(content) AS content_md5 FROM ({THIRDS}) UNION ALL SELECT doc_id, 'full', NULL, md5(text) FROM documents WHERE doc_id % 2 <> 0")
def exploded_documents(get):
    d = get("documents").select("doc_id", "text")
    chunks = documents.windows(d.filter("doc_id % 2 = 0"), 3).withColumnRenamed("batch", "chunk_index")
    return transforms.explode_documents(d, chunks).select("doc_id", "type", "chunk_index", F.md5("content").alias("content_md5"))


@query(f"SELECT 'text' AS modality, count(*) AS n, sum(length(content))::BIGINT AS chars FROM (SELECT content FROM ({THIRDS}) UNION ALL SELECT text FROM documents WHERE doc_id % 2 <> 0) UNION ALL SELECT 'tables', count(*), sum(length(s_name))::BIGINT FROM supplier")
def modality_sizes(get):
    d = get("documents").select("doc_id", "text")
    chunks = documents.windows(d.filter("doc_id % 2 = 0"), 3).withColumnRenamed("batch", "chunk_index")
    parts = fusion.modalities_of(transforms.explode_documents(d, chunks, get("supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("content"))))
    sizes = [p.agg(F.lit(k).alias("modality"), F.count("*").alias("n"), F.sum(F.length("content")).cast("long").alias("chars")) for k, p in parts.items()]
    return ordering.union_all(sizes)


@query("SELECT doc_id FROM documents WHERE trim(text) <> '' AND length(text) > 500")
def long_documents(get):
    return transforms.long_texts(get("documents").select("doc_id", "text"), 500).select("doc_id")


@query("SELECT s_suppkey, concat('n', s_nationkey) AS file_path, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def tagged_rows(get):
    path = lambda c: F.concat(F.lit("n"), F.col(c).cast("string")).alias("file_path")
    return joins.tag_by_file(get("supplier").select("s_suppkey", path("s_nationkey")), get("nation").select(path("n_nationkey"), "n_name"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS chunk_number, count(*) OVER (PARTITION BY conv_id) AS chunk_count FROM conversations")
def numbered_turns(get):
    return documents.numbered(get("conversations").select("conv_id", "turn"), "conv_id", "turn")


@query("SELECT lang, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents GROUP BY lang")
def grouped_documents(get):
    return documents.group_by_similarity(get("documents"))


@query("SELECT DISTINCT doc_id, lang FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 ORDER BY doc_id LIMIT 500")
def combined_batches(get):
    d = get("documents").select("doc_id", "lang")
    return assembly.combine([d.filter("doc_id % 2 = 0"), d.filter("doc_id % 3 = 0")], 500, ["doc_id"])


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 OR left(text, 4) = substr(text, 2, 4)")
def entities_with_valid_spans(get):
    spans = F.array(F.struct(F.left("text", F.lit(4)).alias("text"), (F.col("doc_id") % 3 == 0).cast("int").alias("start"), F.when(F.col("doc_id") % 3 == 0, 5).otherwise(F.least(F.length("text"), F.lit(4))).alias("end")))
    return assembly.valid_spans(get("documents").select("doc_id", "text", spans.alias("entities"))).select("doc_id")


@query("SELECT event_id, value / 100 AS confidence FROM events WHERE value / 100 >= 0.8")
def confident_rows(get):
    return documents.confident(get("events").select("event_id", (F.col("value") / 100).alias("confidence")))


@query("SELECT execution_id, round(CASE status WHEN 'running' THEN 0.06 WHEN 'completed' THEN 0.001 * rows_processed / 1000 ELSE 0.01 + rows_processed * 10 * 0.000003 END::DOUBLE, 6) AS cost FROM executions", ("executions",))
def planned_step_costs(get):
    kind = F.when(F.col("status") == "running", "source").when(F.col("status") == "completed", "transform").otherwise("model")
    return documents.step_costs(get("executions").select("execution_id", kind.alias("step_type"), F.col("rows_processed").alias("n_rows"))).select("execution_id", "cost")


@query("SELECT doc_id, CASE WHEN n > 10000 THEN least(2000, greatest(100, n // 100)) WHEN n > 5000 THEN least(1000, greatest(50, n // 80)) ELSE least(500, greatest(20, n // 50)) END::BIGINT AS rows FROM (SELECT doc_id, length(text) // 4 AS n FROM documents)")
def rows_by_tokens(get):
    return get("documents").select("doc_id", documents.rows_from_tokens(X.tokens(F.col("text")), F.lit("qa_pairs")).cast("long").alias("rows"))


@query("SELECT doc_id, CASE WHEN n > 10000 THEN greatest(100, n // 150) WHEN n > 5000 THEN greatest(50, n // 120) WHEN n > 2000 THEN greatest(30, n // 100) ELSE 20 END::BIGINT AS rows FROM (SELECT doc_id, length(text) AS n FROM documents)")
def rows_by_generator(get):
    return get("documents").select("doc_id", documents.generator_rows(F.length("text").cast("long")).alias("rows"))


# ---------------------------------------------------------------- checks and profiles of whole tables

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("SELECT column_name FROM (" + union([f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS u, count(*) AS n FROM orders" for c in ORDERS]) + ") WHERE u = n AND n > 0")
def identifiers(get):
    return profile.identifier_columns(profile.nulls_distinct(get("orders")))


@query("""SELECT column_name, null_count > 0 AS nullable, null_count, unique_count, logical_type FROM (""" + union([f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, '{k}' AS logical_type FROM dirty_customer" for c, k in (("c_custkey", "integer"), ("c_acctbal", "float"), ("c_mktsegment", "string"), ("c_nationkey", "integer"))]) + ")", ("dirty_customer",))
def schema_facts(get):
    return readers.schema_profile(get("dirty_customer"), ["c_custkey"]).drop("samples")


FUSED = ["doc_id", "docs_n_chars", "labels_quality", "labels_toxic"]


FUSED_SQL = f"""WITH f AS (SELECT doc_id, n_chars AS docs_n_chars, quality AS labels_quality, toxic AS labels_toxic FROM documents JOIN labels USING (doc_id)),
r AS (SELECT 1.0 - avg(CASE WHEN abs(coalesce(c, 0)) > 0.9 THEN 1.0 ELSE 0.0 END) AS redundancy FROM ({union([f"SELECT corr({a}, {b}) AS c FROM f" for i, a in enumerate(FUSED) for b in FUSED[i + 1 :]])})),
c AS (SELECT ({" + ".join(f"count({a})" for a in FUSED)})::DOUBLE / (count(*) * {len(FUSED)}) AS completeness FROM f),
p AS (SELECT least(1.0, {len(FUSED)}::DOUBLE / (2 + (SELECT count(*) FROM (DESCRIBE labels)))) AS preservation),
k AS (SELECT 0.85::DOUBLE AS coherence)
SELECT *, round((completeness + redundancy + preservation + coherence) / 4, 6) AS fusion_score FROM c, r, p, k"""


@query(FUSED_SQL)
def fusion_scores(get):
    docs = get("documents").select("doc_id", "n_chars")
    fused = fusion.early({"docs": docs, "labels": get("labels")}, ["doc_id"])
    return profile.fusion_score([docs, get("labels")], fused).withColumn("fusion_score", F.round("fusion_score", 6))


WARNINGS = "concat_ws(',', CASE WHEN tokens > 500000 THEN 'very_large' END, CASE WHEN n_docs > 50 THEN 'many_documents' END, CASE WHEN tokens > 1000000 THEN 'costly' END)"
STRATEGY = "CASE WHEN n_docs = 1 OR tokens < 50000 THEN 'single' WHEN n_docs > 10 AND tokens / n_docs < 5000 THEN 'batch' WHEN tokens > 150000 THEN 'chunk' ELSE 'combine' END"


@query(f"SELECT n_docs, tokens, round(bytes / 1048576, 6) AS total_mb, {STRATEGY} AS strategy, {WARNINGS} AS warnings FROM (SELECT count(*) AS n_docs, sum(length(text) // 4)::BIGINT AS tokens, sum(strlen(text))::DOUBLE AS bytes FROM documents)")
def document_totals(get):
    return documents.document_stats(get("documents")).withColumn("total_mb", F.round("total_mb", 6))


@query(f"SELECT *, ceil(round(base_chunks * 1.2::DOUBLE, 9))::BIGINT AS adjusted_chunks, {WARNINGS} AS warnings FROM (SELECT *, CASE strategy WHEN 'chunk' THEN ceil(tokens / 50000) WHEN 'batch' THEN ceil(tokens / 40000) ELSE 1 END::BIGINT AS base_chunks FROM (SELECT *, {STRATEGY} AS strategy FROM ({TOTALS.replace('source', 'lang')})))")
def chunk_plan(get):
    return documents.chunk_estimate(documents.choose_strategy(documents.token_totals(get("documents"), ["lang"])))


@query("SELECT event_id, user_id, value FROM events WHERE value > 100 ORDER BY event_id LIMIT 100")
def violations_report(get):
    return checks.first_violations(get("events").select("event_id", "user_id", "value"), "value > 100", ["event_id"])


@query("SELECT 'encoding_issues' AS issue_type, 'medium' AS severity, 'text' AS column_name, n AS n_affected, round(n / t::DOUBLE, 6) AS ratio FROM (SELECT count(*) FILTER (doc_id % 9 = 0 OR contains(text, chr(65533))) AS n, count(*) AS t FROM documents) WHERE n > 0")
def encoding_issues(get):
    return plain(checks.check_encoding(get("documents").select(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("�"))).otherwise(F.col("text")).alias("text"))))


@query("""WITH e AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 10 AS w FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT least(greatest(ceil((o_totalprice - lo) / w), 1), 10) AS bin, o_orderstatus AS s FROM orders, e WHERE o_orderstatus IN ('F', 'O')),
p AS (SELECT bin, count(*) FILTER (s = 'F') / (SELECT count(*) FROM b WHERE s = 'F')::DOUBLE AS p, count(*) FILTER (s = 'O') / (SELECT count(*) FROM b WHERE s = 'O')::DOUBLE AS q FROM b GROUP BY bin)
SELECT round(sum((greatest(q, 0.0001) - greatest(p, 0.0001)) * ln(greatest(q, 0.0001) / greatest(p, 0.0001))), 6) AS psi FROM p""")
def price_drift(get):
    o = get("orders")
    return checks.drift(o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'F'"), "o_totalprice").select(F.round("psi", 6).alias("psi"))


@query("""WITH t AS (SELECT count(*)::DOUBLE AS t FROM dirty_customer), m AS (SELECT 'c_acctbal' AS c, count(*) - count(c_acctbal) AS n FROM dirty_customer UNION ALL SELECT 'c_mktsegment', count(*) - count(c_mktsegment) FROM dirty_customer)
SELECT 'missing_values' AS issue_type, CASE WHEN n / t > 0.1 THEN 'high' ELSE 'medium' END AS severity, c AS column_name, n AS n_affected, round(n / t, 6) AS ratio FROM m, t WHERE n > 0
UNION ALL SELECT 'duplicates', 'medium', NULL, t::BIGINT - n, round((t - n) / t, 6) FROM t, (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM dirty_customer))""", ("dirty_customer",))
def basic_issues(get):
    return plain(task_checks.basic_check(get("dirty_customer")))


@query("SELECT 'warning' AS level, 'rare: more than half missing' AS message FROM (SELECT count(*) AS n, count(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END) AS k FROM dirty_customer) WHERE n - k > 0.5 * n", ("dirty_customer",))
def connector_warnings(get):
    return task_checks.connector_check(get("dirty_customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("rare")))


@query("SELECT s_suppkey, s_acctbal FROM supplier")
def passed_through(get):
    return task_checks.pass_through(get("supplier").select("s_suppkey", "s_acctbal"))[0]


@query("SELECT c_custkey, c_mktsegment, c_nationkey FROM dirty_customer WHERE c_mktsegment IS NOT NULL", ("dirty_customer",))
def critical_rows_kept(get):
    return cleaning.drop_missing(get("dirty_customer"), threshold=0.12, critical=["c_mktsegment", "c_acctbal"])


@query("SELECT DISTINCT c_custkey, c_acctbal, trim(c_mktsegment) AS c_mktsegment, c_nationkey FROM dirty_customer", ("dirty_customer",))
def missing_kept(get):
    return cleaning.clean(get("dirty_customer"), missing="keep")


@query("SELECT o_orderkey, total_text::DOUBLE AS total, o_orderstatus FROM dirty_orders WHERE total_text <> 'n/a'", ("dirty_orders",))
def extracted_table(get):
    d = get("dirty_orders").filter("total_text <> 'n/a'")
    return cleaning.table_cleanup(d.select("o_orderkey", F.concat(F.lit("  "), "total_text").alias("total"), "o_orderstatus", F.lit(None).cast("string").alias("nothing")))


@query("SELECT c_custkey FROM dirty_contacts", ("dirty_contacts",))
def pii_columns_dropped(get):
    return pii_masking.drop_columns(get("dirty_contacts"))


PII_TEXTS = {"note": "note", "client": "'client ' || c_custkey", "line": "c_custkey % 1000 || '-555-' || c_custkey"}


def hits_sql(column: str) -> str:
    return " OR ".join(f"regexp_matches({column}, '{checks.PII[t]}')" for t in pii_masking.DEFAULT_TYPES)


@query("SELECT column_name, n FROM (SELECT 'c_custkey' AS column_name, count(c_custkey) AS n, 0 AS hits FROM dirty_contacts UNION ALL " + union([f"SELECT '{c}', count(x), count(*) FILTER ({hits_sql('x')}) FROM (SELECT {e} AS x FROM dirty_contacts)" for c, e in PII_TEXTS.items()]) + ") WHERE hits = 0", ("dirty_contacts",))
def pii_columns_kept(get):
    d = get("dirty_contacts").withColumns({c: F.expr(e) for c, e in PII_TEXTS.items()})
    return filled_counts(pii_masking.drop_columns(d))


ANY_PII = " OR ".join(f"regexp_matches(note, '{p}')" for p in pii_masking.TASK_PII.values())


@query(f"SELECT c_custkey, CASE WHEN {ANY_PII} THEN '' ELSE note END AS note FROM dirty_contacts", ("dirty_contacts",))
def pii_blank(get):
    return pii_masking.blank(get("dirty_contacts"))


# ---------------------------------------------------------------- shapes that readers meet


@query("SELECT o_orderkey AS key_text, total_text FROM dirty_orders", ("dirty_orders",))
def inferred_types(get):
    return readers.infer_types(get("dirty_orders").select(F.col("o_orderkey").cast("string").alias("key_text"), "total_text"))


@query("SELECT o_orderkey, o_totalprice AS price_text, o_orderstatus FROM orders")
def mixed_coerced(get):
    return readers.coerce_mixed(get("orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("price_text"), "o_orderstatus"))


PROP = r"regexp_extract(props, '[0-9]+')::BIGINT"


@query(f"SELECT {PROP} AS k FROM events UNION ALL SELECT event_id FROM events")
def json_path(get):
    d = get("events").select(F.concat(F.lit('{"data": {"rows": ['), "props", F.lit(', {"k": '), F.col("event_id").cast("string"), F.lit("}]}}")).alias("j"))
    return readers.json_path_rows(d, "j", "$.data.rows[*]", "k long")


@query(f"SELECT event_type AS key, {PROP} AS k FROM events")
def json_record_dict(get):
    d = get("events").select(F.concat(F.lit('{"'), "event_type", F.lit('": '), "props", F.lit("}")).alias("j"))
    return readers.record_dict_rows(d, "j", "k long")


@query(f"SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN {PROP} END AS k, CASE WHEN event_id % 7 = 0 THEN 'broken ' || props END AS raw_content, CASE WHEN event_id % 7 = 0 THEN 'invalid json' END AS error FROM events")
def json_repaired(get):
    loose = F.regexp_replace("props", r"\}", ",}")
    return readers.json_repair(get("events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("broken "), "props")).otherwise(loose).alias("j")), "j", "k long")


@query('SELECT event_id, user_id AS "who.id", event_type AS "who.what.type" FROM events')
def flattened(get):
    return readers.flatten(get("events").select("event_id", F.struct(F.col("user_id").alias("id"), F.struct(F.col("event_type").alias("type")).alias("what")).alias("who")))


@query("SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS part FROM orders")
def arrays_expanded(get):
    return readers.arrays(get("orders").select("o_orderkey", F.split("o_orderpriority", "-").alias("part")), "part")


@query("SELECT s_suppkey AS key, s_name AS name, 'suppliers' AS _sheet FROM supplier UNION ALL SELECT c_custkey, c_name, 'customers' FROM customer")
def sheets_stacked(get):
    return readers.sheet_union({"suppliers": get("supplier").selectExpr("s_suppkey AS key", "s_name AS name"), "customers": get("customer").selectExpr("c_custkey AS key", "c_name AS name")})


@query(r"SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines, len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x) <> '')) AS n_paragraphs, length(text) AS n_chars FROM documents")
def text_shape(get):
    return readers.text_counts(get("documents").select("doc_id", "text"), "text").drop("text")


@query("SELECT doc_id, md5(text) AS text_md5, 'utf-8' AS encoding FROM documents")
def decoded_texts(get):
    d = readers.decode_text(get("documents").select("doc_id", F.encode("text", "UTF-8").alias("content")))
    return d.select("doc_id", F.md5("text").alias("text_md5"), "encoding")


@query("SELECT c_custkey, c_nationkey AS nation, c_mktsegment AS segment FROM customer")
def delimited_text(get):
    return readers.csv_text_rows(get("customer").select("c_custkey", F.concat_ws(" ; ", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("line")), "line", "nation int, segment string", ";")


@query("SELECT count(*) AS n_rows, (SELECT count(*) FROM (DESCRIBE part))::INT AS n_columns FROM part")
def table_preview(get):
    return readers.preview(get("part"), ["p_partkey"])[0].drop("dtypes")


@query("SELECT doc_id, left(text, 500) AS preview, length(text) AS text_length, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words FROM documents ORDER BY doc_id LIMIT 10")
def first_results(get):
    return readers.result_view(get("documents").select("doc_id", "text"), ["doc_id"])


@query("SELECT conv_id, role AS key, string_agg(text, '|' ORDER BY turn) AS joined FROM conversations GROUP BY 1, 2")
def key_values_merged(get):
    d = documents.merge_key_values(get("conversations").select("conv_id", "turn", F.create_map("role", "text").alias("m")), "conv_id", "turn", "m")
    return d.select("conv_id", "key", F.array_join("values", "|").alias("joined"))


@query("SELECT doc_id, lang || chr(10) || source || chr(10) || 'id: ' || doc_id AS content FROM documents")
def sections_joined(get):
    return get("documents").select("doc_id", documents.text_from_sections(F.array("lang", "source"), F.create_map(F.lit("id"), F.col("doc_id").cast("string"))).alias("content"))


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def table_json_rows(get):
    j = F.to_json(F.struct(F.array(F.lit("name"), F.lit("segment")).alias("headers"), F.array(F.array("c_name", "c_mktsegment")).alias("rows")))
    d = documents.rows_from_table_json(get("customer").select("c_custkey", j.alias("t")), "t")
    return d.select("c_custkey", F.col("record")["name"].alias("name"), F.col("record")["segment"].alias("segment"))


PER_DOC = "SELECT doc_id, d.v AS docs_v, d.n AS docs_rows, l.v AS labels_v, l.n AS labels_rows FROM (SELECT doc_id, avg(n_chars) AS v, count(*) AS n FROM documents GROUP BY 1) d FULL JOIN (SELECT doc_id, avg(quality) AS v, count(*) AS n FROM labels GROUP BY 1) l USING (doc_id)"


@query(PER_DOC)
def fuse_hybrid(get):
    d = fusion.hybrid({"docs": get("documents").select("doc_id", "n_chars"), "labels": get("labels").select("doc_id", "quality")}, ["doc_id"], [["docs"], ["labels"]])
    return d.withColumnsRenamed({"docs_docs_n_chars": "docs_v", "labels_labels_quality": "labels_v"})


@query("SELECT doc_id, n_chars, lang, quality FROM documents JOIN labels USING (doc_id)")
def fuse_hierarchical(get):
    d = get("documents")
    out = fusion.hierarchical({"a": d.select("doc_id", "n_chars"), "b": d.select("doc_id", "lang"), "c": get("labels").select("doc_id", "quality")}, ["doc_id"], [[["a", "b"]]])
    return out.withColumnsRenamed({"a_b_a_n_chars": "n_chars", "a_b_b_lang": "lang", "c_c_quality": "quality", "c_quality": "quality"})


from . import catalog_io, catalog_tables  # noqa: E402, F401
