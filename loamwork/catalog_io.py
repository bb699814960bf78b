"""Registered queries of files, schemas, streams and steps, each beside its DuckDB SQL.

File queries write a given table to the shared work folder and read it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import query, union
from .operators import checks, documents, joins, profile
from .plans import pipeline
from .sources import paged, readers, writers
from .streaming import jobs, stateful

# ---------------------------------------------------------------- files


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_written_read(get):
    d = get("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    path = writers.work_path(d, "csv")
    writers.write_csv(d, path)
    return readers.good_rows(readers.read_csv(d.sparkSession, path, d.schema))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT NULL, NULL FROM orders WHERE o_orderkey % 10 = 0")
def csv_bad_lines(get):
    """Every tenth line holds no number where one is due; it is kept apart."""
    d = get("orders")
    path = writers.work_path(d, "csv")
    bad = F.col("o_orderkey") % 10 == 0
    d.select(F.when(bad, F.concat(F.lit("x"), F.col("o_orderkey"))).otherwise(F.col("o_orderkey").cast("string")).alias("o_orderkey"), "o_totalprice").write.option("header", True).csv(path)
    found = readers.read_csv(d.sparkSession, path, "o_orderkey long, o_totalprice double")
    good = ~readers.is_broken(found)
    return found.select(*[F.when(good, F.col(c)).alias(c) for c in ("o_orderkey", "o_totalprice")])


@query("SELECT c_custkey, c_mktsegment, c_nationkey, ';' AS delimiter, 'UTF-8' AS encoding FROM customer")
def csv_sniffed(get):
    d = get("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    spark, path = d.sparkSession, writers.work_path(d, "csv")
    d.write.option("header", True).option("sep", ";").csv(path)
    sep, encoding = readers.sniff_delimiter(spark, path), readers.sniff_encoding(spark, path)
    return readers.good_rows(readers.read_csv(spark, path, delimiter=sep, encoding=encoding)).select("*", F.lit(sep).alias("delimiter"), F.lit(encoding).alias("encoding"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def json_objects_read(get):
    """One object per file."""
    d = get("supplier").select("s_suppkey", "s_name", "s_acctbal")
    path = writers.work_path(d, "json")
    # a small table comes as one task, but its files are as many as its rows
    spread = d.repartition(4 * d.sparkSession.sparkContext.defaultParallelism)
    writers.write_records(spread, path)
    return readers.read_json(d.sparkSession, path, d.schema)


@query("SELECT CASE WHEN event_id % 7 <> 0 THEN event_id END AS event_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS event_type, event_id % 7 = 0 AS broken FROM events")
def jsonl_read(get):
    """Every seventh line is cut short; it is kept as a broken row."""
    d = get("events")
    path = writers.work_path(d, "jsonl")
    line = F.to_json(F.struct("event_id", "event_type"))
    d.select(F.when(F.col("event_id") % 7 == 0, F.left(line, F.lit(9))).otherwise(line)).write.text(path)
    found = readers.read_jsonl(d.sparkSession, path, "event_id long, event_type string")
    broken = readers.is_broken(found)
    return found.select(F.when(~broken, F.col("event_id")).alias("event_id"), F.when(~broken, F.col("event_type")).alias("event_type"), broken.alias("broken"))


@query("SELECT event_type, event_id, user_id FROM events")
def json_written_read(get):
    d = get("events").select("event_type", "event_id", "user_id")
    path = writers.work_path(d, "json")
    writers.write_json(d, path)
    return readers.read_jsonl(d.sparkSession, path).select("event_type", "event_id", "user_id")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, 'orders' AS described FROM orders")
def parquet_written_read(get):
    d = get("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    spark, path = d.sparkSession, writers.work_path(d, "parquet")
    writers.write_parquet(d, path, ["o_orderstatus"], metadata={"table": "orders"})
    note = spark.read.parquet(path + "_metadata").filter("key = 'table'").select(F.col("value").alias("described"))
    return spark.read.parquet(path).crossJoin(F.broadcast(note)).select("o_orderkey", "o_orderstatus", "o_totalprice", "described")  # one row


@query("SELECT 'csv' AS extension, 'csv' AS format, count(DISTINCT lang) AS n_files, count(DISTINCT lang) AS n_fingerprints FROM documents")
def files_catalogued(get):
    d = get("documents")
    path = writers.work_path(d, "files")
    d.select("doc_id", "source", "lang").repartition("lang").write.partitionBy("lang").csv(path)
    return readers.file_catalog(d.sparkSession, path).groupBy("extension", "format").agg(F.count("*").alias("n_files"), F.count_distinct("fingerprint").alias("n_fingerprints"))


@query("SELECT 'rows' AS kind, count(*) AS n FROM events UNION ALL SELECT 'files that failed', 1")
def broken_files_skipped(get):
    d = get("events").select("event_id", "user_id")
    spark, path = d.sparkSession, writers.work_path(d, "mixed")
    d.write.parquet(f"{path}/good")
    d.select(F.col("event_id").cast("string")).coalesce(1).write.text(f"{path}/bad")  # no Parquet inside
    paths = [f"{path}/good", f"{path}/bad"]
    files = spark.read.format("binaryFile").load(paths).select("path")
    rows, failed = readers.resilient_load(spark, paths, files, schema=d.schema)
    n = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(rows, "rows").unionByName(n(failed, "files that failed"))


@query("""SELECT path, extension, CASE doc_id % 4 WHEN 0 THEN 'dashboard' WHEN 1 THEN 'chart' WHEN 2 THEN 'table' ELSE 'chart' END AS analysis FROM (
SELECT doc_id, '/in/' || source || '/' || (['Dashboard', 'graph', 'table', 'photo'])[doc_id % 4 + 1] || doc_id || '.' || ext AS path, ext AS extension FROM (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'txt' ELSE 'png' END AS ext FROM documents)) WHERE extension = 'png' AND path IS NOT NULL""")
def files_routed(get):
    ext = F.when(F.col("doc_id") % 3 == 0, "txt").otherwise("png")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Dashboard", "graph", "table", "photo")]), (F.col("doc_id") % 4 + 1).cast("int"))
    files = get("documents").select(F.concat(F.lit("/in/"), F.col("source"), F.lit("/"), kind, F.col("doc_id"), F.lit("."), ext).alias("path"), ext.alias("extension")).filter("path IS NOT NULL")
    return readers.route_by_name(files, [".png", "jpg"])


@query("""SELECT o_orderkey AS order_key, o_orderdate AS order_date, 'orders.pdf' AS source_file, 1 AS page FROM orders
UNION ALL SELECT l_orderkey, l_shipdate, 'lines.pdf', 2 FROM lineitem""")
def tables_standardized(get):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    a = get("orders").select(F.col("o_orderkey").alias("Order Key"), text("o_orderdate").alias("Order-Date"))
    b = get("lineitem").select(F.col("l_orderkey").alias("order  key"), text("l_shipdate").alias("ORDER DATE"))
    return readers.standardize_tables([(a, "orders.pdf", 1), (b, "lines.pdf", 2)])


@query("SELECT c_custkey AS key, c_name AS key_1, c_mktsegment AS key_1_1, c_nationkey AS nation_key, c_acctbal AS column FROM customer".replace("AS column", 'AS "column"'))
def names_cleaned(get):
    d = get("customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal")
    return readers.clean_columns(d.toDF("Key", " key ", "key_1", "Nation--Key!", "?"))


@query("SELECT CASE json_type(props) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'primitive' END AS shape, (SELECT count(*) FROM events) AS n_rows FROM events ORDER BY event_id LIMIT 1")
def json_shapes(get):
    d = get("events")
    sample = d.orderBy("event_id").select("props").first().props
    return d.agg(F.lit(readers.json_shape(sample, d.sparkSession)).alias("shape"), F.count("*").alias("n_rows"))


@query("""WITH p AS (SELECT event_id, user_id, event_type, event_id // 500 + 1 AS page FROM events)
SELECT event_id, user_id, event_type, page, CASE WHEN page <= (SELECT max(page) FROM p) // 2 THEN 1 ELSE 2 END AS run FROM p""")
def pages_followed(get):
    """Pages followed as a stream: half of them, then from the checkpoint only what came since."""
    d = get("events").select("event_id", "user_id", "event_type", F.expr("event_id div 500 + 1").alias("page"))
    spark, path = d.sparkSession, writers.work_path(d, "pages")
    half = d.agg(F.max("page")).first()[0] // 2
    schema = "event_id long, user_id long, event_type string, page long"
    for run, part in ((1, d.filter(F.col("page") <= half)), (2, d.filter(F.col("page") > half))):
        part.repartition("page").write.mode("append").partitionBy("page").json(f"{path}/in")
        new = paged.follow_pages(spark, f"{path}/in", schema, pages_per_task=4).withColumn("run", F.lit(run))
        jobs.for_each_batch(new, lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/out/batch={batch}"), f"{path}/checkpoint")
    return spark.read.schema(f"{schema}, run int").parquet(f"{path}/out").drop("batch")


@query("SELECT page_id, url, html, page_id % 7 + 1 AS page FROM pages")
def pages_read(get):
    """Seven pages of JSON lines, read at once."""
    d = get("pages").select("page_id", "url", "html", (F.col("page_id") % 7 + 1).alias("page"))
    path = writers.work_path(d, "pages")
    d.repartition("page").write.partitionBy("page").json(path)
    return paged.read_pages(d.sparkSession, path, "page_id long, url string, html string, page long")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F'")
def jdbc_ranges_read(get):
    """Orders in an embedded database (of this process, so for local sessions), written and read in parallel ranges of the key."""
    d = get("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    spark = d.sparkSession
    url = "jdbc:derby:memory:" + writers.work_path(d, "orders").rsplit("/", 1)[-1]
    writers.write_jdbc(d, url + ";create=true", "orders", types="o_orderstatus VARCHAR(4)")
    found = readers.read_jdbc_ranges(spark, url, "orders", "o_orderkey").filter("o_totalprice > 250000 AND o_orderstatus = 'F'")
    kept = writers.staged(found, "jdbc")
    readers.drop_embedded(spark, url)
    return kept


# ---------------------------------------------------------------- schemas and steps

KINDS = "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END"


@query("SELECT 'lineitem' AS tab, " + f"{KINDS} AS dtype, count(*) AS n FROM (DESCRIBE lineitem) GROUP BY 2 UNION ALL SELECT 'customer', {KINDS}, count(*) FROM (DESCRIBE customer) GROUP BY 2")
def type_histogram(get):
    parts = [profile.type_histogram(get(t)).select(F.lit(t).alias("tab"), "dtype", "n") for t in ("lineitem", "customer")]
    return parts[0].unionByName(parts[1])


@query("""WITH t AS (SELECT column_name, column_type FROM (DESCRIBE customer))
SELECT 'invalid_values' AS issue_type, 'critical' AS severity, NULL::VARCHAR AS column_name, 1::BIGINT AS n_affected, 1.0::DOUBLE AS ratio, (SELECT count(*) FROM customer) AS n_rows
FROM (SELECT unnest(['c_custkey', 'c_email', 'c_phone']) AS c) WHERE c NOT IN (SELECT column_name FROM t)
UNION ALL SELECT 'schema_violations', 'high', column_name, 1, 1.0, (SELECT count(*) FROM customer)
FROM t JOIN (SELECT unnest(['c_custkey', 'c_acctbal', 'c_mktsegment', 'c_name']) AS c, unnest(['BIGINT', 'BIGINT', 'DOUBLE', 'VARCHAR']) AS kind) ON c = column_name AND kind <> column_type""")
def schema_checked(get):
    d = get("customer")
    found = checks.check_schema(d, ["c_custkey", "c_email", "c_phone"], {"c_custkey": "integer", "c_acctbal": "integer", "c_mktsegment": "float", "c_name": "string"})
    return found.drop("metrics").crossJoin(F.broadcast(d.agg(F.count("*").alias("n_rows"))))  # one row


@query("""SELECT * FROM (SELECT 0 AS pos, 'quality_validation' AS step, 'Ensure data quality' AS reason UNION ALL SELECT 1, 'data_cleaning', 'Handle missing values and duplicates' UNION ALL SELECT 2, 'pii_detection', 'Check for sensitive data')
WHERE (SELECT bool_or(regexp_matches(source || '.csv', 'csv|excel')) FROM documents WHERE doc_id % 2 = 0)""")
def steps_recommended(get):
    kind = F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit(".csv"))).otherwise(F.concat("source", F.lit(".png")))
    return documents.recommended_steps(get("documents").select(kind.alias("file_type")))


@query("SELECT user_id % 5 AS pipeline, count(event_id) AS n FROM events WHERE value > 10 AND event_type <> 'error' GROUP BY 1")
def steps_with_checkpoint(get):
    """A step's table is written to the work folder and read again by the next."""
    d = get("events")
    steps = [
        {"name": "keep", "type": "filter", "config": {"condition": "value > 10 & event_type != 'error'"}, "checkpoint": writers.work_path(d, "step")},
        {"name": "key", "type": "custom", "config": {"fn": lambda x: x.withColumn("pipeline", F.col("user_id") % 5)}},
        {"name": "sum", "type": "aggregate", "config": {"keys": ["pipeline"], "aggs": {"n": ("event_id", "count")}}},
    ]
    return pipeline.run(steps, d)["sum"]


def _doubled(frames):
    for f in frames:
        f["twice"] = f["value"] * 2
        yield f[["event_id", "twice"]]


@query("SELECT event_id, value * 2 AS twice FROM events WHERE user_id % 2 = 0")
def user_code_step(get):
    """A user's function over pandas batches, with a declared schema."""
    steps = [{"name": "even", "type": "filter", "config": {"condition": "user_id % 2 = 0"}}, {"name": "own", "type": "map_pandas", "config": {"fn": _doubled, "schema": "event_id long, twice double"}}]
    return pipeline.run(steps, get("events").select("event_id", "user_id", "value"))["own"]


@query("SELECT c.c_custkey AS key, c_name AS name_left, s_name AS name_right, c_acctbal, s_acctbal FROM customer c FULL JOIN supplier s ON c_custkey = s_suppkey".replace("c.c_custkey AS key", "coalesce(c_custkey, s_suppkey) AS key"))
def aligned_by_key(get):
    a = get("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), "c_acctbal")
    b = get("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), "s_acctbal")
    return joins.align(a, b, "full", keys=["key"])


# ---------------------------------------------------------------- streams over batch tables


@query("SELECT DISTINCT user_id, event_type FROM events")
def ingest_deduplicated(get):
    return jobs.deduplicated(get("events").select("user_id", "event_type", "ts"), ["user_id", "event_type"]).select("user_id", "event_type")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n_rows, count(*) FILTER (value > 50) AS n_bad, round(count(*) FILTER (value > 50) / count(*)::DOUBLE, 6) AS bad_rate FROM events GROUP BY 1, 2 HAVING count(*) FILTER (value > 50) / count(*)::DOUBLE > 0.5")
def alerts_raised(get):
    d = jobs.alerts(jobs.quality_counts(get("events"), ["event_type"], "value > 50"), 0.5)
    return d.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n_rows", "n_bad", F.round("bad_rate", 6).alias("bad_rate"))


@query("SELECT event_id, user_id, NOT value >= 1 AS failed FROM events")
def stream_drained(get):
    """A stream of the table's files through the row-level rules into Parquet, and read back."""
    d = get("events").select("event_id", "user_id", "value")
    spark, path = d.sparkSession, writers.work_path(d, "stream")
    d.write.parquet(f"{path}/in")
    s = jobs.checked_ingest(readers.file_stream(spark, f"{path}/in", d.schema), {"least": "value >= 1"})
    jobs.run_available(s, f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").select("event_id", "user_id", (F.col("failed_rules") == "least").alias("failed"))


@query("""WITH m AS (SELECT date_trunc('hour', max(ts)) AS top FROM events)
SELECT count(*) FILTER (ts >= top) AS n_on_time, count(*) FILTER (ts < top - INTERVAL 1 DAY) AS n_late FROM events, m""")
def late_rows_counted(get):
    """The newest hour comes first; what is a day older comes afterwards, behind the watermark."""
    d = get("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    spark, path = d.sparkSession, writers.work_path(d, "late")
    top = F.date_trunc("hour", F.lit(d.agg(F.max("ts")).first()[0]))
    source = f"{path}/in"
    kept = lambda: jobs.deduplicated(readers.file_stream(spark, source, d.schema), ["event_id"])
    d.filter(F.col("ts") >= top).write.parquet(source)
    late = jobs.run_available(kept(), f"{path}/out", f"{path}/checkpoint")
    old = d.filter(F.col("ts") < top - F.expr("INTERVAL 1 DAY"))
    old.write.mode("append").parquet(source)
    late += jobs.run_available(kept(), f"{path}/out", f"{path}/checkpoint")
    return d.agg(F.count_if(F.col("ts") >= top).alias("n_on_time"), F.lit(late).cast("long").alias("n_late"))


# ---------------------------------------------------------------- streams with state


def _in_two_runs(d: DataFrame, made, label: str) -> DataFrame:
    """Events of the earlier and then of the later half of the time, each drained from files by
    a query of its own that goes on from the checkpoint; a last event far behind closes all."""
    spark, path = d.sparkSession, writers.work_path(d, label)
    lo, hi = d.agg(F.min("ts"), F.max("ts")).first()
    half = F.lit(lo + (hi - lo) / 2)
    last = d.limit(1).select(*[F.lit(hi).cast(t) + F.expr("INTERVAL 30 DAYS") if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in d.dtypes]).toDF(*d.columns)
    for part in (d.filter(F.col("ts") < half), d.filter(F.col("ts") >= half), last):
        part.write.mode("append").parquet(f"{path}/in")
        stateful.drain(made(readers.file_stream(spark, f"{path}/in", d.schema)), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out")


@query("""WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, new DESC) AS k FROM e)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS n_events FROM s GROUP BY user_id, k""")
def sessions_streamed(get):
    """Sessions of a stream, closed by timers."""
    d = get("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = _in_two_runs(d, lambda s: stateful.closed_sessions(s, "user_id"), "sessions")
    return s.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n_events")


@query("""WITH w AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS w, count(*) AS n, count(*) FILTER (value > 50) AS bad FROM events GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN bad / n::DOUBLE > 0.5 THEN 1 WHEN bad / n::DOUBLE < 0.35 THEN 0 END AS mark FROM w),
s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY w), 0) AS state FROM m)
SELECT event_type, epoch_us(w) AS window_us, CASE WHEN state = 1 THEN 'raised' ELSE 'cleared' END AS change, n AS n_rows, bad AS n_bad
FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY event_type ORDER BY w), 0) AS before FROM s) WHERE state <> before""")
def alerts_streamed(get):
    """Alerts of a stream with hysteresis: raised above a half, cleared below 35 %."""
    d = get("events").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    s = _in_two_runs(d, lambda s: stateful.rate_alerts(s, "event_type", "value > 50", 0.5, 0.35, size="6 hours"), "alerts")
    return s.select("event_type", F.unix_micros("window_start").alias("window_us"), "change", "n_rows", "n_bad")


@query("SELECT user_id, event_type, epoch_us(min(ts)) AS first_us FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2")
def first_events_streamed(get):
    """The first event of each user and type; the state of a key is held for 60 days."""
    d = get("events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    s = _in_two_runs(d, lambda s: stateful.first_events(s, ["user_id", "event_type"], hold="60 days"), "first")
    return s.filter("user_id IS NOT NULL").select("user_id", "event_type", F.unix_micros("ts").alias("first_us"))
