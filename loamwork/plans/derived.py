"""Tables derived from the given ones, by SQL that Spark and DuckDB both run.

Given tables stand in braces; `spark_table` fills them with DataFrames, `sql_of` with names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DERIVED = {
    "dirty_customer": """
        WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
                          CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 2 THEN concat('  ', c_mktsegment, '  ')
                               WHEN c_custkey % 5 = 1 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM {customer})
        SELECT * FROM c UNION ALL SELECT * FROM c WHERE c_custkey % 17 = 0""",
    "dirty_orders": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderkey % 97 = 0 THEN 'invalid'
                    WHEN o_orderkey % 10 = 3 THEN concat(lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/', CAST(year(o_orderdate) AS STRING))
                    ELSE concat(CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(day(o_orderdate) AS STRING), 2, '0')) END AS order_date_text,
               CASE WHEN o_orderkey % 50 = 1 THEN 'n/a' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END AS total_text
        FROM {orders}""",
    "dirty_contacts": """
        SELECT c_custkey, concat('note ', CASE WHEN c_custkey % 3 = 0 THEN concat('user', CAST(c_custkey AS STRING), '@mail.example.com ') ELSE '' END,
               CASE WHEN c_custkey % 4 = 1 THEN concat(lpad(CAST(c_custkey % 1000 AS STRING), 3, '2'), '-555-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), ' ') ELSE '' END,
               CASE WHEN c_custkey % 5 = 2 THEN concat(lpad(CAST(c_custkey % 1000 AS STRING), 3, '1'), '-45-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), ' ') ELSE '' END,
               CASE WHEN c_custkey % 7 = 3 THEN concat('4111-1111-1111-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), ' ') ELSE '' END,
               CASE WHEN c_custkey % 9 = 4 THEN concat('10.0.', CAST(c_custkey % 256 AS STRING), '.7') ELSE '' END, 'end') AS note
        FROM {customer}""",
    "dirty_orphans": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS o_custkey FROM {orders}""",
    "executions": """
        SELECT event_id AS execution_id, user_id % 5 AS pipeline_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'completed' END AS status,
               ts, value AS execution_time_seconds, event_id % 1000 AS rows_processed, CAST(event_id % 100 AS DOUBLE) / 1000 AS llm_cost_usd FROM {events}""",
    "llm_usage": """
        SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' WHEN 2 THEN 'google' ELSE 'other' END AS provider,
               CASE event_id % 4 WHEN 0 THEN 'claude-sonnet-4-20250514' WHEN 1 THEN 'gpt-4-turbo-preview' WHEN 2 THEN 'gemini-1.5' ELSE 'local' END AS model,
               event_id % 2000 AS prompt_tokens, event_id % 500 AS completion_tokens FROM {events}""",
    "responses": """
        SELECT doc_id, CASE doc_id % 5
            WHEN 0 THEN concat('Here: [{"question": "q', CAST(doc_id AS STRING), '", "answer": "a"}, {"question": "r", "answer": "', lang, '"}]')
            WHEN 1 THEN concat('{"data": [{"question": "q', CAST(doc_id AS STRING), '", "answer": "', source, '"}]}')
            WHEN 2 THEN concat('{"question": "q', CAST(doc_id AS STRING), '", "answer": "', lang, '"}')
            WHEN 3 THEN concat('Q: q', CAST(doc_id AS STRING), chr(10), 'A: ', lang, chr(10), 'Q: next', chr(10), 'A: ', source)
            ELSE concat('plain ', source) END AS response FROM {documents}""",
}


def spark_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    import re

    sql = DERIVED[name]
    tables = set(re.findall(r"\{(\w+)\}", sql)) - {"question", "data"}
    for t in tables:
        sql = sql.replace("{" + t + "}", f"parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(sql)


def sql_of(name: str) -> str:
    import re

    return re.sub(r"\{(customer|orders|events|documents|lineitem)\}", r"\1", DERIVED[name])


def with_derived(query: str, *names: str) -> str:
    """A DuckDB query over derived tables, as one statement."""
    return "WITH " + ", ".join(f"{n} AS ({sql_of(n)})" for n in names) + (", " + query.strip()[5:] if query.strip().upper().startswith("WITH ") else " " + query)
