import json

import pytest
from pyspark.sql import functions as F

from loamwork.sources import readers as R
from loamwork.sources import writers as W
from loamwork.streaming import jobs

EVENTS = "/root/testdata/sf0.001/events.parquet"


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv(spark, tmp_path):
    p = put(tmp_path / "a.csv", "name,age,city\nAnn,30,Rome\nBob,x,Oslo\n")
    d = R.read_csv(spark, p, "name string, age int, city string").cache()
    assert R.good_rows(d).count() == 1 and R.bad_row_count(d).first().bad_rows == 1
    assert R.read_csv(spark, p).count() == 2
    q = put(tmp_path / "b.csv", "a;b\n1;2\n")
    assert R.sniff_delimiter(spark, q) == ";" and R.sniff_encoding(spark, q) == "UTF-8"
    (tmp_path / "c.csv").write_bytes("é;b\n".encode("latin-1") * 3000)
    assert R.sniff_encoding(spark, str(tmp_path / "c.csv")) == "ISO-8859-1"


def test_json(spark, tmp_path):
    p = put(tmp_path / "a.json", json.dumps([{"id": 1, "o": {"x": 2}, "l": [1, 2]}, {"id": 2, "o": {"x": 3}, "l": []}]))
    d = R.read_json(spark, p)
    assert R.flatten(d).columns == ["id", "l", "o.x"] and R.flatten(d, "_").columns[-1] == "o_x"
    assert R.arrays(d, "l").count() == 3
    assert [r.l for r in R.arrays(d, "l", "join").orderBy("id").collect()] == ["1, 2", ""]
    assert [r.l for r in R.arrays(d, "l", "first").orderBy("id").collect()] == [1, None]
    q = put(tmp_path / "b.jsonl", '{"id": 1}\n{broken\n{"id": 2}\n')
    lines = R.read_jsonl(spark, q).cache()
    assert R.good_rows(lines).count() == 2
    t = spark.createDataFrame([('{"a": {"b": [{"v": 1}, {"v": 2}]}, "m": {"x": {"v": 3}, "y": {"v": 4}}}',)], "j string")
    assert [r.v for r in R.json_path_rows(t, "j", "$.a.b[*]", "v: int").collect()] == [1, 2]
    assert sorted(tuple(r) for r in R.record_dict_rows(t.select(F.get_json_object("j", "$.m").alias("j")), "j", "v: int").collect()) == [("x", 3), ("y", 4)]
    shapes = {"[1]": "array", '{"a": {"v": 1}, "b": {"v": 2}}': "object_of_objects", '{"a": [1]}': "object_of_arrays", '{"a": 1}': "object", "3": "primitive"}
    assert {k: R.json_shape(k, spark) for k in shapes} == shapes
    bad = spark.createDataFrame([('{"v": 1,}',), ("{nope",)], "j string")
    assert [(r.v, r.error) for r in R.json_repair(bad, "j", "v int").collect()] == [(1, None), (None, "invalid json")]


def test_types_and_tables(spark):
    d = spark.createDataFrame([("1", "1.5", "true", "2024-01-01", "x"), ("2", "2", "false", "2024-01-02", "1")], "a string, b string, c string, d string, e string")
    assert [t for _, t in R.infer_types(d).dtypes] == ["bigint", "double", "boolean", "timestamp", "string"]
    assert dict(R.coerce_mixed(d).dtypes)["a"] == "double"
    p = {r.column_name: r for r in R.schema_profile(d, ["a"]).collect()}
    assert p["a"].samples == ["1", "2"] and p["e"].unique_count == 2
    s = R.standardize_tables([(d.select(F.col("d").alias("The Date")), "f", 1), (d.select(F.col("e").alias("E x")), "g", 2)])
    assert s.columns == ["the_date", "source_file", "page", "e_x"] and s.count() == 4
    assert R.sheet_union({"one": d, "two": d.select("a")}).filter("_sheet = 'two' AND b IS NULL").count() == 2
    assert R.csv_text_rows(spark.createDataFrame([('1, "a, b"',)], "l string"), "l", "n int, t string").first() == (1, "a, b")
    x = spark.createDataFrame([(bytearray("é".encode()),), (bytearray("é".encode("latin-1")),)], "content binary")
    assert [(r.text, r.encoding) for r in R.decode_text(x).collect()] == [("é", "utf-8"), ("é", "latin-1")]


def test_files(spark, tmp_path):
    put(tmp_path / "x_table.TXT", "l1\nl2\n\np2")
    put(tmp_path / "dashboard.png", "not a picture")
    c = R.file_catalog(spark, str(tmp_path)).cache()
    assert {r.format for r in c.collect()} == {"txt", "png"} and c.filter("length(fingerprint) = 32").count() == 2
    assert {r.analysis for r in R.route_by_name(c, [".png", "txt"]).collect()} == {"dashboard", "table"}
    assert R.text_lines(spark, str(tmp_path / "x_table.TXT")).count() == 4
    n = R.text_counts(spark.createDataFrame([("a\nb\n\nc",)], "value string")).first()
    assert (n.n_lines, n.n_paragraphs, n.n_chars) == (4, 2, 6)
    d = spark.createDataFrame([("text/csv", "x"), (None, "PDF"), (None, "")], "m string, e string")
    assert [r[0] for r in d.select(R.format_of(F.col("m"), F.col("e"))).collect()] == ["csv", "pdf", "unknown"]


def test_resilient_load(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "good"))
    put(tmp_path / "bad.parquet", "broken")
    paths = [str(tmp_path / "good"), str(tmp_path / "bad.parquet")]
    catalog = spark.read.format("binaryFile").load([str(next((tmp_path / "good").glob("part*.parquet"))), paths[1]]).select("path")
    ok, failed = R.resilient_load(spark, paths, catalog, schema="id long")
    assert ok.count() == 3 and [r.path.endswith("bad.parquet") for r in failed.collect()] == [True]


def test_sinks_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", "p"), (2, "b,c", "q")], "i long, t string, k string")
    W.write_csv(d, str(tmp_path / "c"))
    W.write_json(d, str(tmp_path / "j"))
    W.write_parquet(d, str(tmp_path / "p"), ["k"], metadata={"score": "9"})
    key = lambda x: sorted(tuple(r) for r in x.select("i", "t", "k").collect())
    assert key(d) == key(R.good_rows(R.read_csv(spark, str(tmp_path / "c"), d.schema))) == key(spark.read.json(str(tmp_path / "j"))) == key(spark.read.parquet(str(tmp_path / "p")))
    assert spark.read.parquet(str(tmp_path / "p_metadata")).first().value == "9"
    facts, head = R.preview(d, ["i"], 1)
    assert facts.first().n_rows == 2 and head.count() == 1
    assert R.result_view(d.withColumn("meta_x", F.lit(1)), ["i"], "t").columns == ["i", "preview", "text_length", "words", "meta_x"]


def test_options():
    o = R.jdbc_options("h", 5432, "d", table="t", user="u", partition=("id", 0, 100, 4))
    assert o["url"] == "jdbc:postgresql://h:5432/d" and o["numPartitions"] == "4"
    with pytest.raises(ValueError):
        R.jdbc_options("h", 1, "d")
    assert R.kafka_options("b:9092", "t")["subscribe"] == "t"


@pytest.fixture()
def stream(spark, tmp_path):
    """Events in time order over several files, one a trigger."""
    d = spark.read.parquet(EVENTS)
    d.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    return R.file_stream(spark, str(tmp_path / "in"), d.schema, files_per_trigger=1), d


def test_stream_equals_batch(spark, stream, tmp_path):
    s, d = stream
    jobs.run_available(jobs.quality_counts(s, ["event_type"], "value > 100", delay="40 days"), str(tmp_path / "o"), str(tmp_path / "k"))
    got = spark.read.parquet(str(tmp_path / "o"))
    assert got.count() <= jobs.quality_counts(d, ["event_type"], "value > 100").count()
    q = jobs.quality_counts(s, ["event_type"], "value > 100", delay="40 days").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "k2")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda x: sorted(tuple(r) for r in x.collect())
    assert key(spark.table("counts")) == key(jobs.quality_counts(d, ["event_type"], "value > 100"))


def test_stream_dedup_and_rules(spark, stream, tmp_path):
    s, d = stream
    seen = []
    both = jobs.checked_ingest(jobs.deduplicated(s, ["event_id"], delay="40 days"), {"low": "value >= 1"}, ["props"])
    jobs.for_each_batch(both, lambda b, i: seen.extend((r.event_id, r.failed_rules, r.props_has_pii) for r in b.collect()), str(tmp_path / "k"))
    assert sorted(x[0] for x in seen) == sorted(r.event_id for r in d.select("event_id").distinct().collect())
    assert sum(x[1] == "low" for x in seen) == d.filter("value < 1").count()


def test_sessions_and_alerts(spark):
    d = spark.read.parquet(EVENTS)
    s = jobs.sessions(d, "user_id")
    assert s.agg(F.sum("n_events")).first()[0] == d.count()
    a = jobs.alerts(jobs.quality_counts(d, [], "value > 10"), 0.5)
    assert a.filter("bad_rate <= 0.5").count() == 0
    assert jobs.quality_counts(d, [], "value > 10", slide="12 hours").count() > jobs.quality_counts(d, [], "value > 10").count()


def test_files_without_rows_have_not_failed(spark, tmp_path):
    d = spark.range(10)
    d.write.parquet(f"{tmp_path}/in/good")
    d.limit(0).coalesce(1).write.parquet(f"{tmp_path}/in/empty")
    for k in range(3):
        (tmp_path / "in" / f"bad{k}").mkdir()
        (tmp_path / "in" / f"bad{k}" / "x y.parquet").write_text("no Parquet")
    paths = [f"file://{p}" for p in sorted((tmp_path / "in").iterdir())]
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    rows, failed = R.resilient_load(spark, paths, files, schema=d.schema)
    assert rows.count() == 10
    assert sorted(r.path.split("/")[-2] for r in failed.collect()) == ["bad0", "bad1", "bad2"]


def test_a_file_for_each_row_from_many_tasks(spark, monkeypatch):
    from loamwork import catalog_io  # noqa: F401
    from loamwork.catalog import QUERIES

    paths = []
    kept = W.write_records
    monkeypatch.setattr(W, "write_records", lambda df, path: (paths.append((df.rdd.getNumPartitions(), path)), kept(df, path)))
    n = QUERIES["json_objects_read"](spark, "/root/testdata/sf0.001").count()
    assert n == spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()
    assert paths[0][0] == 4 * spark.sparkContext.defaultParallelism
    assert spark.read.format("binaryFile").load(paths[0][1]).count() == n
