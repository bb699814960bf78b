import json

import pytest
from pyspark.sql import functions as F

from loamwork.sources import paged, readers, writers
from loamwork.streaming import jobs

SCHEMA = "id long, name string, page long"


def put(root, page, lines, mark=False):
    folder = root / f"page={page}"
    folder.mkdir(parents=True)
    (folder / "part-0.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    if mark:
        (folder / "_SUCCESS").touch()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_batch_read(spark, tmp_path):
    put(tmp_path, 1, [{"id": 1, "name": "é"}, "{broken", "[1]", "", {"id": 2, "more": 1}])
    put(tmp_path, 2, [])
    put(tmp_path, 3, [{"name": "x" * 3_000_000, "id": 3}])
    put(tmp_path, 5, [{"id": 9}])  # behind a gap
    got = rows(paged.read_pages(spark, f"file://{tmp_path}", SCHEMA))
    assert got == sorted([(1, "é", 1), (None, None, 1), (None, None, 1), (2, None, 1), (3, "x" * 3_000_000, 3)], key=str)
    assert paged.read_pages(spark, str(tmp_path), SCHEMA).rdd.getNumPartitions() == 3
    assert paged.read_pages(spark, str(tmp_path), SCHEMA, pages_per_task=2).rdd.getNumPartitions() == 2
    assert rows(paged.read_pages(spark, str(tmp_path), "page long, id long").filter("page = 3")) == [(3, 3)]


def test_batches_end_by_bytes(spark, tmp_path):
    put(tmp_path, 1, [{"id": k, "name": "x" * 100_000} for k in range(50)])
    schema = spark.createDataFrame([], SCHEMA).schema
    reader = paged.Reader(paged.Folder({"path": str(tmp_path)}), schema)
    sizes = [b.num_rows for p in reader.partitions() for b in reader.read(p)]
    assert sum(sizes) == 50 and max(sizes) <= 11
    assert rows(paged.read_pages(spark, str(tmp_path), SCHEMA)) == sorted([(k, "x" * 100_000, 1) for k in range(50)], key=str)


def test_empty_folder(spark, tmp_path):
    assert paged.read_pages(spark, str(tmp_path), SCHEMA).collect() == []


def test_only_marked_pages(spark, tmp_path):
    put(tmp_path, 1, [{"id": 1}], mark=True)
    put(tmp_path, 2, [{"id": 2}])
    assert [r[0] for r in rows(paged.read_pages(spark, str(tmp_path), SCHEMA, marked="true"))] == [1]


def drain(spark, root, out, **options):
    """Ids of each batch of one run."""
    seen = []
    stream = paged.follow_pages(spark, f"file://{root}", SCHEMA, **options)
    jobs.for_each_batch(stream, lambda d, k: seen.append(sorted(r.id for r in d.collect())), f"file://{out}")
    return seen


def test_second_run_reads_only_new_pages(spark, tmp_path):
    root, state = tmp_path / "in", tmp_path / "state"
    for p in (1, 2, 3):
        put(root, p, [{"id": p}, {"id": 10 * p}])
    assert drain(spark, root, state) == [[1, 2, 3, 10, 20, 30]]
    assert drain(spark, root, state) == []
    put(root, 5, [{"id": 5}])
    assert drain(spark, root, state) == []  # page 4 isn't there
    put(root, 4, [{"id": 4}])
    assert drain(spark, root, state) == [[4, 5]]


def test_offsets():
    class Known(paged.Folder):
        def ready(self, page):
            return page <= 7

    r = paged.StreamReader(Known({"path": "/x", "pages_per_batch": "3", "pages_per_task": "2"}), None)
    assert r.initialOffset() == {"pages": 0}
    assert [r.latestOffset()["pages"] for _ in range(4)] == [3, 6, 7, 7]
    assert [(p.first, p.last) for p in r.partitions({"pages": 3}, {"pages": 6})] == [(4, 5), (6, 6)]
    again = paged.StreamReader(Known({"path": "/x", "pages_per_batch": "3"}), None)
    again.partitions({"pages": 0}, {"pages": 6})  # what a restart replays
    assert again.latestOffset() == {"pages": 7}
    with pytest.raises(ValueError):
        paged.Folder({})


@pytest.fixture
def database(spark):
    url = f"jdbc:derby:memory:{writers.work_path(spark.range(1), 'db').rsplit('/', 1)[-1]}"
    yield url
    readers.drop_embedded(spark, url)


def test_ranges_of_a_skewed_key(spark, database):
    d = spark.range(4000).select(F.when(F.col("id") < 3000, F.col("id")).when(F.col("id") < 3900, F.col("id") * 1000).alias("Key"), (F.col("id") % 7).alias("v"), F.lit("t").alias("s"))
    writers.write_jdbc(d, database + ";create=true", "things", tasks=3, types="s VARCHAR(5)")
    found = readers.read_jdbc_ranges(spark, database, "things", "Key", tasks=8)
    sizes = [r[0] for r in found.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 8 and max(sizes) < 1000  # even ranges would put 3,000 rows into one
    assert sorted(map(str, found.collect())) == sorted(map(str, d.collect()))
    plan = found.filter("v = 3 AND s = 't'").select("Key")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(v,3)" in plan and "EqualTo(s,t)" in plan and "ReadSchema: struct<Key" in plan


def test_tables_without_ranges(spark, database):
    writers.write_jdbc(spark.range(0), database + ";create=true", "empty")
    writers.write_jdbc(spark.createDataFrame([(None,), (None,)], "id long"), database, "nulls")
    writers.write_jdbc(spark.createDataFrame([(5,), (5,), (None,)], "id long"), database, "same")
    assert [readers.read_jdbc_ranges(spark, database, t, "id").count() for t in ("empty", "nulls", "same")] == [0, 2, 3]
