import datetime as dt

import pytest
from pyspark.sql import functions as F

from loamwork.sources import readers
from loamwork.streaming import stateful

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def drained(spark, tmp_path, parts, schema, made):
    """One drain for each part, each a new query from the same checkpoint; rows of each drain."""
    out, seen = [], 0
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stateful.drain(made(readers.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        rows = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
        out.append(len(rows) - seen)
        seen = len(rows)
    return rows, out


def test_sessions_in_any_order(spark, tmp_path):
    parts = [
        [(1, at(0)), (1, at(40)), (2, at(10)), (1, at(29)), (None, at(5))],
        [(1, at(60)), (1, at(20)), (2, at(39)), (2, at(69)), (3, None)],  # joins 0..29 and 40..60 of user 1; ends one of user 2
        [(9, at(5000))],
        [(1, at(1)), (1, at(5001))],  # the first is late
        [(9, at(9000))],
    ]
    rows, each = drained(spark, tmp_path, parts, "user long, ts timestamp", lambda s: stateful.closed_sessions(s, "user", gap="30 minutes", delay="2 hours"))
    want = [(1, at(0), at(90), 5), (1, at(5001), at(5031), 1), (2, at(10), at(69), 2), (2, at(69), at(99), 1), (9, at(5000), at(5030), 1), (None, at(5), at(35), 1)]
    assert rows == sorted(want, key=str)
    assert each == [0, 0, 4, 0, 2]


def test_alerts_have_two_thresholds(spark, tmp_path):
    rate = {0: 0.2, 1: 0.6, 2: 0.45, 3: 0.5, 4: 0.9, 5: 0.3, 6: 0.5, 7: 0.51}
    rows = [("k", at(60 * h + x / 2), x < 100 * r) for h, r in rate.items() for x in range(100)]
    parts = [[(k, t, float(b)) for k, t, b in rows if t < at(150)], [(k, t, float(b)) for k, t, b in rows if t >= at(150)], [("z", at(10_000), None)]]
    found, _ = drained(spark, tmp_path, parts, "k string, ts timestamp, v double", lambda s: stateful.rate_alerts(s, "k", "v > 0", 0.5, 0.4, size="1 hour"))
    assert [(r[0], r[1], r[2]) for r in found] == [("k", at(60), "raised"), ("k", at(300), "cleared"), ("k", at(420), "raised")]
    assert all(r[3] == 100 for r in found)
    with pytest.raises(ValueError):
        stateful.Alerts("k", 1, 0.3, 0.5)


def test_first_events_are_forgotten(spark, tmp_path):
    parts = [[("a", at(0)), ("a", at(1)), ("b", at(2))], [("a", at(30)), ("c", at(500))], [("a", at(501)), ("b", at(502))]]
    rows, each = drained(spark, tmp_path, parts, "k string, ts timestamp", lambda s: stateful.first_events(s, ["k"], hold="2 hours"))
    assert rows == [("a", at(0)), ("a", at(501)), ("b", at(2)), ("b", at(502)), ("c", at(500))] and each == [2, 1, 2]


def test_state_is_in_rocksdb(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    drained(spark, tmp_path, [[("a", at(0))]], "k string, ts timestamp", lambda s: stateful.first_events(s, ["k"]))
    assert spark.conf.get(name) == before
    meta = spark.read.format("state-metadata").load(f"{tmp_path}/checkpoint").filter(F.col("operatorName") == "transformWithStateInPandasExec")
    assert meta.count() == 1
    assert list((tmp_path / "checkpoint" / "state").rglob("*.zip")) or list((tmp_path / "checkpoint" / "state").rglob("*.changelog"))


def test_state_follows_the_buckets(spark, tmp_path):
    big = 2**53
    part = [(big + 2 * u + 1, at(u % 50)) for u in range(2000)] + [(None, at(3))]
    rows, _ = drained(spark, tmp_path, [part], "user long, ts timestamp", lambda s: stateful.closed_sessions(s, "user"))
    assert rows == []
    held = spark.read.format("statestore").option("stateVarName", "held").load(f"{tmp_path}/checkpoint")
    assert 1 < held.count() <= stateful.BUCKETS + 1
    rows, _ = drained(spark, tmp_path, [[(0, at(50_000))]], "user long, ts timestamp", lambda s: stateful.closed_sessions(s, "user"))
    assert sorted(r[0] for r in rows if r[0] is not None) == [u for u, _ in part[:-1]] and len(rows) == 2001


def test_first_of_a_long_batch(spark, tmp_path):
    part = [("a", None, at(30_000 - k)) for k in range(25_000)] + [(None, 7, at(9)), (None, 7, at(8)), ("a", 7, at(10)), (None, None, at(11))]
    rows, _ = drained(spark, tmp_path, [part], "k string, v long, ts timestamp", lambda s: stateful.first_events(s, ["k", "v"], delay="60 days"))
    assert rows == sorted([("a", None, at(5001)), (None, 7, at(8)), ("a", 7, at(10)), (None, None, at(11))], key=str)


def test_state_has_no_more_partitions_than_cores_can_use(spark, tmp_path):
    name, made = "spark.sql.shuffle.partitions", lambda s: stateful.first_events(s, ["k"], hold="2 hours")
    before, most = spark.conf.get(name), 2 * spark.sparkContext.defaultParallelism
    spark.conf.set(name, str(most + 3))
    try:
        drained(spark, tmp_path, [[("a", at(0)), ("b", at(1))]], "k string, ts timestamp", made)
        assert spark.conf.get(name) == str(most + 3)
        spark.conf.set(name, "2")  # a checkpoint keeps its number
        rows, _ = drained(spark, tmp_path, [[("a", at(2)), ("c", at(3))]], "k string, ts timestamp", made)
    finally:
        spark.conf.set(name, before)
    assert rows == [("a", at(0)), ("b", at(1)), ("c", at(3))]
    meta = spark.read.format("state-metadata").load(f"{tmp_path}/checkpoint").filter(F.col("operatorName") == "transformWithStateInPandasExec")
    assert {r.numPartitions for r in meta.collect()} == {most}
