"""Operators over several tables and over states, against brute force."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loamwork.operators import asof, gram, profile, profile_state, references, text_index
from loamwork.sources import writers


def test_correlations_of_wide_tables(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 24)) @ r.normal(size=(24, 24))
    d = pd.DataFrame(x, columns=[f"c.{i}" for i in range(24)])
    d["c.0"] += 1e9  # a large mean
    d["c.1"] = 7.5
    d.loc[r.random(400) < 0.3, "c.2"] = None
    d["c.4"] = d["c.3"] * -2
    d["c.5"] = [None] * 399 + [1.0]
    s = spark.createDataFrame(d).select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in d.columns]).repartition(5)
    got = {(a, b): c for a, b, c in gram.correlations(s, s.columns).collect()}
    want = d.corr(min_periods=2)
    assert len(got) == 24 * 23 // 2
    for (a, b), c in got.items():
        w = want.loc[a.replace("_", "."), b.replace("_", ".")]
        assert (c is None and math.isnan(w)) or c == pytest.approx(w, abs=1e-7)
    plan = profile.correlations(s.drop("c_9"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_correlations_of_odd_columns(spark):
    s = spark.createDataFrame([(1.0, float("inf"), 2.0, None), (2.0, 1.0, 4.0, None), (3.0, 5.0, float("nan"), None)], "a double, b double, c double, e double")
    got = {(a, b): c for a, b, c in gram.correlations(s, s.columns).collect()}
    assert got[("a", "c")] == 1.0 and {k for k, v in got.items() if v is None} == {("a", "b"), ("b", "c"), ("a", "e"), ("b", "e"), ("c", "e")}
    assert all(r.corr is None for r in gram.correlations(s.limit(0), ["a", "b"]).collect())


def test_references(spark):
    r = random.Random(4)
    parents = spark.createDataFrame([(i, f"k{i}", i % 3) for i in range(50)], "id int, code string, grade int")
    children = spark.createDataFrame([(i, r.choice([None, r.randrange(50)]), f"k{r.randrange(60)}", 1.5) for i in range(300)], "id long, parent long, code string, x double")
    got = {(g.child, g.parent): (g.n_values, g.n_found, g.coverage) for g in references.inclusions({"p": parents, "c": children}, 0.6).collect()}
    data = {f"{t}.{c}": [x for x in d.toPandas()[c].tolist() if x is not None and x == x] for t, d in (("p", parents), ("c", children)) for c in d.columns if c != "x"}
    want = {}
    for a, va in data.items():
        for b, vb in data.items():
            same = type(va[0]) is str, type(vb[0]) is str
            if a != b and same[0] == same[1] and len(set(vb)) == len(vb):
                n = len(set(va) & set(vb))
                if n and n / len(set(va)) >= 0.6:
                    want[(a, b)] = (len(set(va)), n, n / len(set(va)))
    assert got == want and ("c.parent", "p.id") in got
    assert references.inclusions({"p": parents.limit(0)}).collect() == []


def brute_asof(left, right):
    out = []
    for k, t, i in left:
        best = max(((rt, v) for rk, rt, v in right if k is not None and rk == k and t is not None and rt is not None and rt <= t), default=(None, None), key=lambda x: (x[0], x[1]))
        out.append((k, t, i, *best))
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", ["2", "40"])
def test_asof_against_trying_all(spark, ranges):
    r = random.Random(5)
    key = lambda: r.choice([1] * 8 + [2, 3, None])  # noqa: E731  most rows have one key
    left = [(key(), r.choice([None, *range(400)]), i) for i in range(300)]
    right = [(key(), r.choice([None, *range(0, 400, 7)]), r.randrange(50)) for _ in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        d = asof.asof_join(spark.createDataFrame(left, "k int, t int, i int"), spark.createDataFrame(right, "k int, t int, v int"), ["k"], "t", "t")
        assert d.columns == ["k", "t", "i", "t_asof", "v_asof"]
        assert sorted(map(tuple, d.collect()), key=str) == brute_asof(left, right)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_asof_of_empty_tables(spark):
    a, b = spark.createDataFrame([(1, 5)], "k int, t int"), spark.createDataFrame([], "k int, u int")
    assert [tuple(r) for r in asof.asof_join(a, b, ["k"], "t", "u").collect()] == [(1, 5, None)]
    assert asof.asof_join(b, a, ["k"], "u", "t").collect() == []


def test_search_against_scanning(spark):
    r = random.Random(6)
    texts = {i: " ".join(r.choice(["Alpha", "beta", "GÄMMA", "delta%_", "x", "😀😀"]) for _ in range(r.randrange(0, 12))) for i in range(200)} | {900: None, 901: "", 902: "ab"}
    d = spark.createDataFrame(list(texts.items()), "id long, text string")
    path = writers.work_path(d, "index")
    text_index.write_index(d, "id", "text", path)
    for p in ["alpha B", "gämma", "%_", "delta%_ x", "nothing at all", "a", "", "😀😀 ", "ALPHAalpha"]:
        got = {x.id for x in text_index.search_index(d, "id", "text", path, p).collect()}
        assert got == {i for i, t in texts.items() if t is not None and p.lower() in t.lower()}


def test_search_reads_lists(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"row {i % 10} of many") for i in range(300)], "id long, text string")
    path = writers.work_path(d, "index")
    text_index.write_index(d, "id", "text", path)
    plan = text_index.candidates(spark, path, "ROW 7")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan and "text" not in plan
    monkeypatch.setattr(text_index, "LOOKED_UP", 5)  # more candidates are joined
    assert text_index.search_index(d, "id", "text", path, "ROW 7").count() == 30


def test_trigrams_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def seen(t):
        made.add(1)
        return t

    d = spark.createDataFrame([(i, f"row {i}") for i in range(100)], "id long, text string").select("id", F.udf(seen)("text").alias("text")).filter("id >= 0")
    text_index.write_index(d, "id", "text", str(tmp_path / "index"))
    once = made.value
    made.value = 0
    d.filter(F.length("text") > 2).select(text_index.grams(F.col("text"))).write.format("noop").mode("overwrite").save()
    assert once == made.value


def state_rows(n=4000):
    r = random.Random(8)
    return [(dt.date(2024, 1, 1) + dt.timedelta(days=i % 9), r.choice([None, "a", "a", "b", f"w{r.randrange(30)}"]), r.gauss(10, 3) if i % 11 else None, r.randrange(3000)) for i in range(n)]


def test_states_merge_to_the_profile_of_all_days(spark):
    rows = state_rows()
    d = spark.createDataFrame(rows, "day date, kind string, v double, w long").repartition(4)
    s = writers.staged(profile_state.states(d, F.col("day"), ["kind", "v", "w"]), "states")
    assert s.count() == 27
    got = {r.column_name: r for r in profile_state.profile(profile_state.merged(s)).collect()}
    v = sorted(r[2] for r in rows if r[2] is not None)
    assert (got["v"].n_rows, got["v"].null_count, got["v"].min, got["v"].max) == (4000, 4000 - len(v), v[0], v[-1])
    for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        at = sum(x <= got["v"][q] for x in v) / len(v)
        assert abs(at - p) <= profile_state.RANK_ERROR
    exact = len({r[3] for r in rows})
    assert abs(got["w"].unique_count - exact) <= 3 * profile_state.DISTINCT_ERROR * exact
    counts = pd.Series([r[1] for r in rows if r[1]]).value_counts()
    assert {(r.value, r.n) for r in profile_state.frequent(profile_state.merged(s), 2).collect()} == set(counts.head(2).items())
    by_day = profile_state.merged(s, ["day"])
    assert by_day.count() == 27


def test_drift_from_states(spark):
    rows = state_rows()
    d = spark.createDataFrame(rows, "day date, kind string, v double, w long")
    moved = d.withColumn("v", F.col("v") + 3)
    one = lambda x: profile_state.merged(profile_state.states(x, F.col("day"), ["kind", "v"]))
    psi = {r.column_name: r.psi for r in profile_state.drift(one(moved), one(d)).collect()}
    lo, hi = min(r[2] for r in rows if r[2]), max(r[2] for r in rows if r[2])
    edges = [-np.inf, *[lo + (hi - lo) * i / 10 for i in range(1, 10)], np.inf]
    base = np.array([r[2] for r in rows if r[2] is not None])
    p, q = (np.maximum(np.histogram(x, edges)[0] / len(base), 1e-4) for x in (base, base + 3))
    assert psi.keys() == {"v"} and psi["v"] == pytest.approx(((q - p) * np.log(q / p)).sum(), rel=0.1)
    assert profile_state.drift(one(d), one(d)).first().psi == pytest.approx(0, abs=0.01)
    assert profile_state.drift(one(d.limit(0)), one(d.limit(0))).collect() == []
