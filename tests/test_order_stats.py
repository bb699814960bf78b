"""Exact quantiles, distinct counts and modes against numpy, over many and few values."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.operators import order_stats as O


def rows():
    r = random.Random(3)
    for i in range(20_000):
        yield (
            r.gauss(0, 1e6),
            r.choice([1.0, 1.0, 1.0, 2.0, 3.5]),
            r.expovariate(1) if i % 10 else None,
            float("nan") if i % 7 == 0 else float(i),
            r.choice([1e300, -1e300, 0.0, r.random()]),
            i % 3 * 10**12,
            None,
            r.choice("abcab") if i % 5 else None,
        )


SCHEMA = "a double, b double, c double, d double, e double, f long, g double, s string"


@pytest.mark.parametrize("bracket", [5000, 50])
def test_against_numpy(spark, monkeypatch, bracket):
    monkeypatch.setattr(O, "BRACKET_ROWS", bracket)
    data = list(rows())
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = O.quantiles(df, list("abcdefg"), probs)
    for i, c in enumerate("abcdef"):
        want = np.percentile([x[i] for x in data if x[i] is not None and x[i] == x[i]], [100 * p for p in probs])
        assert np.allclose(got[c], want, rtol=1e-12), c
    assert "g" not in got
    distinct = O.distinct_counts(df, list("abcfgs")).first()
    assert list(distinct) == [len({x[i] for x in data} - {None}) for i in (0, 1, 2, 5, 6, 7)]
    assert O.modes(df, ["s"]) == {"s": min(k for k, n in Counter(x[7] for x in data if x[7]).items() if n == max(Counter(x[7] for x in data if x[7]).values()))}


@pytest.mark.parametrize("bracket", [5000, 20])
def test_heavy_values_infinities_and_a_sketch_that_is_wrong(spark, monkeypatch, bracket):
    monkeypatch.setattr(O, "BRACKET_ROWS", bracket)
    r = random.Random(5)
    inf = float("inf")
    data = [(r.choice([7.0, 7.0, r.random() * 14]), r.choice([-inf, 1.0, 2.0, inf]), float(i)) for i in range(9000)]
    df = spark.createDataFrame(data, "a double, b double, c double").repartition(3)
    probs = [0.0, 0.2, 0.5, 0.503, 0.9, 1.0]

    def rank(values, p):
        values = sorted(values)
        k = p * (len(values) - 1)
        lo, hi = values[int(np.floor(k))], values[int(np.ceil(k))]
        return lo if lo == hi else lo + (hi - lo) * (k - np.floor(k))

    def right():
        got = O.quantiles(df, ["a", "b", "c"], probs)
        for i, c in enumerate("abc"):
            assert np.allclose(got[c], [rank([x[i] for x in data], p) for p in probs], rtol=1e-12), c

    right()
    # brackets beside their ranks are opened again
    kept = O.Bracket.__init__
    monkeypatch.setattr(O.Bracket, "__init__", lambda self, i, p, n, a, b: kept(self, i, p, n, b + 1, b + 2))
    right()


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(float(k),) for k in range(n)], "x double")
    got = O.quantiles(df, ["x"], [0.25, 0.5])
    assert got == ({"x": [float(q) for q in np.percentile(range(n), [25, 50])]} if n else {})
    assert O.distinct_counts(df, ["x"]).first()[0] == n
    assert O.modes(df, ["x"])["x"] == ("0.0" if n else None)


def test_modes_of_many_columns_in_one_pass(spark):
    rows = [(10, 2.0, "b", True, None), (9, -0.0, "a", None, None), (10, 0.0, "b", False, None), (9, 2.0, "a", False, None), (None, None, None, True, None)]
    df = spark.createDataFrame(rows, "i long, x double, s string, b boolean, n string").repartition(3)
    assert O.modes(df, df.columns) == {"i": "9", "x": "0.0", "s": "a", "b": "false", "n": None}
    wide = df.select(*[F.col("i").alias(f"c{k}") for k in range(40)])
    assert O.modes(wide, wide.columns) == {f"c{k}": "9" for k in range(40)}
    assert O.modes(df.limit(0), df.columns) == dict.fromkeys(df.columns) and O.modes(df, []) == {}
