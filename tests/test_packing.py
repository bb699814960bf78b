"""Greedy bins over ranges, against a fold row by row."""

import random

import pytest
from pyspark.sql import functions as F

from loamwork.operators import documents, packing


def folded(rows, limit):
    """{(group, order): bin} of (group, order, size) rows."""
    out, state = {}, {}
    for g, o, n in sorted(rows, key=lambda r: r[1]):
        b, used = state.get(g, (0, None))
        if used is not None and used + n > limit:
            b, used = b + 1, 0
        state[g] = (b, (used or 0) + n)
        out[g, o] = b
    return out


@pytest.mark.parametrize("seed", range(6))
def test_bins_of_ranges_are_those_of_a_fold(spark, seed):
    r = random.Random(seed)
    limit, n = r.choice([1, 10, 100, 1000]), 1500
    # one group of a third of the rows and more, many of few rows, and the null group
    names = ["hot", None, *[f"g{i}" for i in range(30)]]
    size = r.choice([lambda: r.randint(0, 30), lambda: r.choice([0, 0, 0, limit, limit + 1]), lambda: 0, lambda: r.randint(0, 3)])
    rows = [(names[0] if i % 3 else r.choice(names), i, size()) for i in range(n)]
    d = spark.createDataFrame(rows, "g string, o long, n long").repartition(5)
    got = packing.greedy_bins(d, ["g"], ["o"], "n", limit, range_rows=100)
    assert got.columns == ["g", "o", "n", "bin"]
    assert {(x.g, x.o): x.bin for x in got.collect()} == folded(rows, limit)


def test_one_group_over_many_ranges(spark):
    rows = [(0, i, (i * 7919) % 97) for i in range(4000)]
    d = spark.createDataFrame(rows, "g long, o long, n int")
    want = folded(rows, 250)
    assert {(0, x.o): x.bin for x in packing.greedy_bins(d.drop("g"), [], ["o"], "n", 250, range_rows=60).collect()} == want
    # the limit holds several ranges
    wide = packing.greedy_bins(d.drop("g"), [], ["o"], "n", 30000, range_rows=60)
    assert {(0, x.o): x.bin for x in wide.collect()} == folded(rows, 30000)


def test_bounds_meet():
    import numpy as np

    total = np.cumsum(np.random.default_rng(1).integers(1, 50, 20000))
    bounds, more, used = packing.bounds_of(total, packing.next_starts(total, np.array([0]), 5000), 5000)
    # about 200 sizes fit within the limit, and their chains meet
    assert bounds == sorted(bounds) and len(bounds) == len(more) == len(used) < 50


def test_no_rows_no_bins(spark):
    d = spark.createDataFrame([], "g string, o long, n long")
    assert packing.greedy_bins(d, ["g"], ["o"], "n", 10).count() == 0
    assert documents.pack_documents(spark.createDataFrame([], "g string, i long, text string"), ["g"], "i").count() == 0


def test_ties_nulls_and_repeated_documents_are_packed_once_each(spark):
    rows = [("g", 1, "a" * 40)] * 5 + [("g", 1, "b" * 40), ("g", None, "c" * 8), (None, 2, None), (None, 2, ""), (None, None, "d" * 400), ("h", 0, "")]
    d = spark.createDataFrame(rows, "g string, i long, text string").repartition(3)
    out = {(r.g, r.bin): r for r in documents.pack_documents(d, ["g"], "i", 20).collect()}
    assert sum(r.n_docs for r in out.values()) == len(rows)
    # 2 tokens, then six documents of 10
    assert [(k, out["g", k].n_docs, out["g", k].tokens) for k in range(4)] == [(0, 2, 12), (1, 2, 20), (2, 2, 20), (3, 1, 10)]
    assert sum(out["g", k].content.count("a" * 40) for k in range(4)) == 5
    assert (out[None, 0].n_docs, out[None, 0].tokens, out[None, 1].n_docs) == (1, 100, 2)
    assert out[None, 1].content == "\n\n--- Document: 2 ---\n\n" * 2
    assert len(out) == 7


def test_a_document_without_an_order_is_kept(spark):
    d = spark.createDataFrame([("g", None, "text"), ("g", 3, "more")], "g string, i long, text string")
    (r,) = documents.pack_documents(d, ["g"], "i").collect()
    assert r.n_docs == 2 and r.content.endswith("--- Document: 3 ---\n\nmore")
    assert "text" in r.content
