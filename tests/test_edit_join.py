import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamwork.operators import edit_join, joins


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def edited(s, n, r):
    for _ in range(n):
        i = r.randrange(len(s) + 1)
        s = r.choice([s[:i] + s[i + 1 :], s[:i] + r.choice("abcé") + s[i + 1 :], s[:i] + r.choice("abcé") + s[i:]])
    return s


def strings(seed=1):
    r = random.Random(seed)
    base = ["".join(r.choice("abcé") for _ in range(r.randrange(0, 14))) for _ in range(60)]
    stem = ["commonprefix" + "".join(r.choice("ab") for _ in range(6)) + "commonsuffix" for _ in range(40)]
    return sorted({edited(s, r.randrange(4), r) for s in base * 2 + stem * 2} | {"", "a", "é", "ab", "ba", "abc"})


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
@pytest.mark.parametrize("long_list", [2, 10_000])
def test_pairs_against_trying_all(spark, edits, long_list):
    texts = strings()
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts[::3])] + [(5000, None)]
    got = edit_join.edit_pairs(spark.createDataFrame(rows, "id long, s string").repartition(5), "id", "s", edits, long_list).collect()
    want = {(i, j): d for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and (d := distance(a, b)) <= edits}
    assert {(r.id_a, r.id_b): r.edits for r in got} == want and len(got) == len(want)
    assert all(r.n_a == 1 + (r.id_a % 3 == 0) and r.n_b == 1 + (r.id_b % 3 == 0) for r in got)


@pytest.mark.parametrize("long_list", [2, 10_000])
def test_two_tables(spark, long_list):
    a, b = strings(2), strings(3)[::2] + ["", "x", "yy"]
    left, right = spark.createDataFrame([(t,) for t in a + a[:9]], "s string"), spark.createDataFrame([(t, 1) for t in b] + [(None, 1)], "t string, s int")
    got = edit_join.edit_join(left, right, "s", "t", 2, long_list).collect()
    want = {(x, y, d) for x in a for y in b if (d := distance(x, y)) <= 2}
    assert sorted(map(tuple, got)) == sorted(want)


def test_links_of_rows(spark):
    rows = [(1, "kitten"), (2, "kitten"), (3, "mitten"), (4, "sitting"), (5, None), (6, "x")]
    got = edit_join.edit_links(spark.createDataFrame(rows, "id long, name string"), "id", "name", 2)
    assert got.columns == ["id", "name", "class_id", "n_links"]
    assert {r.id: (r.class_id, r.n_links) for r in got.collect()} == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (4, 0), 5: (None, None), 6: (6, 0)}
    assert edit_join.edit_links(spark.createDataFrame([], "id long, name string"), "id", "name").collect() == []


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("ab", max_size=9), min_size=2, max_size=25, unique=True), st.integers(1, 3))
def test_any_strings(spark, texts, edits):
    got = edit_join.edit_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, s string"), "id", "s", edits, 1).collect()
    assert {(r.id_a, r.id_b) for r in got} == {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and distance(a, b) <= edits}


def test_blocked_join(spark):
    left = spark.createDataFrame([(1, "k", "abcd"), (2, "k", "xxxx"), (3, "m", "abcd"), (4, "k", None)], "id long, b string, s string")
    right = left.select(F.col("id").alias("id2"), F.col("b").alias("b2"), F.col("s").alias("s2"))
    got = joins.fuzzy_join(left, right, "s", "s2", ("b", "b2"), 0.7)
    assert sorted((r.id, r.id2, r.similarity) for r in got.collect()) == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)]


def test_lists_are_split_to_the_end(spark, monkeypatch):
    """Strings that share all but their last code points aren't all set beside each other."""
    r = random.Random(5)
    texts = sorted({"https://www.example.org/a/rather/long/common/path/to/a/page/of/one/site/" + "".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(150)})
    texts += [t[:-1] + "xy" for t in texts[:5]]
    met, verified = [], edit_join._verified
    monkeypatch.setattr(edit_join, "_verified", lambda i, p, *a: met.append(i.select("key").join(p.select("key"), "key").count()) or verified(i, p, *a))
    got = edit_join.edit_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, s string").repartition(4), "id", "s", 2, 8).collect()
    assert {(x.id_a, x.id_b): x.edits for x in got} == {(i, j): d for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and (d := distance(a[60:], b[60:])) <= 2}
    assert max(met) < len(texts) ** 2 / 4
