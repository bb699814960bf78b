"""Operators that did less than the whole job on long texts or large groups."""

import math

from loamwork.operators import assembly, documents


def test_each_request_has_its_own_window(spark):
    text = "".join(f"{i:06d}" for i in range(20000))
    d = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")
    from pyspark.sql import functions as F

    target = F.floor(2 * F.length("text") / 100) + 1
    rows = assembly.request_plan(d, target, "qa_pairs").orderBy("doc_id", "batch_number").collect()
    got = [r for r in rows if r.doc_id == 1]
    n = math.ceil((2 * len(text) // 100 + 1) / 100)
    size = max(1000, len(text) // n)
    starts = [min(j * size // 2, len(text) - size) for j in range(n)]
    assert [r.content for r in got] == [text[s : s + size][:3000] for s in starts]
    assert len({r.content for r in got}) == n == 25
    assert [r.content for r in rows if r.doc_id == 2] == ["short"]


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_packing_streams_a_group(spark):
    sizes = [(7 * i) % 23 for i in range(3000)]
    d = spark.createDataFrame([("g" if i % 5 else "h", i, "x" * (4 * n)) for i, n in enumerate(sizes)], "g string, i long, text string").repartition(7)
    out = documents.pack_documents(d, ["g"], "i", 40)
    want = {}
    for name, keep in (("g", lambda i: i % 5), ("h", lambda i: not i % 5)):
        b = used = n = 0
        for i in filter(keep, range(3000)):
            if n and used + sizes[i] > 40:
                b, used, n = b + 1, 0, 0
            used, n = used + sizes[i], n + 1
            want[name, b] = (n, used)
    assert {(r.g, r.bin): (r.n_docs, r.tokens) for r in out.collect()} == want
    assert "array_append" not in planned(out)


def test_combined_content_gathers_only_what_shows(spark):
    rows = [("g", i, "" if i % 3 else None) for i in range(2000)] + [("h", 1, "y" * 5000), ("h", 2, "z"), ("k", None, "no order")]
    d = spark.createDataFrame(rows, "g string, i long, text string").repartition(5)
    out = documents.combined_content(d, ["g"], "i")
    full = {"g": "\n\n".join(f"=== {i} ===\n" for i in range(2000)), "h": "=== 1 ===\n" + "y" * 5000, "k": ""}
    assert {r.g: r.content for r in out.collect()} == {k: v[:3000] + "..." * (len(v) > 3000) for k, v in full.items()}
    assert "WindowGroupLimit" in planned(out)
