import datetime as dt

import pytest
from pyspark.sql import functions as F

from loamwork.functions import text as X
from loamwork.operators import assembly, checks, cleaning, documents, fusion, joins, ordering, pii_masking, profile, task_checks, transforms
from loamwork.plans import pipeline


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


@pytest.fixture(scope="module")
def customers(spark):
    data = [
        ("CUST001", "john@example.com", "555-123-4567", 100.0, "2024-01-01", "active"),
        ("CUST002", "jane@example.com", "555-987-6543", 200.0, "01/02/2024", "active"),
        ("CUST003", None, "555-111-2222", float("nan"), "2024-01-03", "Active"),
        ("CUST001", "john@example.com", "555-123-4567", 100.0, "2024-01-01", "inactive"),
        (None, "not mail", None, 10000.0, None, " active"),
        ("BAD", "x@y.org", "1", -5.0, "soon", None),
    ]
    return spark.createDataFrame(data, "customer_id string, email string, phone string, amount double, date string, status string")


def test_missing_counts_nan_and_null(customers):
    got = {r.column_name: (r.severity, r.n_affected) for r in checks.check_missing(customers).collect()}
    assert got == {"customer_id": ("medium", 1), "email": ("medium", 1), "phone": ("medium", 1), "amount": ("medium", 1), "date": ("medium", 1), "status": ("medium", 1)}


def test_identifiers_and_rules(customers):
    got = {r.column_name: r.n_affected for r in checks.check_identifiers(customers.select("customer_id")).collect()}
    assert got == {"customer_id": 1}
    rules = [{"type": "range", "column": "amount", "min": 0, "max": 1000}, {"type": "regex", "column": "customer_id", "pattern": "CUST[0-9]{3}$"}]
    got = {r.column_name: r.n_affected for r in checks.check_rules(customers, rules).collect()}
    assert got["customer_id"] == 2 and got["amount"] >= 2


def test_formats(customers):
    got = {(r.column_name, r.severity) for r in checks.check_formats(customers).collect()}
    assert ("date", "medium") in got and ("status", "low") in got and ("status", "medium") in got


def test_poor_score_by_the_formula(spark):
    poor = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (2.0, None), (None, None), (None, 1000.0)], "id double, value double")
    found = checks.check_missing(poor).unionByName(checks.check_duplicates(poor)).unionByName(checks.check_identifiers(poor))
    assert rows(checks.overall_score(poor, found), "overall_score")[0][0] == pytest.approx(52.0)
    assert not checks.gate(checks.overall_score(poor, found)).first().passed


def test_clean_table_scores_high(spark):
    d = spark.range(100).select(F.col("id"), (F.col("id") % 7 + 50).cast("double").alias("value"))
    assert checks.overall_score(d, checks.validate(d)).first().overall_score > 90


def test_schema_types(spark):
    d = spark.createDataFrame([(1, "x", dt.date(2024, 1, 1), [1], {"a": 1})], "a int, b string, c date, d array<int>, e map<string,int>")
    ok = {"a": "integer", "b": "string", "c": "datetime", "d": "array", "e": "object"}
    assert checks.check_schema(d, list(ok), ok).count() == 0
    assert checks.check_schema(d, ["z"], {"a": "float"}).count() == 2


def test_type_histogram(spark):
    d = spark.createDataFrame([(1, 2, "x")], "a int, b int, c string")
    assert {r.dtype: r.n for r in profile.type_histogram(d).collect()} == {"int": 2, "string": 1}


def test_drift_and_encoding(spark):
    a, b = spark.range(1000).withColumnRenamed("id", "x"), spark.range(500, 1500).withColumnRenamed("id", "x")
    assert checks.drift(a, a, "x").first().psi == pytest.approx(0)
    assert checks.drift(b, a, "x").first().psi > 0.5
    assert checks.check_encoding(spark.createDataFrame([("a�b",), ("c",)], "t string")).first().n_affected == 1


def test_pii_masks(spark):
    d = spark.createDataFrame([("mail a@b.com now",), ("ab",), (None,), ("123-45-6789 and a@b.com",)], "t string")
    masked = [r.t for r in pii_masking.mask(d).collect()]
    assert masked[0] == "m" + "*" * 14 + "w" and masked[1:3] == ["ab", None]
    assert [r.t for r in pii_masking.redact(d).collect()][3] == "XXX-XX-XXXX and ****@****.***"
    once = pii_masking.redact(d)
    assert rows(pii_masking.redact(once)) == rows(once)
    assert [r.t_has_pii for r in pii_masking.flag(d).collect()] == [True, False, False, True]
    assert [r.t for r in pii_masking.blank(d).collect()] == ["", "ab", None, ""]
    assert pii_masking.drop_columns(d).columns == []


def test_title_case_like_scripts(spark):
    texts = ["hello-world", "it's ÉCOLE 3rd", "", "ñandú x2y"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select(X.title(F.col("t")))
    assert [r[0] for r in d.collect()] == [t.title() for t in texts]


def test_strip_and_names(spark):
    d = spark.createDataFrame([("  a b\t ",), (None,)], "t string").select(X.strip(F.col("t")))
    assert [r[0] for r in d.collect()] == ["a b", None]
    assert X.clean_names(["A b", "a_b", "a-b", "", "__"]) == ["a_b", "a_b_1", "a_b_2", "column", "column_1"]


def test_cleaning(spark):
    d = spark.createDataFrame([(1.0, "a "), (None, None), (3.0, "a "), (3.0, "a ")], "x double, t string")
    got = rows(cleaning.fill_missing(cleaning.strip_whitespace(cleaning.remove_duplicates(d))).orderBy("x", "t"))
    assert got == [(1.0, "a"), (2.0, "a"), (3.0, "a")]
    assert cleaning.fill_missing(d, "task").filter("x IS NULL OR t IS NULL").count() == 0
    assert cleaning.table_cleanup(spark.createDataFrame([("1 ", "x", None), ("2", "y", None), (None, None, None)], "a string, b string, c string")).dtypes == [("a", "double"), ("b", "string")]


def test_outlier_actions(spark):
    d = spark.createDataFrame([(float(x),) for x in [1, 2, 2, 3, 3, 3, 4, 4, 5, 1000]] + [(None,)], "x double")
    assert cleaning.outliers(d, ["x"], "iqr", "remove", 3.0).count() == 10
    assert cleaning.outliers(d, ["x"], "iqr", "cap", 3.0).agg(F.max("x")).first()[0] < 20
    assert cleaning.outliers(d, ["x"], "iqr", "flag", 3.0).filter("is_outlier").count() == 1
    assert cleaning.remove_outliers(d, ["x"], 2.0, "sequential").count() == 10


def test_transforms(spark):
    d = spark.createDataFrame([(1, "1", None, float("inf")), (2, "x", None, 1.0)], "a int, b string, c string, e double")
    assert dict(transforms.cast(d, {"a": "string", "b": "int"}).dtypes)["b"] == "string"
    assert transforms.drop_empty_columns(d).columns == ["a", "b", "e"]
    assert transforms.remove_infinite(d).count() == 1
    with pytest.raises(ValueError):
        transforms.select(d, ["zz"])
    assert transforms.filter_rows(d, "(a > 1) | b == '1'").count() == 2
    assert transforms.add_constants(d, {"k": "v"}).columns[-1] == "k"
    t = spark.createDataFrame([(None, "short"), ("y" * 60, "z")], "content string, text string")
    assert transforms.long_texts(t).count() == 1


def test_explode_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    chunks = spark.createDataFrame([(1, 0, "a1"), (1, 1, "a2")], "doc_id long, chunk_index long, content string")
    got = transforms.explode_documents(docs, chunks, spark.createDataFrame([(1, "cell")], "doc_id long, content string"))
    assert sorted(r.type for r in got.collect()) == ["chunk", "chunk", "full", "table"]


def test_chunks_rejoin_to_the_source(spark):
    text = "\n\n".join("p" * (4 * n) for n in (3, 9, 2, 50, 1, 1, 1))
    d = spark.createDataFrame([(1, text), (2, "tiny"), (3, None)], "doc_id long, text string")
    got = documents.chunk_documents(d, 10).orderBy("doc_id", "chunk_index").collect()
    one = [r for r in got if r.doc_id == 1]
    assert "\n\n".join(r.content for r in one) == text
    assert [r.tokens for r in one] == [3, 9, 2, 50, 3] or all(r.tokens <= 10 or "\n\n" not in r.content for r in one)
    assert {r.total_chunks for r in one} == {len(one)} and len(got) == len(one) + 2


def test_packing_never_exceeds_but_alone(spark):
    d = spark.createDataFrame([("g", i, "x" * (4 * n)) for i, n in enumerate((5, 5, 5, 30, 1, 9))], "g string, i long, text string")
    got = documents.pack_documents(d, ["g"], "i", 10).orderBy("bin").collect()
    assert [(r.n_docs, r.tokens) for r in got] == [(2, 10), (1, 5), (1, 30), (2, 10)]


def test_row_targets(spark):
    chars = [0, 2000, 2001, 5001, 10001, 10**7]
    d = spark.createDataFrame([(c,) for c in chars], "c long")
    got = [r[0] for r in d.select(documents.rows_from_chars(F.col("c"), F.lit("qa_pairs"))).collect()]
    assert got == [20, 25, 30, 50, 100, 5000]
    assert [r[0] for r in d.select(documents.rows_from_tokens(F.col("c"), F.lit("ner"))).collect()] == [20, 25, 25, 50, 80, 1000]
    assert [r[0] for r in d.select(documents.generator_rows(F.col("c"))).collect()] == [20, 20, 30, 50, 100, 66666]


def test_parse_typed_rows(spark):
    d = spark.createDataFrame([(1, 'x [{"text": "t", "label": "l"}, {"text": "u", "label": "m"}] y'), (2, "{broken"), (3, None)], "id long, response string")
    got = assembly.parse_responses(d, schema=assembly.SCHEMAS["classification"]).collect()
    assert [(r.id, r.parsed_as, r.text) for r in sorted(got, key=lambda r: (r.id, r.text or ""))] == [(1, "list", "t"), (1, "list", "u"), (2, "raw", None), (3, "raw", None)]


def test_entities_have_exact_offsets(spark):
    d = spark.createDataFrame([(1, "é a@b.co and c@d.co"), (2, "none")], "doc_id long, text string")
    got = rows(assembly.pattern_entities(d, {"email": r"[a-z]+@[a-z.]+"}), "text", "start", "end")
    assert sorted(got) == [("a@b.co", 2, 8), ("c@d.co", 13, 19)]
    good = spark.createDataFrame([("abcd", [("bc", "X", 1, 3)]), ("abcd", [("bc", "X", 0, 2)])], assembly.SCHEMAS["ner"])
    assert assembly.valid_spans(good).count() == 1


def test_split_partitions_keys(spark):
    d = spark.range(5000).withColumnRenamed("id", "k")
    n = {r.split: r["count"] for r in assembly.split(d, ["k"]).groupBy("split").count().collect()}
    assert sum(n.values()) == 5000 and abs(n["train"] - 4000) < 150 and abs(n["val"] - 500) < 100


def test_combine_caps_distinct_rows(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "i long, t string")
    assert rows(assembly.combine([a, a, a.withColumn("i", F.col("i") + 2)], 3, ["i"])) == [(1, "a"), (2, "b"), (3, "a")]


def test_positions_are_dense(spark):
    d = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    got = joins.positioned(d, ["v"], "p").collect()
    assert sorted((r.p, r.v) for r in got) == [(i + 1, i) for i in range(1000)]


def test_align_suffixes_and_fuzzy(spark):
    a, b = spark.createDataFrame([(1, 5), (2, 6)], "id int, v int"), spark.createDataFrame([(1, 7), (3, 8)], "id int, v int")
    assert sorted(joins.align(a, b, "inner", keys=["id"]).columns) == ["id", "v_left", "v_right"]
    x, y = spark.createDataFrame([("kitten",)], "l string"), spark.createDataFrame([("kittens",), ("dog",)], "r string")
    assert [r.r for r in joins.fuzzy_join(x, y, "l", "r", lambda c: F.left(c, F.lit(1)), 0.8).collect()] == ["kittens"]


def test_fusion(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id long, value long")
    u = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c")], "id long, text string")
    assert fusion.early({"tabular": t, "text": u}, ["id"]).columns == ["id", "tabular_value", "text_text"]
    w = fusion.attention({"a": t, "b": t}, {"a": 2.0}, ["id"]).orderBy("id").first()
    assert (w.a_value, w.b_value) == (20.0, 10.0)
    assert fusion.hybrid({"a": t, "b": t, "c": t}, ["id"], [["a", "b"], ["c"]]).count() == 3
    assert fusion.hierarchical({"a": t, "b": t, "c": t}, ["id"], [[["a", "b"]]]).count() == 3
    assert fusion.to_schema(u, {"id": "string", "n": "int"}).dtypes == [("id", "string"), ("n", "int")]
    s = profile.fusion_score([t, t], fusion.early({"a": t, "b": t}, ["id"])).first()
    assert s.completeness == 1.0 and 0 <= s.fusion_score <= 1


def test_task_profiles(customers, spark):
    found, score = task_checks.task_quality(customers)
    assert 0 < score.first().quality_score < 100 and found.count() >= 6
    assert task_checks.basic_check(customers).count() == 6
    two = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "a int, b int")
    assert rows(task_checks.connector_check(two)) == [("warning", "a: more than half missing")]
    d, seen = task_checks.pass_through(two)
    d.collect()
    assert seen.get["n_rows"] == 3
    with pytest.raises(ValueError):
        task_checks.validate_rules(two, [{"type": "not_null", "column": "a"}], fail_on_error=True)


def test_step_lists(spark):
    d = spark.createDataFrame([(1, " a "), (1, " a "), (2, None)], "k int, t string")
    out = pipeline.run([{"name": "c", "type": "data_cleaning"}, {"name": "p", "type": "map_pandas", "config": {"fn": lambda it: (x.assign(k=x.k * 2) for x in it), "schema": "k int, t string"}}], d)
    assert sorted(rows(out["p"])) == [(2, "a"), (4, "")]
    with pytest.raises(ValueError):
        pipeline.run([{"name": "x", "type": "nope"}], d)


def test_ordering(spark):
    d = spark.range(10).withColumnRenamed("id", "v")
    assert ordering.batches(d, 4, ["v"]).agg(F.max("batch_index"), F.max("batch_total")).first() == (2, 3)
    assert ordering.union_all([d, d.withColumn("w", F.lit(1))]).filter("w IS NULL").count() == 10
    assert ordering.first_per_group(d.withColumn("g", F.col("v") % 2), ["g"], [F.desc("v")]).agg(F.sum("v")).first()[0] == 17


def test_document_helpers(spark):
    kv = spark.createDataFrame([(1, 2, {"k": "b"}), (1, 1, {"k": "a", "j": "x"})], "doc long, page long, m map<string,string>")
    assert sorted(rows(documents.merge_key_values(kv, "doc", "page", "m"))) == [(1, "j", ["x"]), (1, "k", ["a", "b"])]
    t = spark.createDataFrame([('{"headers": ["a", "b"], "rows": [["1", "2"], ["3"]]}',)], "j string")
    assert [r.record for r in documents.rows_from_table_json(t, "j").collect()] == [{"a": "1", "b": "2"}, {"a": "3"}]
    c = spark.createDataFrame([("text/csv",), ("application/pdf",)], "file_type string")
    assert documents.recommended_steps(c).count() == 3
    s = spark.createDataFrame([("source", 0), ("transform", 2000), ("model", 100)], "step_type string, n_rows long")
    assert [r.cost for r in documents.step_costs(s).collect()] == [0.06, 0.002, 0.013]
    assert documents.confident(spark.createDataFrame([(0.9,), (0.1,), (None,)], "confidence double")).count() == 2
