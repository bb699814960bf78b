"""The pipeline on small tables: each stage's decisions against brute force."""

import corpus_pipeline
import pytest

from loamwork.llm import simhash

from .helpers import odd_documents, words
from .test_filters import base, brute_hits, junk, prose
from .test_near_copies import brute_firsts


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in odd_documents()]
    rows += [(100 + i, prose(i, 14), "en", "s0", 1) for i in range(20)] + [(200 + i, junk(i), "en", "s1", 1) for i in range(10)]
    rows += [(300, prose(3, 14), "en", "s0", 1), (301, prose(50, 6) + " " + " ".join(words(20, 77)), "en", "s2", 1), (102, prose(2, 14), "en", None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in [*range(100, 120), *range(200, 210)]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words(20, 77))), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables).persist()
        assert docs.columns == columns
        kept[name] = sorted((r.doc_id, r.text) for r in docs.collect())
    assert not any(base(t)[5] for _, t in kept["quality"])
    assert {i for i, _ in kept["quality"]} >= set(range(100, 120)) and not {i for i, _ in kept["quality"]} & set(range(200, 210))
    # ids may repeat: texts are compared under numbers of their own
    numbered = list(enumerate(t for _, t in kept["quality"]))
    assert len(kept["near_dedup"]) == len(brute_firsts(numbered))
    assert set(kept["near_dedup"]) <= set(kept["quality"])
    hits = brute_hits(list(enumerate(t for _, t in kept["near_dedup"])), [(1, " ".join(words(20, 77)))])
    assert kept["decontaminate"] == [x for k, x in enumerate(kept["near_dedup"]) if not hits[k][4]]
    assert 301 not in {i for i, _ in kept["decontaminate"]}
    assert set(kept["mix"]) <= set(kept["decontaminate"])
    out = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    assert sorted(r.doc_id for r in out) == [i for i, _ in kept["mix"]]
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, tables).collect()) == sorted(tuple(r) for r in out)


def test_shape():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    assert corpus_pipeline.ORACLE_SQL is None and simhash.BITS == 4


def test_columns_with_the_names_used_inside(spark, tables):
    """Columns called like the operators' own come through unchanged, with and without repeated ids."""
    names = ["__rid", "__h", "__n", "__row", "__x", "rid", "h", "first", "__first", "__bad"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for d in (docs, docs.filter("doc_id <> 102")):
        d = d.selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in names])
        for stage in (corpus_pipeline.near_dedup, corpus_pipeline.decontaminate, corpus_pipeline.mix):
            out = stage(spark, d, tables)
            assert out.columns == d.columns
            assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names if r.doc_id is not None)
