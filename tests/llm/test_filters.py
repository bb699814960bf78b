import random
import re
from collections import Counter

from loamwork.llm import fm_index, quality_crf, url_filter
from loamwork.llm.common import few_by_hash

from .helpers import WORD, odd_documents, sha, words


def base(text):
    w = WORD.findall(text or "")
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(rep), failed


def junk(seed, n=80):
    return "\n".join(" | ".join(f"{w}###" for w in words(8, seed * 100 + k)) for k in range(n // 8))


def prose(seed, n=12):
    return "\n".join(" ".join(words(10, seed * 100 + k)).capitalize() + "." for k in range(n))


def test_base_counts_against_brute_force(spark):
    rows = odd_documents() + [(50, "a\na\n\nb #\na\n"), (51, "|" * 200), (52, junk(1)), (None, prose(1)), (52, junk(1))]
    d = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, kept int")
    got = quality_crf.judge(d).collect()
    want = Counter((i, *base(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)


def test_trained_field_tells_prose_from_junk(spark):
    rows = [(i, prose(i) if i % 2 else junk(i)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality_crf.judge(docs, labels).collect()}
    assert all(got[i] == bool(i % 2) for i in range(40, 60))  # none of these was trained on
    assert quality_crf.keep_good(docs, labels).columns == ["doc_id", "text"]


def test_viterbi_against_all_paths():
    import itertools

    import numpy as np

    r = np.random.default_rng(3)
    f = quality_crf.Field(r.normal(size=3), r.normal(size=(2, 2)))
    sizes = [1, 4, 2, 6]
    row = np.repeat(range(4), sizes)
    x = r.normal(size=(len(row), 3))
    got = f.decode(x, row)
    for d, n in enumerate(sizes):
        e = x[row == d] @ f.weights
        best = max(itertools.product((0, 1), repeat=n), key=lambda p: sum(e[i] * p[i] for i in range(n)) + sum(f.moves[p[i], p[i + 1]] for i in range(n - 1)))
        assert tuple(got[row == d]) == best


def test_no_labels_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, prose(1, 20)), (2, junk(2))], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality_crf.judge(docs, none).collect()} == {1: True, 2: False}
    assert quality_crf.judge(docs.limit(0), none).count() == 0


URLS = [
    ("http://Shop.COM/a?b#c", "shop.com", "/a", "com/"),
    ("http://shop.com", "shop.com", "", None),
    ("http://example.com/en/1", "example.com", "/en/1", "example.com/en/"),
    ("https://x.example.com/en/1", "x.example.com", "/en/1", "example.com/en/"),
    ("https://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/"),
    ("https://a.www.example.com/en/1", "a.www.example.com", "/en/1", "www.example.com/en/"),
    ("https://notexample.com/en/1", "notexample.com", "/en/1", "com/"),
    ("http://a.net/es/x", "a.net", "/es/x", "net/es/"),
    ("http://a.net/ES/x", "a.net", "/ES/x", None),
    ("http://a.net/fr", "a.net", "/fr", None),
    ("no scheme", "", "", None),
    (None, "", "", None),
    ("http://a.org?x=://b.com/", "a.org", "", None),
    ("weird\nline://q.com/p", "q.com", "/p", "com/"),
]


def test_url_rules(spark):
    d = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.filter_urls(d).collect()}
    for i, (_, host, path, rule) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        if rule:
            assert got[i].verdict == {"com/": "allow", "www.example.com/en/": "allow"}.get(rule, "block")
    assert {r.verdict for r in got.values()} <= {"allow", "block"}
    assert url_filter.filter_urls(d.limit(0)).count() == 0


def test_url_model_on_held_out_urls(spark):
    r = random.Random(1)
    rows = [(i, f"http://{'casino' if i % 2 else 'library'}{r.randrange(99)}.org/{'win' if i % 2 else 'book'}/{i}") for i in range(400)]
    d = spark.createDataFrame(rows, "page_id long, url string")
    labelled = url_filter.with_rules(d).filter("page_id < 200").selectExpr("host", "path", "page_id % 2 = 1 AS blocked")
    got = url_filter.filter_urls(d, labelled=labelled).filter("page_id >= 200").collect()
    assert sum((x.verdict == "block") == bool(x.page_id % 2) for x in got) >= 195


SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def brute_hits(docs, items):
    out = {}
    for i, t in docs:
        w = SPLIT.findall(lower(t))
        hit, ids = set(), set()
        for item, text in items:
            x = SPLIT.findall(lower(text))
            n = min(13, len(x))
            for j in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[j : j + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(item))
        out[i] = (len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def bench_rows():
    a, b = " ".join(words(30, 5)), " ".join(words(14, 6))
    items = [(1, a), (2, b), (10, "two words"), (3, ""), (4, None), (5, a), (6, "Straße ÉCLAIR x1")]
    docs = odd_documents() + [(200, f"{a.upper()} {b}"), (201, "see two, WORDS! and TWO words"), (202, " ".join(words(500, 9)) + " " + b), (203, "straße Éclair x1; straße ÉCLAIR x1"), (204, a[:80]), (205, (b + " ") * 30)]
    return docs, items


def test_fm_index_against_brute_force(spark):
    docs, items = bench_rows()
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, items int").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(docs, items)
    for size in (8 << 20, 60):  # one block, and several
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in fm_index.contamination(d, b, block_bytes=size).collect()}
        assert got == want
        assert {r.doc_id for r in fm_index.keep_clean(d, b, block_bytes=size).collect()} == {i for i, w in want.items() if not w[4]}


def test_fm_index_empty(spark):
    docs, items = bench_rows()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert fm_index.contamination(d.limit(0), b).count() == 0
    assert not any(r.n_hit for r in fm_index.contamination(d, b.limit(0)).collect())


def test_sample_of_few_repeated_urls_has_both_verdicts(spark):
    """Six different URLs in 200,000 rows: copies take no place in the sample."""
    urls = [f"http://s{i}.com/a" for i in range(5)] + ["http://q.net/es/x"]
    d = spark.range(200_000).selectExpr("id AS page_id", f"element_at(array({', '.join(repr(u) for u in urls)}), CAST(CASE WHEN id % 1000 = 0 THEN 6 ELSE id % 5 + 1 END AS INT)) AS url")
    d = url_filter.with_rules(d)
    few = few_by_hash(d.selectExpr("host", "path", "ruled = 'block' AS blocked"), ["host", "path", "blocked"], 2000, "blocked").collect()
    assert sorted((r.host, r.blocked) for r in few) == [("q.net", True), *((f"s{i}.com", False) for i in range(5))]


def test_sample_is_bounded_and_even(spark):
    d = spark.range(50_000).selectExpr("id AS v", "id % 100 = 0 AS b", "1 AS other")
    few = few_by_hash(d, ["v", "b"], 400, "b").collect()
    assert Counter(r.b for r in few) == {True: 200, False: 200}
    assert few == few_by_hash(d.repartition(7), ["v", "b"], 400, "b").collect()
    assert few_by_hash(d.limit(0), ["v", "b"], 400, "b").count() == 0


def test_documents_of_good_and_bad_halves(spark):
    """Prose and junk in one document: lines get the label of what they are."""
    import numpy as np
    import pyarrow as pa

    rows = [(i, prose(i) if i % 2 else junk(i)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = quality_crf.train_field(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int"))
    right = n = 0
    for i in range(100, 160):
        good, bad = prose(i).split("\n"), junk(i).split("\n")
        lines = good + bad if i % 2 else bad + good
        raw, offs = quality_crf.B.buffer_of(pa.array(["\n".join(lines)]))
        _, row, _, x = quality_crf.measure(raw, offs)
        got = field.decode(x, row)
        want = np.array([line in bad for line in lines])
        right, n = right + int((got == want).sum()), n + len(lines)
    assert right >= 0.98 * n


def test_repeated_ids_train_alike(spark):
    rows = [(i % 7, prose(i) if i % 2 else junk(i)) for i in range(70)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int")
    a, b = (quality_crf.train_field(spark.createDataFrame(r, "doc_id long, text string"), labels) for r in (rows, rows[::-1]))
    assert a.weights.tolist() == b.weights.tolist()


def test_phrases_stay_small(spark):
    """What a block sends to the executors follows its words."""
    import pickle

    items = [(str(i), " ".join(words(200, i, 50_000))) for i in range(500)]
    phrases = fm_index.Phrases(items)
    assert len(pickle.dumps(phrases)) < 40 * 100_000 + 200_000
    assert len(phrases.starts) == 500 * 188
    same = fm_index.Phrases([("b", "x y"), ("a", "x y"), ("b", "x y"), ("c", None)])
    import numpy as np

    assert len(same.starts) == 1 and same.items_of(np.array([0])) == ["a", "b"]


def test_null_and_repeated_ids_stay_apart(spark):
    docs, items = bench_rows()
    a = docs[-2][1]
    rows = [(None, "nothing here"), (None, a), (7, a), (7, "other words"), (7, a)]
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (8 << 20, 60):
        got = fm_index.contamination(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), b, block_bytes=size).collect()
        assert Counter((r.doc_id, r.n_words) for r in got) == Counter((i, len(SPLIT.findall(lower(t)))) for i, t in rows)
