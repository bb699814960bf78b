import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamwork.llm import crc, importance

from .helpers import odd_documents, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n=2):
    w = WORD.findall((text or "").translate(LOW))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, items, buckets=10_000):
    hist = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t)[1])
    s, t = hist(x for _, x in docs), hist(x for _, x in items)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        n, f = features(x)
        weight = sum(gain[zlib.crc32(y.encode()) % buckets] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((n, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fits = sorted((r for r in out if r[0] >= 20), key=lambda r: (-r[4], r[1] is not None, r[1] or 0))
    place = {id(r): k for k, r in enumerate(fits[: 25 * len(fits) // 100], 1)}
    return sorted(((*r[1:], place.get(id(r))) for r in out), key=str)


ITEMS = [("a", " ".join(words(60, 9))), ("b", None), ("c", "ÉCOLE École x-y 9z"), ("d", " ".join(words(40, 1)))]


def rows():
    return [*odd_documents(), *[(100 + k, " ".join(words(15 + k, k % 12))) for k in range(60)], (None, " ".join(words(50, 4))), (300, "A-B c_d É" * 30), (301, "ｗｉｄｅ 日本 " * 15)]


def frame(spark, data):
    return spark.createDataFrame([(t, i, 1, "s") for i, t in data], "text string, doc_id long, rank int, weight string").repartition(5)


def test_against_brute_force(spark):
    got = importance.ranked(frame(spark, rows()), spark.createDataFrame(ITEMS, "item_id string, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows(), ITEMS)
    ranks = sorted(r.rank for r in got if r.rank)
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_null_and_repeated_ids(spark):
    data = [(i, " ".join(words(30 + k, k))) for k, i in enumerate([1, 1, None, None, 2, 2, 2, 3])]
    data += [data[0], data[2]]
    got = importance.ranked(frame(spark, data), spark.createDataFrame(ITEMS, "item_id string, text string")).collect()
    want = brute(data, ITEMS)
    assert sorted(tuple(r)[:4] for r in got) == sorted(r[:4] for r in want) if all(r.doc_id for r in got) else Counter(tuple(r)[:4] for r in got) == Counter(r[:4] for r in want)
    assert sorted(r.rank for r in got if r.rank) == [1, 2]


def test_drawn_rows_keep_their_columns(spark):
    docs = frame(spark, rows())
    target = spark.createDataFrame(ITEMS, "item_id string, text string")
    drawn = importance.resample(docs, target)
    assert drawn.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in drawn.collect()) == sorted(r[0] or -1 for r in brute(rows(), ITEMS) if r[-1])


def test_empty_tables(spark):
    none, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id string, text string")
    assert importance.ranked(none, target).collect() == []
    got = importance.ranked(frame(spark, rows()), spark.createDataFrame([], "item_id string, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows(), [])
    got = importance.ranked(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), target).collect()
    assert all(r.weight == 0 and r.rank is None and r.n_features == 0 for r in got)


def test_pieces(spark, monkeypatch):
    text = (" ".join(words(400, 5)) + " É" + "y" * 300 + "-") * 3
    raw = np.frombuffer(text.translate(LOW).encode(), np.uint8)
    split = importance.splitter()
    whole = importance.word_offsets(raw, split)
    monkeypatch.setattr(importance, "PIECE", 100)
    pieces = importance.word_offsets(raw, split)
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True))
    assert [raw[s:e].tobytes().decode() for s, e in zip(*whole, strict=True)] == WORD.findall(text.translate(LOW))


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_features_of_many_rows(n):
    texts = [t or "" for _, t in odd_documents()] + ["a", "", "b c", "z" * 200 + " " + "é" * 70 + " x"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    n_words, many, flat, times, at = importance.features_of(raw, offs, n, 777, importance.splitter())
    for i, t in enumerate(texts):
        w, f = features(t, n)
        assert (n_words[i], many[i]) == (w, len(f))
        assert dict(zip(flat[at[i] : at[i + 1]].tolist(), times[at[i] : at[i + 1]].tolist(), strict=True)) == Counter(zlib.crc32(x.encode()) % 777 for x in f)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=90), min_size=1, max_size=20))
def test_crc_of_spans_and_of_joined_spans(parts):
    raw = np.frombuffer(b"".join(parts), np.uint8)
    e = np.cumsum([len(p) for p in parts])
    s = e - [len(p) for p in parts]
    c = crc.of_spans(raw, s, e)
    assert c.tolist() == [zlib.crc32(p) for p in parts]
    assert crc.with_space(c).tolist() == [zlib.crc32(p + b" ") for p in parts]
    assert crc.joined(c[:-1], c[1:], raw, s[1:], e[1:]).tolist() == [zlib.crc32(a + b) for a, b in zip(parts, parts[1:])]


def test_share_of_target_text_rises(spark):
    """Documents of the target's words are drawn more often than others."""
    docs = [(i, " ".join(words(60, i, 300) if i % 2 else [w.upper() + "q" for w in words(60, i, 300)])) for i in range(400)]
    got = importance.ranked(frame(spark, docs), spark.createDataFrame([("t", " ".join(words(3000, 999, 300)))], "item_id string, text string")).collect()
    drawn = [r.doc_id % 2 for r in got if r.rank]
    assert len(drawn) == 100 and sum(drawn) > 75
