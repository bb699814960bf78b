"""Words that collide under every polynomial hash modulo 2**64 are different words to the operators."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamwork.llm import bytesops as B
from loamwork.llm import fm_index, near_copies, quality_crf

from .helpers import odd_documents
from .test_dedup import check_bytes, check_words, frame
from .test_filters import base


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


A, A2 = thue_morse(1024), thue_morse(1024, "b", "a")


def spans(words):
    raw = np.frombuffer(b"".join(w.encode() for w in words), np.uint8)
    at = np.append(0, np.cumsum([len(w.encode()) for w in words]))
    return raw, at[:-1], at[1:]


def test_hashes_tell_them_apart():
    raw, s, e = spans([A, A2, A])
    assert all((h := B.span_hashes(raw, s, e, k))[0] != h[1] and h[0] == h[2] for k in (0, 1))
    for block in ("abcdefgh", "abcd"):  # the same of blocks of eight and of four letters
        raw, s, e = spans([thue_morse(64, block, block[::-1]), thue_morse(64, block[::-1], block)])
        assert len(set(B.span_hashes(raw, s, e).tolist())) == 2


def test_repeats(spark):
    same = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([*same, A])), (2, " ".join([*same, A2])), (3, " ".join([A2, *same, A2])), (4, " ".join([*same, A])), (5, thue_morse(3000)), (6, thue_morse(3000, "b", "a"))]
    check_words(spark, rows)
    check_bytes(spark, rows)


def test_repeats_of_two_words(spark):
    check_words(spark, [(1, thue_morse(200, "a ", "b ")), (2, thue_morse(200, "b ", "a ")), (3, thue_morse(128, "left ", "right ") + thue_morse(128, "right ", "left "))])


def test_quality_counts(spark):
    text = f"{A}\n{A2}\nx {A} y\nx {A2} y"
    got = quality_crf.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words, got.base_failed) == base(text)
    assert (got.n_dup_lines, got.n_repeat_words) == (0, 0)


def test_benchmark_words(spark):
    docs, items = [(1, A2), (2, A), (3, f"x {A2} y")], [("i", A)]
    got = {r.doc_id: r.n_hit for r in fm_index.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_shingles():
    raw, s, e = spans([f"a b c d {A}", f"a b c d {A2}"])
    h, _ = near_copies.shingles(raw, np.append(s, e[-1]), 5)
    assert len(h) == 2 and h[0] != h[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=300), min_size=1, max_size=30), st.integers(0, 1))
def test_long_words_of_two_letters(words, which):
    raw, s, e = spans(words)
    h = B.span_hashes(raw, s, e, which).tolist()
    for i, w in enumerate(words):
        assert [h[j] == h[i] for j in range(len(words))] == [v == w for v in words]


@pytest.mark.parametrize("cut", range(0, 20))
def test_ends_of_the_buffer(cut):
    raw = np.frombuffer(b"x" * cut + b"word", np.uint8)
    assert B.span_hashes(raw, np.array([cut]), np.array([cut + 4])) == B.span_hashes(np.frombuffer(b"word", np.uint8), np.array([0]), np.array([4]))


def test_odd_documents_still_agree(spark):
    check_words(spark, odd_documents())
