import base64
import hashlib
import os
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loamwork.llm import byte_bpe
from loamwork.llm import bytesops as B

from .helpers import odd_documents, sha
from .test_long_texts import REPO, long_text

PATH = public_tokenizers.path(byte_bpe.RANKS)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ours(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return [x for _, ids in byte_bpe.runs(byte_bpe.vocabulary(PATH), raw, np.array([0, len(raw)]), public_tokenizers.PATTERN) for x in ids.tolist()]


def rows():
    return [*odd_documents(), (None, "I'll we've  \n\n x"), (None, "I'll we've  \n\n x"), (2, "<|endoftext|> 12345 ½ ²"), (30, "\x00\x1c\x85  á 😀👩‍👩‍👧 \U0010ffff"), (31, "ab" * 5000), (32, "日本語" * 400 + "नमस्ते ")]


def test_round_trip_against_the_library(spark, library):
    docs = spark.createDataFrame([(t, i, 5, "x") for i, t in rows()], "text string, doc_id long, n_tokens int, ids string").repartition(4)
    got = sorted(byte_bpe.round_trip(docs).collect(), key=str)
    want = []
    for i, t in rows():
        ids = np.array(library.encode_ordinary(t or ""), dtype="<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), sha(t or "")))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_encode_and_decode_are_separate(spark, library):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    coded = byte_bpe.encode(docs)
    assert sorted((r.doc_id or -1, r.ids) for r in coded.collect()) == sorted((i or -1, library.encode_ordinary(t or "")) for i, t in rows())
    assert sorted(bytes(r.bytes) for r in byte_bpe.decode(coded).collect()) == sorted((t or "").encode() for _, t in rows())
    assert [bytes(r.bytes) for r in byte_bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()] == [b""]


def test_empty_and_malformed(spark, library):
    assert byte_bpe.round_trip(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    d = spark.createDataFrame([(1, bytearray(b"ab\xff\xc3 cd"))], "doc_id long, b binary").selectExpr("doc_id", "cast(b AS string) AS text")
    text = b"ab\xff\xc3 cd".decode("utf-8", "replace")
    r = byte_bpe.round_trip(d).first()
    assert (r.n_tokens, r.decoded_sha256) == (len(library.encode_ordinary(text)), sha(text))


def test_every_code_point_as_the_library(library):
    """The pattern's classes are those of another regular-expression library."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 4096):
        text = "".join(f"a{chr(c)}1 {chr(c)}a{chr(c)}{chr(c)}  {chr(c)}!" for c in points[lo : lo + 4096])
        assert ours(text) == library.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abexyz 'stl.\n\t12é😀"), max_size=400))
def test_any_text(text):
    ranks = byte_bpe.vocabulary(PATH).ranks
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert ours(text) == lib.encode_ordinary(text)


def test_pieces_and_small_tables(library, monkeypatch):
    text = long_text(300_000)
    monkeypatch.setattr(byte_bpe, "CHUNK", 1000)
    monkeypatch.setattr(byte_bpe, "CACHE", 50)
    monkeypatch.setattr(byte_bpe, "LONG", 1000)
    assert ours(text[:250_000]) == library.encode_ordinary(text[:250_000])


def test_other_patterns_leave_text_out():
    raw = np.frombuffer(b"ab, cd", np.uint8)
    v = byte_bpe.vocabulary(PATH)
    assert v.decode(np.concatenate([i for _, i in byte_bpe.runs(v, raw, np.array([0, 6]), "[a-z]+")])).tobytes() == b"abcd"


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 60_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    h = byte_bpe.PerfectHash(keys)
    assert np.sort(h.places(keys)).tolist() == list(range(n))
    assert len(h.bits) <= 6 * n + 40
    strange = h.places(np.random.default_rng(n + 1).integers(0, 1 << 63, 500, dtype=np.uint64))
    assert ((strange >= -1) & (strange < n)).all()


def test_equal_hashes_of_different_pre_tokens(library, monkeypatch):
    """Hashes only find candidates: with one hash for all, the bytes still decide."""
    text = "Quixotic brouhaha, quixotic brouhahas qwxyz qwxyz 123456789"
    byte_bpe.vocabulary(PATH)
    monkeypatch.setattr(B, "span_hashes", lambda raw, s, e, which=0: np.zeros(len(s), np.uint64))
    assert ours(text) == library.encode_ordinary(text)


def test_memory_of_a_long_text():
    code = """
import resource, sys, numpy as np, public_tokenizers
from loamwork.llm import byte_bpe
v = byte_bpe.vocabulary(public_tokenizers.path(byte_bpe.RANKS))
words = [f"word{i % 5000} " for i in range(6_000_000)]
raw = np.frombuffer("".join(words).encode(), np.uint8)
del words
import gc; gc.collect()
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(len(x) for _, x in byte_bpe.runs(v, raw, np.array([0, len(raw)]), public_tokenizers.PATTERN))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) * 1024 / len(raw), n)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env={**os.environ, "PYTHONPATH": REPO}, check=True).stdout
    assert float(out.split()[0]) < 16
