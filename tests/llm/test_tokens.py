import gc
import tracemalloc
import weakref
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamwork.llm import bytesops as B
from loamwork.llm import simhash
from loamwork.llm import token_file as T

from .helpers import odd_documents


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=700))
def test_round_trip(ids):
    x = np.array(ids, dtype=np.uint64)
    words, offsets = T.encode(x)
    assert (T.decode(words, offsets, len(x)) == x).all()


def test_small_ids_pack_densely():
    words, _ = T.encode(np.zeros(1280, dtype=np.uint64))
    assert len(words) == 10 * 3  # 60 + 60 + 8 a block


ODD = ["", "á b'll don't", "Ⅷ ½ x²", "I'm <|endoftext|> it's<|startoftext|>x", " ab", "\x85a\xa0b　c\x1cd", "ΣΑΣ İ ß ı Ĳĳŉǅ", "日本語 テスト", "a\x00b �", "x́abc ́d", "A1B2 --- __ ..\n\n\t!"]


def test_encoder_equals_the_library():
    e = T.Encoder(T.TOKENIZER)
    texts = ODD + [t or "" for _, t in odd_documents()]
    for t, got in zip(texts, e.of([t.encode() for t in texts])):
        assert got == e.ids(t).tobytes(), t


def test_table_against_brute_force(spark):
    rows = odd_documents() + [(100 + i, t) for i, t in enumerate(ODD)] + [(6, "short text"), (None, "no id")]
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    got = [tuple(r) for r in T.token_table(d).collect()]
    tok = T.Encoder(T.TOKENIZER)
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.append(tok.ids(t or ""), T.END_ID).astype("<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    key = lambda r: (r[1], r[2])
    assert sorted(got, key=key) == want


def test_empty(spark):
    assert T.token_table(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("chunk", [1, 50])
def test_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(T, "CHUNK_IDS", chunk)
    d = spark.createDataFrame(odd_documents(), "doc_id long, text string")
    a = sorted(tuple(r) for r in T.token_table(d).collect())
    assert [r[1] for r in a] == list(np.cumsum([0] + [r[2] for r in a[:-1]]))


ENCODER = T.Encoder(T.TOKENIZER)


def equal_ids(texts):
    e = ENCODER
    for t, got in zip(texts, e.of([t.encode() for t in texts]), strict=True):
        assert got == e.ids(t).tobytes(), ascii(t)


def test_letters_whose_lower_case_leaves_the_range():
    """Capitals of Azerbaijani, Ewe, Akan and Hausa, and their like."""
    equal_ids(["Əliyev", "Ɔkra", "Ɓauchi", "bAƏb", "ƁƆƉƊƏƐƓƔƖƗƜƝƟƦƩƮƱƲƷȺȾɄɅ", "Əliyev bAƏb gecə Ɓauchi"])


def test_every_character_of_the_first_plane():
    marks = [c for c in map(chr, range(0x10000)) if not "\ud800" <= c <= "\udfff"]
    equal_ids([f"Ab{c}De {c} {c}x{c}" for c in marks])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_texts_of_all_planes(texts):
    equal_ids(texts)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aBé Əɔ'sſİıǅßø1_-́K\n"), max_size=60))
def test_texts_of_awkward_letters(text):
    equal_ids([text])


def test_one_tokenizer_serves_words_and_parts():
    """Whole words and parts in turn, against a tokenizer of its own."""
    import public_tokenizers
    from tokenizers import Tokenizer

    own, e = Tokenizer.from_file(public_tokenizers.path(T.TOKENIZER)), T.Encoder(T.TOKENIZER)
    for t in [*ODD, "plain words", "Əliyev", "plainer words 12"] * 2:
        e.known.clear()
        want = np.array(own.encode(t, add_special_tokens=False).ids, dtype="<u4")
        assert e.of([t.encode()]) == [want.tobytes()], t
        assert e.ids(t).tolist() == want.tolist(), t


def test_encoder_goes_when_another_operator_begins(monkeypatch):
    """Workers are kept; with the encoder they held it through all other stages of the pipeline."""
    made = []

    class Known(T.Encoder):
        def __init__(self, name):
            super().__init__(name)
            made.append(weakref.ref(self))

    monkeypatch.setattr(T, "Encoder", Known)
    rb = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words"])], names=["doc_id", "text"])
    monkeypatch.setattr(T, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    for _ in range(2):
        files = list(T._write(T.TOKENIZER, T.END_ID)([rb]))
        assert [b.num_rows for b in files] == [1]
        list(B.tidy(T._read)(iter(files)))
    assert len(made) == 1 and made[0]() is not None
    list(simhash._fingerprints(4, 42)([rb]))
    gc.collect()
    assert made[0]() is None


def test_a_batch_is_copied_by_slabs(monkeypatch):
    monkeypatch.setattr(T, "TEXT_SLAB", 1 << 16)
    rb = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(["some plain words " * 120] * 4000)], names=["doc_id", "text"])
    for _ in T.token_batches([rb.slice(0, 10)], T.TOKENIZER, 1):
        pass
    tracemalloc.start()
    try:
        for _ in T.token_batches([rb], T.TOKENIZER, 1):
            pass
        assert tracemalloc.get_traced_memory()[1] < 4 << 20  # of 8 MB of text
    finally:
        tracemalloc.stop()
