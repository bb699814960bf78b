"""Very long texts: pieces give what the whole gives, and memory stays a small multiple of the text."""

import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from loamwork.llm import bytesops as B
from loamwork.llm import near_copies, quality_crf, simhash, token_file
from loamwork.llm import repeats as R
from loamwork.llm.substring_dedup import Words
from loamwork.llm.suffix_dedup import Bytes

from .test_filters import base

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def long_text(n=1_500_000, seed=3):
    r = random.Random(seed)
    out, size = [], 0
    while size < n:
        w = r.choice(["alpha", "Beta", "gämma", "a#b", "line\nbreak", "x" * r.randrange(1, 30), "the", "of", "\t", str(r.randrange(10**6))])
        out.append(w)
        size += len(w.encode()) + 1
    return " ".join(out) + "y" * 700_000 + " end of it " + " ".join(out[:400])


def test_pieces_cover_every_window_once():
    raw = np.frombuffer(long_text().encode(), np.uint8)
    for t in (Bytes(100, 32), Words(20, 8)):
        starts, ends, _ = t.split(raw, np.array([0, len(raw)]))
        at, windows = 0, 0
        for lo, hi, before in t.pieces(raw):
            s, e, bounds = t.split(raw[lo:hi], np.array([0, hi - lo]))
            assert before == at and (s + lo == starts[at : at + len(s)]).all() and (e + lo == ends[at : at + len(e)]).all()
            at += len(s) - t.length + 1
            windows += max(len(s) - t.length + 1, 0)
        assert windows == len(starts) - t.length + 1


def test_hashes_and_sums_by_pieces():
    raw = np.frombuffer(long_text().encode(), np.uint8)
    s, e, _ = B.word_spans(raw, np.array([0, len(raw)]))
    for lo in (0, len(s) // 2):  # the same span has the same hash wherever it stands
        piece = raw[s[lo] : e[-1]]
        assert (B.span_hashes(raw, s, e)[lo:] == B.span_hashes(piece, s[lo:] - s[lo], e[lo:] - s[lo])).all()
    by_word = {}
    for h, x, y in zip(B.span_hashes(raw, s, e).tolist(), s.tolist(), e.tolist(), strict=True):
        assert by_word.setdefault(raw[x:y].tobytes(), h) == h
    assert len(set(by_word.values())) == len(by_word)
    mask = raw == 97
    total = np.append(0, np.cumsum(mask))
    assert (B.span_sums(mask, s, e) == total[e] - total[s]).all()
    assert B.span_sums(mask, np.array([0, 5, 5]), np.array([5, 5, len(raw)])).tolist() == [total[5], 0, total[-1] - total[5]]


def test_long_texts_against_brute_force(monkeypatch):
    text = long_text()
    raw, offs = B.buffer_of(pa.array([text]))
    counts, failed, _ = quality_crf.verdicts(pa.array([text]), quality_crf.Field(), 0.35, 50)
    assert (*(int(counts[k][0]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), bool(failed[0])) == base(text)
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "LONG", 50_000)
    assert simhash.fingerprint(text.encode()) == whole
    for t in ("", " ", "a b", "a b c d", "a b c d e " * 3):
        monkeypatch.setattr(simhash, "LONG", 1 << 20)
        want = simhash.fingerprint(t.encode())
        monkeypatch.setattr(simhash, "LONG", 1)
        assert simhash.fingerprint(t.encode()) == want
    e = token_file.Encoder(token_file.TOKENIZER)
    monkeypatch.setattr(token_file, "TEXT_SLAB", 30_000)
    assert e.long(text[:400_000].encode()) == e.of([text[:400_000].encode()])[0]


@pytest.mark.parametrize("what", ["op2", "op3", "op4", "op6", "op7", "op10", "near"])
def test_memory_of_a_text_of_64_megabytes(what):
    code = f"""
import resource, numpy as np, pyarrow as pa
from loamwork.llm import bytesops as B, repeats as R, quality_crf, simhash, token_file, fm_index, near_copies
from loamwork.llm.suffix_dedup import Bytes
from loamwork.llm.substring_dedup import Words
r = np.random.default_rng(1)
words = np.array([f"word{{i}}" + (chr(10) if i % 9 == 0 else "") for i in range(5000)])
text = " ".join(words[r.integers(0, 5000, 7_400_000)].tolist())[: 64 << 20]
col, ids = pa.array([text], pa.large_string()), pa.array([1], pa.int64())
del text
what = {what!r}
if what == "op7": token_file.Encoder(token_file.TOKENIZER)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rb = pa.RecordBatch.from_arrays([ids, col], names=["rid", "text"])
n = 0
if what in ("op2", "op3"):
    t = Bytes(100, 32) if what == "op2" else Words(20, 8)
    n = sum(x.num_rows for x in R.segment_rows(t)([rb]))
elif what == "op4": n = int(quality_crf.verdicts(col, quality_crf.Field(), 0.35, 50)[0]["n_words"][0])
elif what == "op6": n = simhash.fingerprint(B.buffer_of(col)[0].tobytes())
elif what == "op7": n = sum(len(x) for _, ts in token_file.token_batches([rb], token_file.TOKENIZER, 1) for x in ts)
elif what == "op10": n = len(fm_index.shard_hits(fm_index.Phrases([("a", "word1 word2 word3")]), *B.buffer_of(col))[0])
else: n = sum(x.num_rows for x in near_copies._per_slab(5, near_copies._signed)([rb]))
assert n
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 / 64)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, env=os.environ | {"PYTHONPATH": REPO, "OMP_NUM_THREADS": "1"}, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert float(out.stdout) < 16, out.stdout
