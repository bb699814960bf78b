import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loamwork.llm import spelling

from .helpers import odd_documents

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    form, out = {}, {}
    for w in n:
        close = [v for v in n if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = (n[w], len(close), n[form[w]] if form[w] else None)
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        out[w] = (form[w], r, *out[w])
    return out


def got(docs, **kw):
    rows = spelling.variants(docs, **kw).collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def variant_rows():
    words = ["kaleidoscope", "kaleidoscopes", "kaleidescope", "Kaleidoscop", "aleidoscope", "naïveté" + "s", "naivetés", "übergröße", "ubergröße", "colours", "colorss", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa"]
    rows = []
    for k, w in enumerate(words):
        for j in range(2 + 41 * (k % 3 == 0) + 500 * (k == 1)):
            rows.append((j % 17, f"{w} und {w.upper()}"))
    long = "q" * 3000
    return rows + odd_documents() + [(None, "Kaleidoscope kaleidoscopeé ÷×ßàÿ" * 3), (None, None), (5, "x" * 7 + " " + "X" * 7), (90, f"{long} {long}"), (91, f"{long}z {long}z"), (92, "KelvinKKelvin KelvinKelvin kelvinkelvin İstanbul")]


@pytest.mark.parametrize("symbols", [None, 2, 9])
def test_against_brute_force(spark, symbols):
    rows = variant_rows()
    docs = spark.createDataFrame([(t, i, "other", 1) for i, t in rows], "text string, doc_id long, word string, n int").repartition(5)
    want = brute(rows)
    assert got(docs, symbols=symbols) == want
    assert {k for k, v in want.items() if v[0] and v[1] != v[0]}  # a chain of two forms is among them


def test_slabs_and_full_tables(spark, monkeypatch):
    rows = variant_rows()
    monkeypatch.setattr(spelling, "HELD", 10)
    monkeypatch.setattr(spelling, "PIECE", 7)
    held = Counter()
    for rb in spelling.vocabulary(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        held[rb.word] += rb.n
    assert held == {w: v[2] for w, v in brute(rows).items()}


def test_empty(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == {}
    assert got(spark.createDataFrame([(1, None), (2, "short words"), (None, "")], "doc_id long, text string")) == {}


def reduced_near(x, k):
    """The full one-edit neighbourhood of a reduced word, itself included."""
    return {x[:i] + x[i + 1 :] for i in range(len(x))} | {x[:i] + (c,) + x[i + 1 :] for i in range(len(x)) for c in range(1, k + 1)} | {x[:i] + (c,) + x[i:] for i in range(len(x) + 1) for c in range(1, k + 1)} | {x}


@pytest.mark.parametrize("piece", [3, 100])
def test_both_words_together_make_the_full_neighbourhood(piece):
    k, r = 3, random.Random(5)
    words = sorted({"".join(r.choice("abcdxyzé") for _ in range(r.randrange(1, 7))) for _ in range(400)} | {"aaaaaa", "aaaaaaa"})
    low = {w: tuple(spelling.reduced([w], k)[0].tolist()) for w in words}
    own, made = {}, {}
    for w in words:
        x = spelling.Reduced(spelling.reduced([w], k))
        own[w] = int(x.own()[0])
        found = [h for lo in range(0, x.n, piece) for h, _ in x.near(lo, min(lo + piece, x.n), k)]
        found = np.concatenate(found).tolist()
        assert len(set(found)) == len(found) <= (k + 1) * x.n
        made[w] = {own[w], *found}
    for u in words:
        full = reduced_near(low[u], k)
        for v in words:
            assert (own[v] in made[u] or own[u] in made[v]) == (low[v] in full)


def test_symbols_follow_the_vocabulary():
    assert [spelling.symbols_for(n) for n in (0, 1000, 100_000, 10**7)] == [4, 4, 6, 10]
