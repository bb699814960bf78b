"""Substring dedup: seed and extend over the words of `documents`.

Seeds are winnowed anchors: in every window of `length` words the `seed`-word gram of least
hash, so two equal windows always share a seed at the same place.  Places meet on their seed
and are extended word by word to the left and to the right, all partners of a seed at once:
places that agreed so far and have the same next word stay in one class, so no pairs are
formed.  Places of one class after l words to the left and of one class after the rest of a
window to the right repeat that window; overlapping or touching windows merge into maximal
repeats.
A word is removed where a repeat also starts earlier (smaller doc_id, or earlier in the
same document).

Nulls, empty texts and texts of fewer words than a window lose nothing.  Null or repeated
doc_ids: see `common.doc_rows`; a repeated row counts as a later copy.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytesops as B
from . import repeats as R
from .common import doc_rows

LENGTH, SEED = 20, 8

OUT = "rid long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"
OUT_PA = pa.schema([("rid", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


class Words(R.Tokens):
    """Every word is a token; windows are told apart by extension from their seed."""

    def __init__(self, length: int, k: int):
        self.length, self.k = length, min(k, length)

    def split(self, raw, offs):
        starts, ends, row = B.word_spans(raw, offs)
        return starts, ends, np.searchsorted(row, np.arange(len(offs)), side="left")

    def pieces(self, raw):
        lo = before = 0
        while lo < len(raw):
            cut = lo + B.SLAB
            while cut < len(raw) and not B.SPACE[raw[cut]]:  # no word is cut
                cut += 1
            cut = min(cut, len(raw))
            room = 32 * self.length
            while True:
                hi = min(cut + room, len(raw))
                while hi < len(raw) and not B.SPACE[raw[hi]]:
                    hi += 1
                more, _, _ = B.word_spans(raw[cut:hi], np.array([0, hi - cut]))
                if hi == len(raw) or len(more) >= self.length - 1:
                    break
                room *= 2
            if len(more) >= self.length:
                hi = cut + int(more[self.length - 1])
            yield lo, hi, before
            before += len(B.word_spans(raw[lo:cut], np.array([0, cut - lo]))[0])
            lo = cut

    def codes(self, raw, starts, ends, which):
        return B.span_hashes(raw, starts, ends, which)

    def halves(self, roll, i, p):
        # the left extension knows its length, and so the seed's place
        left = B.mix(roll.of(i, p) ^ (p - i).astype(np.uint64))
        return left, roll.of(p + self.k, i + self.length)

    def again(self, raw, starts, ends, at, h, left, n):
        word = self.codes(raw, starts, ends, 1)
        p, beyond = at + left, self.length - self.k
        first = np.cumsum(n) - n
        out = np.zeros(int(n.sum()), dtype=bool)
        c = np.cumsum(np.append(0, h[1:] != h[:-1]))
        for x in range(self.k):  # the seed's own words
            c = refined(c, word[p + x])
        room = n - 1 - left + beyond  # words right of the seed
        right = [c]
        for r in range(beyond):
            c = c.copy()
            m = np.flatnonzero(room > r)
            c[m] = refined(c[m], word[p[m] + self.k + r])
            right.append(c)
        c = right[0].copy()
        for l in range(beyond + 1):
            if l:
                m = np.flatnonzero(left >= l)
                c[m] = refined(c[m], word[p[m] - l])
            m = np.flatnonzero((left >= l) & (left - l < n))
            out[first[m] + left[m] - l] = seen_before(c[m], right[beyond - l][m])
        return out


def _by_class(c: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): stable order by (c, x), and where another pair begins in it."""
    order = np.lexsort((x, c))
    new = np.ones(len(c), dtype=bool)
    new[1:] = (np.diff(c[order]) != 0) | (x[order][1:] != x[order][:-1])
    return order, new


def refined(c: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Classes of places that were in one class and have the same next word."""
    order, new = _by_class(c, word)
    out = np.empty(len(c), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def seen_before(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """True where an earlier place has the same classes on both sides."""
    order, new = _by_class(left, right)
    out = np.empty(len(left), dtype=bool)
    out[order] = ~new
    return out


def _cut(length: int):
    @B.tidy
    def run(batches):
        for rb in batches:
            texts = rb.column(1)
            ends, a, b = R.listed(rb.column(2))
            cols = ([], [], [], [])
            for i in range(rb.num_rows):
                words = (texts[i].as_py() or "").encode().split()
                spans = []
                if ends[i] < ends[i + 1]:
                    s, e = R.merged(a[ends[i] : ends[i + 1]], b[ends[i] : ends[i + 1]], length)
                    spans = list(zip(s.tolist(), e.tolist(), strict=True))
                kept, at = [], 0
                for x, y in spans:
                    kept += words[at:x]
                    at = y
                kept += words[at:]
                for c, v in zip(cols, (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"start": x, "end": y} for x, y in spans]), strict=True):
                    c.append(v)
            yield B.batch(OUT_PA, rb.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(OUT_PA)[1:], strict=True)))

    return run


def remove_repeated_passages(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Per document the words left once repeated windows of `length` words are removed."""
    rows, named = doc_rows(docs)
    starts = R.repeated_starts(rows, Words(length, seed))
    return named(R.with_lists(rows, starts, "a", "b").mapInArrow(_cut(length), OUT))
