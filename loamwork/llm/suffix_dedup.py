"""Suffix-array dedup: a depth-limited radix sort of suffixes over `documents`.

Suffixes are compared through `length` bytes only, by passes over digits, most significant
first.  The first digits choose the bucket and are hashed: the window's 32-byte anchor, then
the whole segment of windows that share the anchor.  A bucket that holds one suffix, or none
but copies of one segment, is settled and goes no further.  In the others the suffixes are
sorted by their own bytes: the anchor's place, then eight bytes a pass, where only buckets
with different digits are sorted and suffixes left alone drop out.  The groups still equal
after the last pass are exactly the repeated windows.

Nulls and empty texts have no bytes and lose none.  Null or repeated doc_ids: see
`common.doc_rows`; a repeated row counts as a later copy.  Texts of any length are cut
into pieces within a task; matches never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytesops as B
from . import repeats as R
from .common import doc_rows

LENGTH, DIGIT = 100, 32

OUT = "rid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
OUT_PA = pa.schema([("rid", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


class Bytes(R.Tokens):
    """Every byte is a token; windows are told apart by radix passes over their bytes."""

    def __init__(self, length: int, k: int):
        self.length, self.k = length, min(k, length)

    def split(self, raw, offs):
        at = np.arange(len(raw) + 1, dtype=np.int32 if len(raw) < 1 << 31 else np.int64)
        return at[:-1], at[1:], offs

    def pieces(self, raw):
        for lo in range(0, len(raw), B.SLAB):
            yield lo, min(lo + B.SLAB + self.length - 1, len(raw)), lo

    def codes(self, raw, starts, ends, which):
        return B.CODES[which][raw]

    def halves(self, roll, i, p):
        half = i + self.length // 2
        return roll.of(i, half), roll.of(half, i + self.length)

    def again(self, raw, starts, ends, at, h, left, n):
        which = np.repeat(np.arange(len(h)), n)
        j = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        bucket = np.cumsum(np.append(0, h[1:] != h[:-1]))
        return equal_suffixes(raw, at[which] + j, bucket[which] * self.length + (left[which] - j), self.length)


def digits_of(raw: np.ndarray, width: int) -> np.ndarray:
    """The `width` bytes (8 or 1) from every place on as one number, first byte highest."""
    if width == 1:
        return raw
    padded = np.append(raw, np.zeros(-len(raw) % 8, np.uint8))
    out = np.empty(len(raw) - 7, np.uint64)
    for k in range(8):
        x = padded[k : len(padded) - (8 - k) % 8].view(">u8")
        out[k::8] = x[: len(out[k::8])]
    return out


def equal_suffixes(raw: np.ndarray, i: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """True where the `length` bytes from i equal those from an earlier entry of i in its bucket."""
    again = np.zeros(len(i), dtype=bool)
    if len(i) < 2:
        return again
    width = 8 if length >= 8 else 1
    digits = digits_of(raw, width)
    order = np.argsort(bucket, kind="stable")
    new = np.append(True, np.diff(bucket[order]) != 0)
    for depth in [*range(0, length - width, width), length - width]:
        # suffixes alone in their bucket are settled
        kept = ~(new & np.append(new[1:], True))
        order, new = order[kept], new[kept]
        if not len(order):
            return again
        d = digits[i[order] + depth]
        group = np.cumsum(new) - 1
        differs = d != d[new][group]
        if differs.any():
            mixed = np.zeros(group[-1] + 1, dtype=bool)
            mixed[group[differs]] = True
            m = np.flatnonzero(mixed[group])
            by = m[np.lexsort((d[m], group[m]))]
            order[m], d[m] = order[by], d[by]
            new[1:] |= d[1:] != d[:-1]
    again[order[~new]] = True
    return again


def _cut(length: int):
    @B.tidy
    def run(batches):
        for rb in batches:
            raw, offs = B.buffer_of(rb.column(1))
            ends, a, b = R.listed(rb.column(2))
            rows = []
            for i in range(rb.num_rows):
                text = raw[offs[i] : offs[i + 1]]
                if ends[i] == ends[i + 1]:
                    rows.append((len(text), 0, [], hashlib.sha256(text).hexdigest()))
                    continue
                s, e = R.merged(a[ends[i] : ends[i + 1]], b[ends[i] : ends[i + 1]], length)
                keep = hashlib.sha256()
                at = 0
                for x, y in zip(s.tolist(), e.tolist(), strict=True):
                    keep.update(text[at:x])
                    at = y
                keep.update(text[at:])
                rows.append((len(text), int((e - s).sum()), [{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)], keep.hexdigest()))
            n, gone, spans, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield B.batch(OUT_PA, rb.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(sha, pa.string()), pa.array(spans, OUT_PA.field(5).type))

    return run


def repeated_bytes(docs: DataFrame, length: int = LENGTH, digit: int = DIGIT) -> DataFrame:
    """Per document the byte spans covered by a `length`-byte string that starts earlier."""
    rows, named = doc_rows(docs)
    starts = R.repeated_starts(rows, Bytes(length, digit))
    return named(R.with_lists(rows, starts, "a", "b").mapInArrow(_cut(length), OUT))


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Digest of what is left: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans."""
    return repeated_bytes(docs, length)
