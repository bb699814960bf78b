"""Vectorised helpers over the raw bytes of Arrow string columns.

A batch of texts is one byte buffer with offsets.  Everything here works on that buffer
with numpy, in slabs of a quarter megabyte.  A longer text is a slab of its own, of which
a copy is made and else only what is kept for each word grows with it.

Equality of words, lines and other spans rests on `span_hashes`, which isn't linear.  `Rolling`
is a polynomial modulo 2**64: sequences of structure (Thue-Morse words) collide in it under
any base once they have some hundred members, so it serves windows of a few words or bytes,
over codes that span_hashes gave or that are random.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
SLAB = 1 << 18
_rng = np.random.default_rng(20240607)
#: Random codes of the 256 bytes, for two hash functions.
CODES = _rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * U(2) + U(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_SEEDS = (0x51ED270B7A3C19D5, 0x2545F4914F6CDD1D)
_POWERS: dict = {}
#: What workers keep between tasks, by (operator, name).
KEPT: dict = {}
#: Spans of more bytes are hashed one by one.
WIDE = 64
#: Masks of the first 0 to 8 bytes.
TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64 and of its inverse."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, SLAB + 4096)
        base = _BASES[which]
        inv = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inv):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            np.multiply.accumulate(x, out=x)
            out.append(x)
        _POWERS[which] = have = tuple(out)
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


class Rolling:
    """Hashes of any slice of a code sequence, in constant time each; for short slices (see above)."""

    def __init__(self, codes: np.ndarray, which: int):
        n = len(codes)
        pw, self.inv = powers(n + 1, which)
        self.sum = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(codes * pw[:n], out=self.sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.inv[start])

    def every(self, k: int) -> np.ndarray:
        """Of all slices of length k."""
        m = len(self.sum) - k
        return mix((self.sum[k:] - self.sum[:m]) * self.inv[:m])


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the bytes of spans, not linear in them: eight bytes are mixed in at a time.

    Spans of over WIDE bytes go to xxh3.  The two functions (`which`) start from different
    seeds and are told apart by every mixing step.
    """
    size = np.asarray(end - start, dtype=np.int64)
    out = mix(size.astype(np.uint64) * U(0x9E3779B97F4A7C15) ^ U(_SEEDS[which]))
    eight = lanes(raw)
    live, at = np.flatnonzero((size > 0) & (size <= WIDE)), 0
    while len(live):
        out[live] = mix(out[live] ^ lane(eight, start[live] + at, size[live] - at) * U(_BASES[which]))
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > WIDE).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]], _SEEDS[which])
    return out


def lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros follow the end."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    return np.ndarray(len(raw) + 1, dtype="<u8", buffer=padded, strides=(1,))


def lane(eight: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from each place; those after the `left` bytes of a span are zero."""
    return eight[at] & TAIL[np.minimum(left, 8)]


def span_sums(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """True bytes within each of ascending disjoint spans; empty spans have none."""
    full = end > start
    out = np.zeros(len(start), dtype=np.int64)
    if full.any():
        both = np.stack((start[full], end[full]), axis=1).ravel()
        both = both[:-1] if both[-1] == len(mask) else both
        out[full] = np.add.reduceat(mask, both, dtype=np.int64)[::2]
    return out


def kept(owner: str, name: str, make):
    """What make() gives, kept in this worker for later tasks of the same operator (`owner`, a module)."""
    if (owner, name) not in KEPT:
        KEPT[owner, name] = make()
    return KEPT[owner, name]


def tidy(run):
    """Give memory back: workers are kept and share their executor's limit.

    What another operator kept goes when a task begins, what was freed when it ends.
    """

    @functools.wraps(run)
    def wrapped(batches):
        for k in [k for k in KEPT if k[0] != run.__module__]:
            del KEPT[k]
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    if span < w:
        x = np.minimum(x[: len(x) - (w - span)], x[w - span :])
    return x


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slabs(offs: np.ndarray, limit: int = SLAB):
    """Row ranges of at most `limit` bytes; a longer text stands alone."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_spans(raw: np.ndarray, offs: np.ndarray, is_space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words of the rows of one slab (offs from 0)."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~is_space[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = offs[1:-1]
    cut = cut[cut < len(raw)]
    first[cut] = word[cut]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = cut[cut > 0] - 1
    last[inner] = word[inner]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(offs, s, side="right") - 1


def long_col(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64, copy=False))


def batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], schema=schema)
