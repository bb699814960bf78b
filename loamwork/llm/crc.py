"""CRC-32 of many byte spans at once, and of spans joined, without touching their bytes again.

With S the step of the register over one zero byte, crc(XY) = S^len(Y)(crc(X)) ^ crc(Y); S^n is
linear, so it is looked up by the four bytes of its argument.  Spans of over WIDE bytes go to zlib.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np

from . import bytesops as B

WIDE = 64
ONES = np.uint32(0xFFFFFFFF)
BYTE = np.uint32(255)
EIGHT = np.uint32(8)


@functools.lru_cache(1)
def step_table() -> np.ndarray:
    """The register after one byte, by its low byte (polynomial EDB88320)."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & np.uint32(1), (x >> np.uint32(1)) ^ np.uint32(0xEDB88320), x >> np.uint32(1))
    return x


@functools.lru_cache(1)
def zero_tables() -> np.ndarray:
    """[n, k, b]: the register b << 8 * k after n zero bytes."""
    t = step_table()
    x = (np.arange(256, dtype=np.uint32)[None, :] << (EIGHT * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = [x]
    for _ in range(WIDE):
        x = (x >> EIGHT) ^ t[x & BYTE]
        out.append(x)
    return np.stack(out)


def of_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes of each span, as uint32."""
    t = step_table()
    size = end - start
    reg = np.full(len(start), ONES, dtype=np.uint32)
    live, at = np.flatnonzero((size > 0) & (size <= WIDE)), 0
    while len(live):
        x = reg[live]
        reg[live] = (x >> EIGHT) ^ t[(x ^ raw[start[live] + at]) & BYTE]
        at += 1
        live = live[size[live] > at]
    out = reg ^ ONES
    for i in np.flatnonzero(size > WIDE).tolist():
        out[i] = zlib.crc32(raw[start[i] : end[i]])
    return out


def joined(first: np.ndarray, second: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of XY from those of X and of Y, where Y is the span [start, end)."""
    z = zero_tables()
    size = end - start
    n = np.minimum(size, WIDE)
    x = np.asarray(first, dtype=np.uint32)
    out = z[n, 0, x & BYTE] ^ z[n, 1, (x >> EIGHT) & BYTE] ^ z[n, 2, (x >> np.uint32(16)) & BYTE] ^ z[n, 3, x >> np.uint32(24)] ^ second
    for i in np.flatnonzero(size > WIDE).tolist():
        out[i] = zlib.crc32(raw[start[i] : end[i]], int(x[i]))
    return out


def with_space(crc: np.ndarray) -> np.ndarray:
    """CRC-32 of X and a space, from that of X."""
    x = crc ^ ONES
    return ((x >> EIGHT) ^ step_table()[(x ^ np.uint32(32)) & BYTE]) ^ ONES


def same_spans(a: np.ndarray, s: np.ndarray, e: np.ndarray, b: np.ndarray, s2: np.ndarray, e2: np.ndarray) -> np.ndarray:
    """True where the bytes a[s:e] and b[s2:e2] are equal; eight bytes are compared at a time."""
    size = e - s
    same = size == e2 - s2
    x, y = B.lanes(a), B.lanes(b)
    live, at = np.flatnonzero(same & (size > 0)), 0
    while len(live):
        left = size[live] - at
        differ = B.lane(x, s[live] + at, left) != B.lane(y, s2[live] + at, left)
        same[live[differ]] = False
        at += 8
        live = live[~differ & (left > 8)]
    return same


def valid_utf8(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buffer and offsets of texts with malformed bytes replaced by U+FFFD; as given where all is well."""
    try:
        str(memoryview(raw), "utf-8")
        return raw, offs
    except UnicodeDecodeError:
        texts = [str(memoryview(raw[lo:hi]), "utf-8", "replace").encode() for lo, hi in zip(offs[:-1], offs[1:], strict=True)]
        return np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
