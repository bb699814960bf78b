"""Byte-level BPE of whole texts, encoded and decoded.

A text is cut into pre-tokens by the tokenizer's pattern.  The first tier is a minimal perfect
hash over the vocabulary: every pre-token of a slab is looked up at once, its bytes are compared
with those of the token at its place, and one that is a token is done.  The second tier merges
the rest: bytes are linked to their neighbours, a heap holds the ranks of adjacent pairs,
and the least rank, leftmost first, is joined until none is left.  Equal pre-tokens of a slab
are merged once, and kept in two tables of at most CACHE entries: when the newer is full it
becomes the older, so what is met often stays.

The file of ranks (one base64 token and its rank a line) is read by each worker; its path is a
parameter and every executor must find it there.

A null text is empty and has no ids.  Malformed UTF-8 counts as U+FFFD, as the tiktoken
library takes only strings.  Rows stand for themselves: null or repeated ids, repeated rows
and further columns change nothing, an empty table gives no rows.  Texts are encoded whole, a piece of CHUNK
pre-tokens at a time; one single pre-token of very many bytes takes some 150 bytes for each
while it is merged.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from . import crc

RANKS = "byte_bpe_50k.tiktoken"
CACHE, CHUNK, LONG = 250_000, 1 << 18, 1 << 20
SLAB = 1 << 20
SLOTS_PER_KEY = 2

IDS = "doc_id long, ids array<int>"
IDS_PA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
TEXT_PA = pa.schema([("doc_id", pa.int64()), ("bytes", pa.large_binary())])
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
DIGEST_PA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def ranks_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(RANKS)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys.

    Keys go through levels of bit arrays: a key that is alone on its slot sets the bit and
    stays, the others go on.  A key's place is the number of ones before its own, so n keys
    have the places 0..n-1 and some three bits of the arrays each.
    """

    def __init__(self, keys: np.ndarray):
        if len(np.unique(keys)) < len(keys):
            raise ValueError("keys are not distinct")
        self.levels, bits, first = [], [np.zeros(0, bool)], 0
        while len(keys):
            size = SLOTS_PER_KEY * len(keys) + 1
            slot = self.slots(keys, len(self.levels), size)
            alone = np.bincount(slot, minlength=size) == 1
            self.levels.append((first, size))
            bits.append(alone)
            first += size
            keys = keys[~alone[slot]]
        self.bits = np.concatenate(bits)
        self.before = np.cumsum(self.bits) - self.bits

    @staticmethod
    def slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (B.mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place; of what isn't a key, any place or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        live = np.arange(len(keys))
        for level, (first, size) in enumerate(self.levels):
            at = first + self.slots(keys[live], level, size)
            here = self.bits[at]
            out[live[here]] = self.before[at[here]]
            live = live[~here]
        return out


class Vocabulary:
    """Tokens of a rank file: found whole by a perfect hash, or merged out of bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        tokens = sorted(ranks, key=ranks.get)
        self.ids = np.array([ranks[t] for t in tokens], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        offs = np.append(0, np.cumsum([len(t) for t in tokens]))
        hashes = B.span_hashes(self.flat, offs[:-1], offs[1:])
        self.hash = PerfectHash(hashes)
        at = np.empty(len(tokens), dtype=np.int64)
        at[self.hash.places(hashes)] = np.arange(len(tokens))
        self.start, self.end, self.id_at = offs[:-1][at], offs[1:][at], self.ids[at]
        #: by id, for decoding
        self.first, self.size = np.zeros((2, int(self.ids.max()) + 1), dtype=np.int64)
        self.first[self.ids], self.size[self.ids] = offs[:-1], np.diff(offs)
        self.longest = int(self.size.max())
        self.sizes = self.size.tolist()
        self.newer, self.older = {}, {}

    def whole(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The id of each span that is a token, else -1."""
        place = self.hash.places(hashes)
        out = np.full(len(s), -1, dtype=np.int64)
        m = np.flatnonzero((place >= 0) & (e > s))
        p = place[m]
        m, p = m[(same := crc.same_spans(raw, s[m], e[m], self.flat, self.start[p], self.end[p]))], p[same]
        out[m] = self.id_at[p]
        return out

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a pre-token, by joining the adjacent pair of least rank, leftmost first."""
        n, rank = len(piece), self.ranks.get
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        # an entry is a rank and the place of the pair's first byte
        heap = [r << 40 | i for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            x = heappop(heap)
            r, i = x >> 40, x & 0xFFFFFFFFFF
            j = after[i]
            if not j or j >= n or after[j] - i != self.sizes[r]:
                continue  # one of the two was joined meanwhile
            k = after[j]
            after[i], after[j] = k, 0
            if k < n:
                ahead[k] = i
                if after[k] - i <= self.longest and (r := rank(piece[i : after[k]])) is not None:
                    heappush(heap, r << 40 | i)
            p = ahead[i]
            if p >= 0 and k - p <= self.longest and (r := rank(piece[p:k])) is not None:
                heappush(heap, r << 40 | p)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def kept(self, piece: bytes) -> bytes:
        """The ids of a pre-token as packed 32-bit numbers, merged unless a table has them."""
        ids = self.newer.get(piece)
        if ids is None:
            ids = self.older.get(piece)
            if ids is None:
                ids = np.array(self.merged(piece), dtype="<u4").tobytes()
            if len(piece) <= B.WIDE:
                if len(self.newer) >= CACHE:
                    self.newer, self.older = {}, self.newer
                self.newer[piece] = ids
        return ids

    def encode(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans in turn, ids of each span)."""
        hashes = B.span_hashes(raw, s, e)
        whole = self.whole(raw, s, e, hashes)
        many = np.ones(len(s), dtype=np.int64)
        rest = np.flatnonzero(whole < 0)
        if not len(rest):
            return whole.astype("<u4"), many
        # one of each hash is merged, and any that turns out to be of other bytes
        _, one, of = np.unique(hashes[rest], return_index=True, return_inverse=True)
        lead = rest[one][of]
        other = rest[~crc.same_spans(raw, s[rest], e[rest], raw, s[lead], e[lead])]
        if len(other):
            of[np.searchsorted(rest, other)] = len(one) + np.arange(len(other))
        merged = np.append(rest[one], other)
        flat = raw.tobytes()
        parts = [self.kept(flat[x:y]) for x, y in zip(s[merged].tolist(), e[merged].tolist(), strict=True)]
        sizes = np.array([len(p) // 4 for p in parts])
        ids, at = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes
        many[rest] = n = sizes[of]
        out = np.repeat(whole, many)
        out[out < 0] = ids[np.repeat(at[of] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return out.astype("<u4"), many

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids."""
        n = self.size[ids]
        at = np.repeat(self.first[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.flat[at]


@functools.lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


@functools.lru_cache(4)
def compiled(pattern: str):
    return regex.compile(pattern)


def pre_tokens(raw: np.ndarray, offs: np.ndarray, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the matches in the texts of one slab; places are of bytes."""
    find = compiled(pattern)
    point = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # byte of each code point
    first = np.searchsorted(point, offs[:-1])
    starts, ends, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(offs) - 1):
        text = str(memoryview(raw[offs[i] : offs[i + 1]]), "utf-8")
        size = np.fromiter(map(len, find.findall(text)), dtype=np.int64) if len(text) <= LONG else np.zeros(0, np.int64)
        if size.sum() == len(text):  # the matches follow each other without a gap
            end = np.cumsum(size) + first[i]
            start = end - size
        else:  # or there is no list of all of them
            spans = np.fromiter((x for m in find.finditer(text) for x in m.span()), dtype=np.int64).reshape(-1, 2) + first[i]
            start, end = spans[:, 0], spans[:, 1]
        starts.append(point[start])
        ends.append(point[end])
        rows.append(np.full(len(start), i))
    return tuple(np.concatenate(x) for x in (starts, ends, rows))


def runs(v: Vocabulary, raw: np.ndarray, offs: np.ndarray, pattern: str):
    """(row, ids of it) in turn; a long text comes in several pieces."""
    s, e, row = pre_tokens(raw, offs, pattern)
    for lo in range(0, len(s), CHUNK):
        hi = min(lo + CHUNK, len(s))
        ids, many = v.encode(raw, s[lo:hi], e[lo:hi])
        r = row[lo:hi]
        cut = np.append(np.flatnonzero(np.append(True, r[1:] != r[:-1])), len(r))
        at = np.append(0, np.cumsum(many))[cut]
        for k in range(len(cut) - 1):
            yield int(r[cut[k]]), ids[at[k] : at[k + 1]]


def slabs_of(batches):
    """(doc_ids, bytes, offsets) of slabs of the batches' rows."""
    for rb in batches:
        ids = rb.column(0)
        raw, offs = B.buffer_of(rb.column(1))
        for lo, hi in B.slabs(offs, SLAB):
            yield ids.slice(lo, hi - lo), *crc.valid_utf8(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])


def _two(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _pattern(pattern: str | None) -> str:
    if pattern:
        return pattern
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids): one row per row of docs."""
    path, pattern = ranks_path(path), _pattern(pattern)

    @B.tidy
    def run(batches):
        v = vocabulary(path)
        for ids, raw, offs in slabs_of(batches):
            found = [np.zeros(0, "<u4")]
            many = np.zeros(len(ids), dtype=np.int64)
            for r, x in runs(v, raw, offs, pattern):
                found.append(x)
                many[r] += len(x)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), pa.array(np.concatenate(found).astype(np.int32)))
            yield B.batch(IDS_PA, ids, lists)

    return _two(docs).mapInArrow(run, IDS)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, bytes): the bytes of (doc_id, ids); null ids are none.  Cast to string for texts."""
    path = ranks_path(path)

    @B.tidy
    def run(batches):
        v = vocabulary(path)
        for rb in batches:
            out = [v.decode(np.asarray(x.values if x.is_valid else [], dtype=np.int64)).tobytes() for x in rb.column(1)]
            yield B.batch(TEXT_PA, rb.column(0), pa.array(out, pa.large_binary()))

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): texts encoded, their ids decoded again, both digested."""
    path, pattern = ranks_path(path), _pattern(pattern)

    @B.tidy
    def run(batches):
        v = vocabulary(path)
        for ids, raw, offs in slabs_of(batches):
            many = np.zeros(len(ids), dtype=np.int64)
            both = [(hashlib.sha256(), hashlib.sha256()) for _ in range(len(ids))]
            for r, x in runs(v, raw, offs, pattern):
                many[r] += len(x)
                both[r][0].update(x)
                both[r][1].update(v.decode(x))
            yield B.batch(DIGEST_PA, ids, B.long_col(many), pa.array([a.hexdigest() for a, _ in both]), pa.array([b.hexdigest() for _, b in both]))

    return _two(docs).mapInArrow(run, DIGEST)
