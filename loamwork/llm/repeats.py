"""Repeated windows of a token sequence, found without moving every window.

A window of `length` tokens is keyed by its anchor: the k-gram of least hash in it
(leftmost of equals).  Equal windows have equal anchors at equal places, so windows need
comparing only under one anchor.  Neighbouring windows of one anchor form a segment:

1. every segment is one row (anchor hash, two segment hashes, document, place), combined within
   its batch: a segment seen earlier in the batch is repeated for certain;
2. rows meet by anchor hash; a segment equal to an earlier one is repeated as a whole;
3. only segments that share an anchor with a *different* segment are opened: their tokens
   meet by anchor hash and their windows are compared, each operator in its own way; all
   but the first are repeated.  Anchors with more than `CROWDED` different segments send one row per window instead,
   so that no task holds such a group.

Keys are an anchor hash of 64 bits and 128 more of the segment or the window.  A batch sends each segment on once, so a key's rows number at most the batches
times its different segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .common import staged

LOW = np.uint64((1 << 24) - 1)
PIECE = 1 << 18
#: Rows compared at once, and the most of one anchor that a task takes in (some 8 MB of tokens).
OPEN_ROWS, CROWDED = 1 << 14, 1 << 16
#: A place packs the first start, the anchor's and the last start's distance, and a flag
#: for "repeated in its batch"; distances take 12 bits.
WIDE = 12

SEG = "h long, s long, s2 long, rid long, q long"
SEG_PA = pa.schema([(c, pa.int64()) for c in ("h", "s", "s2", "rid", "q")])
TOK = "h long, rid long, q long, tokens binary"
TOK_PA = pa.schema([("h", pa.int64()), ("rid", pa.int64()), ("q", pa.int64()), ("tokens", pa.binary())])
WIN = "h long, u long, v long, rid long, a long, sure boolean"
WIN_PA = pa.schema([(c, pa.bool_() if c == "sure" else pa.int64()) for c in ("h", "u", "v", "rid", "a", "sure")])
RUN = "rid long, a long, b long"
RUN_PA = pa.schema([(c, pa.int64()) for c in ("rid", "a", "b")])


def pack(a, b, p, sure):
    return (((a << WIDE) | (p - a)) << WIDE | (b - a)) << 1 | sure


def unpack(q):
    """(a, b, p) of packed places."""
    low = (1 << WIDE) - 1
    a = q >> (2 * WIDE + 1)
    return a, a + ((q >> 1) & low), a + ((q >> (WIDE + 1)) & low)


class Tokens:
    """What an operator compares: how texts become token codes, and how windows are told apart.

    `split(raw, offs)` gives (byte starts, byte ends) of the tokens of a slab and the bounds
    of its documents in tokens; `codes(raw, starts, ends, which)` one 64-bit code a token;
    `again(raw, starts, ends, at, h, left, n)` compares the windows of opened segments;
    `halves` hashes single windows of crowded anchors; `pieces(raw)` cuts a long text into
    (first byte, last byte, tokens before), each with the first length - 1 tokens of the next.
    """

    length: int
    k: int

    def split(self, raw, offs): ...
    def codes(self, raw, starts, ends, which): ...
    def halves(self, roll, i, p): ...
    def pieces(self, raw): ...

    def again(self, raw, starts, ends, at, h, left, n):
        """True per window that equals an earlier one under its anchor hash h.

        Segment j holds n[j] windows, the first at token at[j] and its anchor left[j] tokens
        further; windows come segment by segment, earlier ones first within each h.
        """


def segments(c0, c1, bounds, length: int, k: int):
    """(row, h, s, s2, a, b, p) of the segments of one slab; places count from the row's start."""
    out = []
    n = len(c0)
    stops = np.repeat(bounds[1:], np.diff(bounds))
    for lo in range(0, max(n - length + 1, 0), PIECE):
        hi = min(n, lo + PIECE + length - 1)
        x0, x1 = c0[lo:hi], c1[lo:hi]
        roll = B.Rolling(x0, 0)
        kh = roll.every(k)
        key = (kh & ~LOW) | np.arange(len(kh), dtype=np.uint64)
        pos = (B.sliding_min(key, length - k + 1) & LOW).astype(np.int64)
        new = np.ones(len(pos), dtype=bool)
        new[1:] = pos[1:] != pos[:-1]
        # windows that run over a document's end aren't windows
        ok = np.arange(lo + length, lo + length + len(pos)) <= stops[lo : lo + len(pos)]
        new[1:] |= ok[1:] & ~ok[:-1]
        first = np.flatnonzero(new & ok)
        if not len(first):
            continue
        stop = np.flatnonzero(np.append(new[1:] | ~ok[1:], True) & ok)
        a, b, p = first, stop, pos[first]
        row = np.searchsorted(bounds, a + lo, side="right") - 1
        place = ((b - a) * 4096 + (p - a)).astype(np.uint64)
        s, s2 = (B.mix(x.of(a, b + length) ^ place) for x in (B.Rolling(x1, 1), roll))
        base = lo - bounds[row]
        out.append((row, kh[p], s, s2, a + base, b + base, p + base))
    if not out:
        z = np.zeros(0, np.int64)
        u = z.astype(np.uint64)
        return z, u, u, u, z, z, z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeated_here(keys: list[np.ndarray], rid: np.ndarray, a: np.ndarray) -> np.ndarray:
    """True where equal keys stand earlier (by rid, a) in this batch."""
    n = len(rid)
    sure = np.zeros(n, dtype=bool)
    if n < 2:
        return sure
    x = keys[0].copy()
    for y in keys[1:]:
        x = B.mix(x) ^ y
    sorted_already = bool(np.all((rid[1:] > rid[:-1]) | ((rid[1:] == rid[:-1]) & (a[1:] >= a[:-1]))))
    order = np.arange(n) if sorted_already else np.lexsort((a, rid))
    order = order[np.argsort(x[order], kind="stable")]
    same = np.ones(n - 1, dtype=bool)
    for y in keys:
        z = y[order]
        same &= z[1:] == z[:-1]
    sure[order[1:]] = same
    return sure


def away(h: np.ndarray, rid: np.ndarray, a: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Rows that need no meeting get keys of their own, so that they spread evenly."""
    return np.where(sure, B.mix(B.mix(rid.view(np.uint64)) + a.view(np.uint64)), h)


def segment_rows(t: Tokens):
    @B.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rid = np.asarray(rb.column(0)).astype(np.int64)
            raw, offs = B.buffer_of(rb.column(1))
            parts = []
            for lo, hi in B.slabs(offs):
                r = raw[offs[lo] : offs[hi]]
                cuts = t.pieces(r) if hi == lo + 1 and len(r) > 2 * B.SLAB else [(0, len(r), 0)]
                for x, y, before in cuts:
                    part = r[x:y]
                    starts, ends, bounds = t.split(part, offs[lo : hi + 1] - offs[lo] if y - x == len(r) else np.array([0, y - x]))
                    row, h, s, s2, a, b, p = segments(t.codes(part, starts, ends, 0), t.codes(part, starts, ends, 1), bounds, t.length, t.k)
                    parts.append((rid[lo + row], h, s, s2, a + before, b + before, p + before))
            if not parts:
                continue
            r, h, s, s2, a, b, p = (np.concatenate(x) for x in zip(*parts, strict=True))
            sure = repeated_here([h, s, s2], r, a)
            yield B.batch(SEG_PA, *map(B.long_col, (away(h, r, a, sure), s, s2, r, pack(a, b, p, sure))))

    return run


def opened_rows(t: Tokens, windows: bool):
    """The listed segments of each text: their tokens, or (windows) a row per window."""

    @B.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rid = np.asarray(rb.column(0)).astype(np.int64)
            raw, offs = B.buffer_of(rb.column(1))
            ends, h, q = listed(rb.column(2))
            a, b, p = unpack(q)
            parts, texts = [], []
            for lo, hi in B.slabs(offs):
                f, e = ends[lo], ends[hi]
                if f == e:
                    continue
                r = raw[offs[lo] : offs[hi]]
                ts, te, bounds = t.split(r, offs[lo : hi + 1] - offs[lo])
                base = bounds[np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))]
                own = rid[lo + np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))]
                if not windows:
                    flat = r.tobytes()
                    texts += [flat[x:y] for x, y in zip(ts[base + a[f:e]].tolist(), te[base + b[f:e] + t.length - 1].tolist(), strict=True)]
                    parts.append((h[f:e], own, q[f:e]))
                    continue
                n = b[f:e] - a[f:e] + 1
                which = np.repeat(np.arange(e - f), n)
                i = a[f:e][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                u, v = t.halves(B.Rolling(t.codes(r, ts, te, 1), 1), i + base[which], p[f:e][which] + base[which])
                parts.append((h[f:e][which].view(np.uint64), u, v, own[which], i))
            if not parts:
                continue
            if not windows:
                yield B.batch(TOK_PA, *(B.long_col(np.concatenate(x)) for x in zip(*parts, strict=True)), pa.array(texts, pa.binary()))
                continue
            hh, u, v, r, i = (np.concatenate(x) for x in zip(*parts, strict=True))
            sure = repeated_here([hh, u, v], r, i)
            yield B.batch(WIN_PA, *map(B.long_col, (away(hh, r, i, sure), u, v, r, i)), pa.array(sure))

    return run


def compared(t: Tokens, h, rid, q, raw, offs):
    """(rid, a, b): runs of windows that stand earlier under the same anchor; rows sorted."""
    a, b, p = unpack(q)
    ts, te, bounds = t.split(raw, offs)
    n = b - a + 1
    which = np.repeat(np.arange(len(h)), n)
    j = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    again = t.again(raw, ts, te, bounds[:-1], h, p - a, n)
    at = np.flatnonzero(again)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (which[at[1:]] != which[at[:-1]])
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
    w = which[first]
    return rid[w], a[w] + j[first], a[w] + j[last]


def compare_groups(t: Tokens):
    """Rows come sorted by (h, rid, q); an anchor's last rows wait for the next batch."""

    @B.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for rb in batches:
            rows = pa.Table.from_batches([rb])
            if kept is not None:
                rows = pa.concat_tables([kept, rows])
            h = np.asarray(rows.column(0).combine_chunks())
            cut = len(h) - int(np.argmax(h[::-1] != h[-1])) if len(h) and h[0] != h[-1] else 0
            kept = rows.slice(cut)
            if cut:
                yield from emit(rows.slice(0, cut))
        if kept is not None and kept.num_rows:
            yield from emit(kept)

    def emit(rows):
        for lo in bounded(rows):
            part = rows.slice(lo[0], lo[1] - lo[0])
            h, rid, q = (np.asarray(part.column(i).combine_chunks()).astype(np.int64) for i in range(3))
            raw, offs = B.buffer_of(part.column(3).combine_chunks().cast(pa.large_binary()))
            yield B.batch(RUN_PA, *map(B.long_col, compared(t, h, rid, q, raw, offs)))

    def bounded(rows):
        """Slices of whole groups with a few thousand rows."""
        h = np.asarray(rows.column(0).combine_chunks())
        starts = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h))
        lo = 0
        while lo < len(h):
            hi = int(starts[np.searchsorted(starts, min(lo + OPEN_ROWS, len(h)))])
            yield lo, hi
            lo = hi

    return run


def repeated_starts(rows: DataFrame, t: Tokens) -> DataFrame:
    """(rid, a, b): the windows starting at a to b of document rid start earlier elsewhere.

    `rows` holds (rid, text) with unique rids.
    """
    seg = rows.mapInArrow(segment_rows(t), SEG)
    by_h = Window.partitionBy("h")
    order = by_h.orderBy("s", "s2", "rid", "q")
    same = (F.lag("s").over(order) == F.col("s")) & (F.lag("s2").over(order) == F.col("s2"))
    met = seg.withColumns(
        {
            "again": F.coalesce(same, F.lit(False)) | (F.col("q").bitwiseAND(F.lit(1)) == 1),
            "differ": (F.min("s").over(by_h) != F.max("s").over(by_h)) | (F.min("s2").over(by_h) != F.max("s2").over(by_h)),
        }
    )
    met = staged(met.filter("again OR differ").select("h", "rid", "q", "again"), "segments")
    start = F.shiftright("q", 2 * WIDE + 1)
    found = met.filter("again").select("rid", start.alias("a"), (start + F.shiftright("q", 1).bitwiseAND(F.lit((1 << WIDE) - 1))).alias("b"))
    mixed = met.filter("NOT again").select("h", "rid", "q")
    crowded = mixed.groupBy("h").count().filter(F.col("count") > CROWDED).select(F.col("h").alias("h2"))
    if crowded.limit(1).take(1):
        crowded = staged(crowded, "crowded")
        far = mixed.join(crowded.hint("merge"), F.col("h") == F.col("h2"), "left_semi")
        mixed = mixed.join(crowded.hint("merge"), F.col("h") == F.col("h2"), "left_anti")
        first = Window.partitionBy("h", "u", "v").orderBy("rid", "a")
        single = with_lists(rows, far, "h", "q").mapInArrow(opened_rows(t, True), WIN).withColumn("rn", F.row_number().over(first))
        found = found.unionByName(single.filter("rn > 1 OR sure").select("rid", "a", F.col("a").alias("b")))
    tokens = with_lists(rows, mixed, "h", "q").mapInArrow(opened_rows(t, False), TOK)
    runs = tokens.repartition("h").sortWithinPartitions("h", "rid", "q").mapInArrow(compare_groups(t), RUN)
    return found.unionByName(runs)


def with_lists(rows: DataFrame, found: DataFrame, x: str, y: str) -> DataFrame:
    """(rid, text, listed): each document with its (x, y), or null; always the same shuffle of rows."""
    lists = found.groupBy("rid").agg(F.collect_list(F.struct(x, y)).alias("listed")).withColumnRenamed("rid", "rid2")
    return rows.join(lists.hint("merge"), F.col("rid") == F.col("rid2"), "left").select("rid", "text", "listed")


def merged(a: np.ndarray, b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of tokens covered by windows that start at a..b."""
    order = np.argsort(a, kind="stable")
    a, e = a[order], np.maximum.accumulate(b[order] + length)
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[1:] > e[:-1]
    first = np.flatnonzero(new)
    return a[first], e[np.append(first[1:], len(a)) - 1]


def listed(col: pa.Array):
    """(ends, x, y) of a column of lists of pairs; null lists are empty."""
    sizes = np.asarray(col.value_lengths().fill_null(0)).astype(np.int64)
    flat = col.flatten()
    return np.concatenate(([0], np.cumsum(sizes))), np.asarray(flat.field(0)), np.asarray(flat.field(1))
