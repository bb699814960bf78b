"""Benchmark decontamination with an FM-index per shard of the training documents.

A shard is one Arrow batch of documents.  Words outside the benchmark's vocabulary can't be
part of a test window, so only runs of vocabulary words long enough for the shortest window
enter the shard's index; runs end in separators.  The index holds the runs' Burrows-Wheeler
transform in a wavelet matrix.  All test windows are searched backward at once by two ranks a
word; the rows found walk to the nearest sampled suffix (every 8th word and each run's first)
to be located; word spans of one document then merge.

The benchmark is bounded per pass, not in total: items are dealt by hash over as many blocks
as keep a block's text under `BLOCK_BYTES`, each block is searched in a pass of its own, and
a document's spans and items from several passes are merged.

Null or empty texts have no words and no hits; items without words have no windows; an item
whose id is null counts under the empty id, and items that share an id count once.  Rows with
equal doc_id stay apart in one pass; see `common.doc_rows` for several.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import doc_rows, staged, with_rid

WINDOW, SAMPLE = 13, 8
BLOCK_BYTES = 8 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
APART = np.ones(256, dtype=bool)
APART[48:58] = APART[97:123] = APART[128:] = False

OUT = "rid long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
OUT_PA = pa.schema([("rid", pa.int64()), ("n_words", pa.int64()), ("spans", SPANS), ("items", pa.list_(pa.string()))])


def words_of(raw: np.ndarray, offs: np.ndarray):
    """(codes of the words of a slab's texts, their rows, a function that gives second codes of chosen words)."""
    low = LOWER[raw]
    s, e, row = B.word_spans(low, offs, APART)
    return B.span_hashes(low, s, e), row, lambda at: B.span_hashes(low, s[at], e[at], 1)


class Phrases:
    """The test windows of a block of items: places in one array of words, and the items they're from.

    Equal windows (by 128 bits over their words' codes) are one.  What is sent to the
    executors is some 30 bytes for each word of the block.
    """

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        raw, offs = B.buffer_of(pa.array([t or "" for _, t in items], pa.string()))
        z = np.zeros(0, np.int64)
        parts = [(z.astype(np.uint64), z.astype(np.uint64), z)]
        for lo, hi in B.slabs(offs):
            codes, row, second = words_of(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            parts.append((codes, second(np.arange(len(codes))), row + lo))
        codes, seconds, row = (np.concatenate(x) for x in zip(*parts, strict=True))
        n = np.bincount(row, minlength=len(items))
        many = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
        item = np.repeat(np.arange(len(items)), many)
        start = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(np.cumsum(n) - n, many)
        size = np.minimum(n, window)[item]
        h = [B.Rolling(codes, k).of(start, start + size) + size.astype(np.uint64) for k in (0, 1)]
        order = np.lexsort((h[1], h[0]))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(h[0][order]) != 0) | (np.diff(h[1][order]) != 0)
        self.starts, self.sizes = start[order[new]], size[order[new]]
        #: names of items in order, and for each window the ranks of its items
        self.names = sorted({i for i, _ in items})
        rank = np.searchsorted(np.array(self.names, dtype=object), np.array([i for i, _ in items], dtype=object)) if items else z
        pair = np.unique((np.cumsum(new) - 1) * max(len(self.names), 1) + rank[item[order]])
        self.ranks = (pair % max(len(self.names), 1)).astype(np.int32)
        self.bounds = np.searchsorted(pair // max(len(self.names), 1), np.arange(len(self.starts) + 1))
        self.vocabulary, where, sym = np.unique(codes, return_index=True, return_inverse=True)
        self.seconds = seconds[where]
        self.symbols = (sym + 1).astype(np.int32)  # of the words; 0 is no word
        self.least, self.most = (int(self.sizes.min()), int(self.sizes.max())) if len(self.sizes) else (0, 0)
        self.likely = np.zeros(1 << 16, dtype=bool)
        self.likely[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def items_of(self, windows: np.ndarray) -> list[str]:
        """The items of some windows, sorted."""
        ranks = [self.ranks[self.bounds[w] : self.bounds[w + 1]] for w in np.unique(windows).tolist()]
        return [self.names[r] for r in np.unique(np.concatenate(ranks)).tolist()] if ranks else []

    def encode(self, codes: np.ndarray, second) -> np.ndarray:
        """The words' symbols; a word is one of the vocabulary if both codes, 128 bits, agree."""
        out = np.zeros(len(codes), dtype=np.int64)
        at = np.flatnonzero(self.likely[(codes >> np.uint64(48)).astype(np.int64)])
        x = codes[at]
        i = np.minimum(np.searchsorted(self.vocabulary, x), len(self.vocabulary) - 1)
        same = self.vocabulary[i] == x
        at, i = at[same], i[same]
        out[at] = np.where(second(at) == self.seconds[i], i + 1, 0)
        return out


class Index:
    """FM-index of words 1..size-1 in runs that each end in a separator 0."""

    def __init__(self, text: np.ndarray, size: int):
        n = len(text)
        stop = text == 0
        # separators differ, in order of place, so that every suffix is distinct
        rank = np.where(stop, np.cumsum(stop) - 1, text + int(stop.sum()))
        k = 1
        while True:
            ahead = np.full(n, -1, dtype=np.int64)
            ahead[: n - k] = rank[k:] if k < n else ahead[:0]
            key = rank * np.int64(2 * n + size + 2) + ahead + 1
            order = np.argsort(key, kind="stable")
            step = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
            rank = np.empty(n, dtype=np.int64)
            rank[order] = step
            if step[-1] == n - 1:
                break
            k *= 2
        self.suffixes = order
        before = np.where(order > 0, text[order - 1], 0)
        self.bwt = before
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        # the wavelet matrix, highest bit first
        self.levels = []
        x = before
        for bit in range(max(int(size - 1).bit_length(), 1) - 1, -1, -1):
            ones = (x >> bit) & 1
            ranks = np.concatenate(([0], np.cumsum(ones)))
            zeros = n - int(ranks[-1])
            self.levels.append((bit, ranks, zeros))
            x = np.concatenate((x[ones == 0], x[ones == 1]))
        start = np.append(True, stop[:-1])
        self.sampled = ((order % SAMPLE == 0) | start[order]) & ~stop[order]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c among the first i symbols of the transform."""
        lo = np.zeros_like(i)
        for bit, ranks, zeros in self.levels:
            one = ((c >> bit) & 1).astype(bool)
            lo = np.where(one, zeros + ranks[lo], lo - ranks[lo])
            i = np.where(one, zeros + ranks[i], i - ranks[i])
        return i - lo

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each phrase, from its last word back."""
        m = len(phrases.starts)
        lo, hi = np.zeros(m, dtype=np.int64), np.full(m, len(self.bwt), dtype=np.int64)
        live = np.arange(m)
        for t in range(1, phrases.most + 1):
            live = live[phrases.sizes[live] >= t]
            c = phrases.symbols[phrases.starts[live] + phrases.sizes[live] - t].astype(np.int64)
            lo[live] = self.counts[c] + self.rank(c, lo[live])
            hi[live] = self.counts[c] + self.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        steps = np.zeros(len(rows), dtype=np.int64)
        walking = np.flatnonzero(~self.sampled[rows])
        rows = rows.copy()
        while len(walking):
            c = self.bwt[rows[walking]]
            rows[walking] = self.counts[c] + self.rank(c, rows[walking])
            steps[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.suffixes[rows] + steps


def runs_of(phrases: Phrases, codes: np.ndarray, row: np.ndarray, second):
    """Symbols of the runs with separators, and each one's word number (or -1)."""
    sym = phrases.encode(codes, second)
    inside = sym > 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (row[1:] != row[:-1])
    end = inside.copy()
    end[:-1] &= ~inside[1:] | (row[1:] != row[:-1])
    s, e = np.flatnonzero(new), np.flatnonzero(end) + 1
    long = e - s >= phrases.least
    s, e = s[long], e[long]
    n = e - s + 1
    at = np.repeat(s, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    last = np.cumsum(n) - 1
    text = sym[np.minimum(at, max(len(sym) - 1, 0))] if len(at) else at
    text[last], at[last] = 0, -1
    return text, at


def shard_hits(phrases: Phrases, raw: np.ndarray, offs: np.ndarray):
    """(words of each row, row, first word and window number of every occurrence)."""
    rows = len(offs) - 1
    n_words = np.zeros(rows, dtype=np.int64)
    texts, owners, firsts = [], [], []
    for lo, hi in B.slabs(offs):
        codes, row, second = words_of(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        n = np.bincount(row, minlength=hi - lo)
        n_words[lo:hi] = n
        if phrases.least:
            text, at = runs_of(phrases, codes, row, second)
            own = row[at] if len(row) else at
            texts.append(text)
            owners.append(own + lo)
            firsts.append(at - (np.cumsum(n) - n)[own] if len(own) else at)
    z = np.zeros(0, np.int64)
    text = np.concatenate(texts) if texts else z
    if not len(text):
        return n_words, z, z, z
    index = Index(text, len(phrases.vocabulary) + 1)
    lo, hi = index.search(phrases)
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(n)), n)
    at = index.locate(np.repeat(lo, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n))
    return n_words, np.concatenate(owners)[at], np.concatenate(firsts)[at], which


def _search(shared):
    @B.tidy
    def run(batches):
        phrases = shared.value
        for rb in batches:
            raw, offs = B.buffer_of(rb.column(1))
            n_words, row, first, which = shard_hits(phrases, raw, offs)
            spans: list = [None] * rb.num_rows
            items: list = [None] * rb.num_rows
            order = np.lexsort((first, row))
            row, first, which = row[order], first[order], which[order]
            cut = np.flatnonzero(np.append(True, row[1:] != row[:-1])).tolist() if len(row) else []
            for lo, hi in zip(cut, [*cut[1:], len(row)], strict=False):
                merged: list = []
                for s, e in zip(first[lo:hi].tolist(), (first[lo:hi] + phrases.sizes[which[lo:hi]]).tolist(), strict=True):
                    if merged and s <= merged[-1]["end"]:
                        merged[-1]["end"] = max(e, merged[-1]["end"])
                    else:
                        merged.append({"start": s, "end": e})
                spans[row[lo]] = merged
                items[row[lo]] = phrases.items_of(which[lo:hi])
            yield B.batch(OUT_PA, rb.column(0), B.long_col(n_words), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string())))

    return run


def merge_spans(spans):
    """Overlapping or touching spans of one document made maximal, as a column."""
    kind = "array<struct<start:bigint,end:bigint>>"
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast(kind),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )


def items_of(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string"))


def blocks_of(items: DataFrame, block_bytes: int) -> int:
    return -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes) or 1


def block_phrases(items: DataFrame, k: int, blocks: int, window: int):
    """The test windows of block k, sent to the executors; a block's bytes are bounded."""
    block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).sort("item_id", "text").collect()
    return items.sparkSession.sparkContext.broadcast(Phrases([tuple(r) for r in block], window))


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items): merged removal spans in words, and the items found."""
    items = items_of(benchmark)
    blocks = blocks_of(items, block_bytes)
    if blocks == 1:
        rows, named = docs.select(F.col("doc_id").cast("long").alias("rid"), F.col("text").cast("string")), lambda out: out.withColumnRenamed("rid", "doc_id")
    else:
        rows, named = doc_rows(docs)
    out = None
    for k in range(blocks):
        found = rows.mapInArrow(_search(block_phrases(items, k, blocks, window)), OUT)
        if blocks > 1:
            found = staged(found, "hits")
        out = found if out is None else out.unionByName(found)
    if blocks > 1:
        none = F.array().cast("array<struct<start:bigint,end:bigint>>")
        spans = merge_spans(F.flatten(F.collect_list(F.coalesce("spans", none))))
        out = out.groupBy("rid").agg(F.max("n_words").alias("n_words"), spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("items", F.array().cast("array<string>")))))).alias("items"))
    return named(out)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans: one row per row of docs."""
    found = find_items(docs, benchmark, window, block_bytes)
    hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"]), F.lit(0))
    return found.withColumn("n_hit", hit.cast("long")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(F.coalesce("items", F.array().cast("array<string>"))).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "spans",
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, share: int = 20) -> DataFrame:
    """The rows of docs, with all their columns, that aren't contaminated.

    One block of items needs no shuffle; several meet by document.
    """
    items = items_of(benchmark)
    if blocks_of(items, block_bytes) > 1:
        rows, rid = with_rid(docs)
        bad = contamination(rows.select(F.col(rid).alias("doc_id"), "text"), benchmark, window, block_bytes, share).filter("contaminated")
        bad = bad.select(F.col("doc_id").alias("__bad")).hint("merge")
        return rows.join(bad, rows[rid] == bad["__bad"], "left_anti").select(*docs.columns)
    shared = block_phrases(items, 0, 1, window)

    @B.tidy
    def run(batches):
        phrases = shared.value
        for rb in batches:
            raw, offs = B.buffer_of(rb.column("text"))
            n_words, row, first, which = shard_hits(phrases, raw, offs)
            hit = np.zeros(rb.num_rows, dtype=np.int64)
            size = phrases.sizes[which] if len(which) else which
            at = np.repeat(first, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            own = np.repeat(row, size)
            if len(own):
                hit = np.bincount(np.unique(np.stack((own, at)), axis=1)[0], minlength=rb.num_rows)
            yield rb.filter(pa.array(~((hit > 0) & (share * hit >= n_words))))

    return docs.mapInArrow(run, docs.schema)
