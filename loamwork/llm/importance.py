"""Importance resampling towards a target text: hashed n-gram features and Gumbel top-k.

Texts are cut into words by the tokenizers library's Split over a regular expression, which
needs no training; it gives each word's byte offsets in the text with A-Z lowered.  Windows
of 1 to `n` adjacent offset pairs are the features, a feature's bucket is the CRC-32 of its words
joined by one space, modulo `buckets`.  The CRC of a window comes from those of its words, so
no window is spelled out.

The corpus is tokenised once: each document's buckets and their counts are written to the
shared folder, and both the histogram and the sums of gains read them from there.  The histograms have
`buckets` rows; they alone come to the driver, where gains are made of them.

A document's key is its summed gain per feature plus Gumbel noise from a keyed digest of its
id; the highest keys are drawn, which is sampling without replacement by weight.  The order
is found by ranges, no task holds all documents.

A null text has no words.  Documents without features weigh 0.  A null doc_id is written as
an empty string where it is digested; rows of null or repeated ids are documents of their
own, ties go to smaller ids (nulls first) and then to an order of texts that reruns repeat.
Malformed UTF-8 counts as U+FFFD.  Empty tables give no rows; an empty target leaves smoothed
gains.  Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import positioned
from . import bytesops as B
from . import crc
from .common import staged, with_rid

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N, BUCKETS, SEED, LEAST, PERCENT, SCALE = 2, 10_000, 7, 20, 25, 1000
#: Bytes that are no part of a word, and what A-Z become.
APART = np.ones(256, dtype=bool)
APART[48:58] = APART[97:123] = APART[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PIECE = 1 << 18

FEATURES = "rid long, doc_id long, n_words long, n_features long, buckets binary, times binary"
FEATURES_PA = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary()), ("times", pa.binary())])
HIST_PA = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
WEIGHTS = "rid long, doc_id long, n_words long, n_features long, weight long"
WEIGHTS_PA = pa.schema([(c, pa.int64()) for c in ("rid", "doc_id", "n_words", "n_features", "weight")])


def splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORDS), "removed", invert=True)


def word_offsets(low: np.ndarray, split) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) in bytes of the words of lowered bytes, a piece at a time; no word is cut."""
    from tokenizers import PreTokenizedString

    starts, ends, lo = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while lo < len(low):
        hi = min(lo + PIECE, len(low))
        while hi < len(low) and not APART[low[hi]]:
            hi += 1
        piece = PreTokenizedString(str(memoryview(low[lo:hi]), "utf-8"))
        split.pre_tokenize(piece)
        at = np.fromiter((x for _, pair, _ in piece.get_splits("original", "byte") for x in pair), dtype=np.int64).reshape(-1, 2) + lo
        starts.append(at[:, 0])
        ends.append(at[:, 1])
        lo = hi
    return np.concatenate(starts), np.concatenate(ends)


def window_crcs(low: np.ndarray, s: np.ndarray, e: np.ndarray, row: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1 to n words: (CRC-32 of each window's words joined by one space, its row)."""
    word = crc.of_spans(low, s, e)
    out, run = [(word, row)], word
    for k in range(1, n):
        if len(s) <= k:
            break
        run = crc.joined(crc.with_space(run[:-1]), word[k:], low, s[k:], e[k:])
        own = row[k:] == row[:-k]
        out.append((run[own], row[k:][own]))
    return out


def features_of(raw: np.ndarray, offs: np.ndarray, n: int, buckets: int, split):
    """(words of each row, features, flat buckets, counts, bounds): the distinct buckets of each row of a slab."""
    rows = len(offs) - 1
    # rows are set apart by a line feed, so that no word runs from one into the next
    at = offs + np.arange(rows + 1)
    low = np.full(int(at[-1]), 10, dtype=np.uint8)
    low[np.arange(len(raw)) + np.repeat(np.arange(rows), np.diff(offs))] = LOWER[raw]
    s, e = word_offsets(low, split)
    row = np.searchsorted(at, s, side="right") - 1
    found = window_crcs(low, s, e, row, n)
    key = np.concatenate([r.astype(np.int64) * buckets + c % np.uint32(buckets) for c, r in found])
    key, times = np.unique(key, return_counts=True)
    bounds = np.searchsorted(key, np.arange(rows + 1) * buckets)
    return np.bincount(row, minlength=rows), sum(np.bincount(r, minlength=rows) for _, r in found), key % buckets, times, bounds


def feature_rows(docs: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """(rid, doc_id, n_words, n_features, buckets, times) of (rid, doc_id, text): distinct buckets ascending as
    differences, and how often each stands; packed 32-bit numbers."""

    @B.tidy
    def run(batches):
        split = splitter()
        for rb in batches:
            raw, offs = B.buffer_of(rb.column(2))
            for lo, hi in B.slabs(offs):
                part, o = crc.valid_utf8(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                words, many, flat, times, at = features_of(part, o, n, buckets, split)
                step = np.diff(flat, prepend=0)
                first = at[:-1][at[1:] > at[:-1]]
                step[first] = flat[first]
                pack = lambda x: pa.array([x[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())  # noqa: B023, E731
                yield B.batch(FEATURES_PA, rb.column(0).slice(lo, hi - lo), rb.column(1).slice(lo, hi - lo), B.long_col(words), B.long_col(many), pack(step), pack(times))

    return docs.mapInArrow(run, FEATURES)


def unpacked(rb: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, counts, number of buckets of each row) of a batch of feature rows."""
    step, times = (np.frombuffer(B.buffer_of(rb.column(c))[0].tobytes(), "<u4").astype(np.int64) for c in ("buckets", "times"))
    n = np.diff(B.buffer_of(rb.column("buckets"))[1]) // 4
    total = np.cumsum(step)
    start = np.cumsum(n) - n
    before = np.append(0, total)[start]
    return total - np.repeat(before, n), times, n


def histogram(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of each bucket over all rows; one row per bucket reaches the driver."""

    @B.tidy
    def run(batches):
        held = np.zeros(buckets, dtype=np.int64)
        for rb in batches:
            bucket, times, _ = unpacked(rb)
            np.add.at(held, bucket, times)
        at = np.flatnonzero(held)
        yield B.batch(HIST_PA, pa.array(at.astype(np.int32)), B.long_col(held[at]))

    out = np.zeros(buckets, dtype=np.int64)
    for r in features.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * ln of the ratio of smoothed shares) of each bucket, in doubles."""
    b, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(scale * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """(rid, doc_id, n_words, n_features, weight): the floored mean of gains over the features, 0 without any."""

    @B.tidy
    def run(batches):
        for rb in batches:
            bucket, times, n = unpacked(rb)
            total = np.append(0, np.cumsum(gain[bucket] * times))
            end = np.cumsum(n)
            many = np.asarray(rb.column("n_features"))
            w = np.where(many > 0, (total[end] - total[end - n]) // np.maximum(many, 1), 0)
            yield B.batch(WEIGHTS_PA, rb.column("rid"), rb.column("doc_id"), rb.column("n_words"), rb.column("n_features"), B.long_col(w))

    return features.mapInArrow(run, WEIGHTS)


def scored(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, seed: int = SEED) -> tuple[DataFrame, DataFrame, str]:
    """((rid, doc_id, n_words, n_features, weight, score), the rows with their rid column, its name)."""
    rows, rid = with_rid(docs)
    text, none = F.col("text").cast("string").alias("text"), F.lit(None).cast("long")
    own = staged(feature_rows(rows.select(F.col(rid).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text), n, buckets), "features")
    aim = feature_rows(target.select(none.alias("rid"), none.alias("doc_id"), text), n, buckets)
    weighed = weights(own, gains(histogram(own, buckets), histogram(aim, buckets)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise), rows, rid


def ranked(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, seed: int = SEED, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): every row of docs; the drawn ones are ranked from 1."""
    return _ranked(docs, target, n, buckets, seed, least, percent)[0].select("doc_id", "n_features", "weight", "score", "rank")


def _ranked(docs, target, n, buckets, seed, least, percent):
    all_, rows, rid = scored(docs, target, n, buckets, seed)
    all_ = staged(all_, "scored")
    fits = F.col("n_words") >= least
    drawn = all_.filter(fits).count() * percent // 100
    placed = positioned(all_.filter(fits).withColumn("__low", -F.col("score")), ["__low", "doc_id", "rid"]).withColumn("rank", F.when(F.col("__pos") <= drawn, F.col("__pos")).cast("long")).drop("__low", "__pos")
    return placed.unionByName(all_.filter(~fits).withColumn("rank", F.lit(None).cast("long"))), rows, rid


def resample(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, seed: int = SEED, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """The drawn rows of docs with all their columns."""
    found, rows, rid = _ranked(docs, target, n, buckets, seed, least, percent)
    return rows.join(found.filter("rank IS NOT NULL").select(F.col("rid").alias("__drawn")).hint("merge"), F.col(rid) == F.col("__drawn"), "left_semi").select(*docs.columns)
