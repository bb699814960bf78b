"""URL filters: rules first, then logistic regression on hashed character n-grams.

Rules are exact: a rule fits its host and all subdomains where the URL's path starts with the
rule's path, and the longest rule wins.  URLs that no rule fits are judged by a logistic
regression over hashed 3- to 5-grams of host and path.  It is trained from a small table of
labelled URLs: by default at most `max_labelled` of the pages' own different URLs on which a
rule decides, half of either verdict, those of least hash, so training rows are bounded, the
same on every run, and of both verdicts wherever both are there.

Null URLs, and those without "://", have empty host and path, fit no rule and get the
model's verdict on empty text.  Without labelled rows the model allows everything.  Repeated
page_ids and rows stay as they are; other columns are passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import few_by_hash

#: Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
GRAMS, BUCKET_BITS, MAX_LABELLED = (3, 4, 5), 12, 2000

OUT = "page_id long, host string, path string, rule string, verdict string, score double"
OUT_PA = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("host", "path", "rule", "verdict")), ("score", pa.float64())])

PARTS = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, ruled): ruled is the verdict of the longest rule that fits, or null."""
    # the first "://" must come before anything else is cut: the prefix is matched lazily
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    d = pages.select(F.col("page_id").cast("long"), F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER).alias("host"), F.regexp_extract(url, PARTS, 2).alias("path"))
    fits = lambda host, path: ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        rule = F.when(fits(host, path), F.lit(host + path)).otherwise(rule)
        ruled = F.when(fits(host, path), F.lit(verdict)).otherwise(ruled)
    return d.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"))


def gram_buckets(hosts: pa.Array, paths: pa.Array, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram; host and path are set apart by a mark each."""
    text = pa.array([f"^{h}$ ^{p}$" for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)], pa.string())
    raw, offs = B.buffer_of(text)
    rows, buckets = [], []
    for lo, hi in B.slabs(offs):
        o = offs[lo : hi + 1] - offs[lo]
        roll = B.Rolling(B.CODES[0][raw[offs[lo] : offs[hi]]], 0)
        row = np.repeat(np.arange(hi - lo), np.diff(o))
        for n in GRAMS:
            if len(row) < n:
                continue
            h = roll.every(n)
            own = row[: len(h)]
            ok = own == row[n - 1 :]
            rows.append(own[ok] + lo)
            buckets.append((h[ok] >> np.uint64(64 - bits)).astype(np.int64))
    z = np.zeros(0, np.int64)
    return np.concatenate(rows or [z]), np.concatenate(buckets or [z])


def train(hosts: list[str], paths: list[str], blocked: list[bool], bits: int = BUCKET_BITS, rounds: int = 300, rate: float = 4.0, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) of the log-odds of block; gradient descent over the whole small table."""
    w, bias = np.zeros(1 << bits), 0.0
    y = np.array(blocked, dtype=float)
    if not len(y):
        return w, -1.0
    if y.min() == y.max():
        return w, 1.0 if y[0] else -1.0
    row, bucket = gram_buckets(pa.array(hosts), pa.array(paths), bits)
    size = np.sqrt(np.bincount(row, minlength=len(y)))[row]
    cls = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both classes weigh the same
    for _ in range(rounds):
        z = np.bincount(row, w[bucket] / size, minlength=len(y)) + bias
        err = cls * (1 / (1 + np.exp(-z)) - y) / len(y)
        w -= rate * (np.bincount(bucket, err[row] / size, minlength=len(w)) + ridge * w)
        bias -= rate * err.sum()
    return w, float(bias)


def _judge(w: np.ndarray, bias: float):
    bits = len(w).bit_length() - 1

    @B.tidy
    def run(batches):
        for rb in batches:
            n = rb.num_rows
            hosts, paths = rb.column("host"), rb.column("path")
            row, bucket = gram_buckets(hosts, paths, bits)
            grams = np.maximum(np.bincount(row, minlength=n), 1)
            z = np.bincount(row, w[bucket], minlength=n) / np.sqrt(grams) + bias
            verdict = [r if r is not None else "block" if s > 0 else "allow" for r, s in zip(rb.column("ruled").to_pylist(), z.tolist(), strict=True)]
            yield B.batch(OUT_PA, rb.column("page_id"), hosts, paths, rb.column("rule"), pa.array(verdict, pa.string()), pa.array(1 / (1 + np.exp(-z))))

    return run


def filter_urls(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; score is the model's odds of block.

    `labelled` has host, path and blocked (boolean); at most `max_labelled` rows are used.
    """
    d = with_rules(pages, rules)
    if labelled is None:
        labelled = d.filter("ruled IS NOT NULL").select("host", "path", (F.col("ruled") == "block").alias("blocked"))
    few = few_by_hash(labelled, ["host", "path", "blocked"], max_labelled, "blocked").collect()
    w, bias = train([r.host for r in few], [r.path for r in few], [r.blocked for r in few])
    return d.mapInArrow(_judge(w, bias), OUT)
