"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes (position, value).  Two fingerprints that differ in
at most 4 bits differ in at most 4 bytes, so they share at least 4 of the 8 positional bytes:
the guaranteed minimum.  Posting lists of single bytes would each hold a 256th of all
documents and tallies over them grow with the square of the corpus, so the lists are kept
under three positional bytes: of every 4 shared bytes, one of 20 chosen triples is among
them (a (8,4,3) Turan system).  Pairs that meet on a list have their shared bytes tallied
over all eight positions, those below the minimum go (a pair found by several triples is one
pair from there on), and the rest are verified by Hamming distance.

A list longer than `long_list` isn't paired off.  Its members differ in 5 bytes at most, and
two of them are within 4 bits exactly if some point is within 2 bits of both; each member is
sent to the 821 points around it, and all that meet at a point are linked to the least one
there.  Such links are right (two at one point differ in 4 bits or fewer) and none is lost.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .common import staged, with_rid

BITS, SHINGLE, SEED, LONG_LIST = 4, 4, 42, 256
PIECE, LONG = 1 << 16, 1 << 20
GAP = re.compile(rb"[\x09-\x0d\x20]")
FP_PA = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def triples() -> list[tuple[int, int, int]]:
    """Triples of 8 positions such that any 4 positions contain one."""
    part = [0, 0, 0, 1, 1, 1, 2, 2]
    wanted = {(0, 0, 0), (1, 1, 1), (0, 0, 1), (1, 1, 2), (0, 2, 2)}
    return [t for t in combinations(range(8), 3) if tuple(sorted(part[i] for i in t)) in wanted]


def word_runs(text: bytes, size: int):
    """Lists of words of a text, each of LONG bytes or so, the last size - 1 of one again in the next."""
    lo, kept = 0, []
    while lo < len(text):
        gap = GAP.search(text, lo + LONG)
        hi = gap.start() if gap else len(text)
        words = kept + text[lo:hi].lower().split()  # of bytes: A-Z and ASCII white space only
        lo = hi
        if len(words) >= size or lo == len(text):
            yield words
            kept = words[len(words) - size + 1 :] if size > 1 else []
        else:
            kept = words


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles of a text, as an unsigned 64-bit number."""
    h = xxhash.xxh64_intdigest
    total, count = np.zeros(64, dtype=np.int64), 0
    for words in word_runs(text, size):
        if not words or count and len(words) < size:
            continue
        flat = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = max(len(words) - size + 1, 1)
        count += n
        s, e = starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist()
        for lo in range(0, n, PIECE):
            hashes = np.array([h(flat[x:y], seed) for x, y in zip(s[lo : lo + PIECE], e[lo : lo + PIECE], strict=True)], dtype="<u8")
            bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").view("<u8").reshape(-1, 8)
            # 255 ones fit a byte: eight counters are added at once
            total += np.add.reduceat(bits, np.arange(0, len(hashes), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0]) if count else 0


def _fingerprints(size: int, seed: int):
    @B.tidy
    def run(batches):
        for rb in batches:
            raw, offs = B.buffer_of(rb.column(1))
            out = [fingerprint(raw[offs[i] : offs[i + 1]].tobytes(), size, seed) for i in range(rb.num_rows)]
            yield B.batch(FP_PA, rb.column(0), B.long_col(np.array(out, dtype=np.uint64)))

    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): one row per row of docs; fp holds the 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints(size, seed), "doc_id long, fp long")


def shared_bytes(x):
    """Number of equal positional bytes of two fingerprints, from their exclusive or."""
    one = [F.when(x.bitwiseAND(F.lit((255 << 8 * i) if i < 7 else -(1 << 56))) == 0, 1).otherwise(0) for i in range(8)]
    total = one[0]
    for y in one[1:]:
        total = total + y
    return total


def links(prints: DataFrame, bits: int = BITS, long_list: int = LONG_LIST) -> DataFrame:
    """(u, v), u < v: links between different fingerprints that span the same components.

    `prints` has distinct non-null fp.  Linked fingerprints on short lists are all returned;
    on long lists a spanning star per meeting point.
    """
    if bits != 4:
        raise ValueError("the index guarantees 4 shared bytes for 4 differing bits only")
    sets = triples()
    masks = [sum(255 << 8 * i for i in t) for t in sets]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    posts = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "part"))
    # what matters is only whether a key is alone, on a short list or on a long one
    sizes = posts.groupBy("t", "part").count().filter("count > 1").withColumnRenamed("t", "t2").withColumnRenamed("part", "part2")
    met = posts.join(sizes.hint("merge"), (F.col("t") == F.col("t2")) & (F.col("part") == F.col("part2"))).select("t", "part", "fp", "count")
    met = staged(met, "postings")
    short = met.filter(F.col("count") <= long_list)
    a, b = short.select("t", "part", F.col("fp").alias("u")), short.select(F.col("t").alias("t2"), F.col("part").alias("part2"), F.col("fp").alias("v"))
    x = F.col("u").bitwiseXOR(F.col("v"))
    pairs = a.join(b.hint("merge"), (F.col("t") == F.col("t2")) & (F.col("part") == F.col("part2")) & (F.col("u") < F.col("v")) & (shared_bytes(x) >= 8 - bits)).select("u", "v").distinct()
    pairs = pairs.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)
    far = met.filter(F.col("count") > long_list)
    free = [[b for b in range(64) if b // 8 not in t] for t in sets]
    near = [[0, *(1 << i for i in f), *((1 << i) | (1 << j) for i, j in combinations(f, 2))] for f in free]
    near = [[m - (1 << 64) if m >> 63 else m for m in ms] for ms in near]
    steps = prints.sparkSession.createDataFrame(list(enumerate(near)), "t2 int, steps array<long>")
    points = far.join(F.broadcast(steps), F.col("t") == F.col("t2")).select("fp", "t", F.explode(F.transform("steps", lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    stars = points.withColumn("u", F.min("fp").over(Window.partitionBy("t", "point"))).filter("u < fp").select("u", F.col("fp").alias("v"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): connected components by alternating large and small stars.

    Every round is staged in the shared folder; the loop ends when a round changes nothing.
    """
    e = staged(edges.select("u", "v"), "edges")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(m.hint("merge"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u > v holds in every row now
        m = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        joined = large.join(m.hint("merge"), F.col("u") == F.col("w"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = staged(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    component_id is the smallest doc_id whose fingerprint is reachable over links of 4
    differing bits or fewer.  Texts without words, nulls included, have fingerprint zero.
    Equal fingerprints make one class, so copies meet no one but their class.  A null
    doc_id is never smallest unless its component has no other.
    """
    marked = staged(fingerprints(docs), "prints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(classes.select("fp"), long_list=long_list))
    rooted = classes.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = staged(rooted, "rooted")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id")).withColumnRenamed("root", "r2")
    of = rooted.join(lows.hint("merge"), F.col("root") == F.col("r2")).select(F.col("fp").alias("fp2"), "component_id")
    return marked.join(of.hint("merge"), F.col("fp") == F.col("fp2")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, long_list: int = LONG_LIST, words: int | None = None, similarity: float | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that come first (by doc_id) in their component.

    Without a similarity, fingerprints link by their bits; with one, sets of `words`-word
    shingles link by Jaccard similarity, through the same index over longer sketches
    (see `near_copies`).
    """
    if similarity is not None:
        from .near_copies import WORDS, one_of_each_set

        return one_of_each_set(docs, words or WORDS, similarity)
    rows, rid = with_rid(docs)
    found = near_duplicates(rows.select(F.col(rid).alias("doc_id"), "text"), long_list)
    first = found.filter("doc_id = component_id").select(F.col("doc_id").alias("__first")).hint("merge")
    return rows.join(first, rows[rid] == first["__first"], "left_semi").select(*docs.columns)
