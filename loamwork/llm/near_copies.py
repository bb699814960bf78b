"""Near copies by word shingles: the positional index of `simhash`, for a Jaccard similarity.

Texts are compared as sets of `words`-word shingles (lower case, ASCII white space; a shorter
text is one shingle).  Equal sets make one class, and only its smallest rid goes on.

First come SimHash fingerprints of these shingles: what `simhash.links` finds in its index of
byte positions (shared bytes counted, at most 4 bits apart), and what has one fingerprint, is
verified on whole sets and linked.

A SimHash of 64 bits can't promise a byte for pairs at 0.8 (they differ in 3 to 13 bits), so
pairs further apart go by a second index of 72 positions of min-wise shingles, each equal with
the probability of the similarity, of lists that SimHash's links leave apart.  Posting
lists are kept under three positions at a time, 24 lists a text: a pair at 0.8 meets on none
with probability 3e-8.  Pairs that meet have their shared positional
bytes tallied, those below the minimum `LEAST` go (at 0.8, another 7e-10), and what is left
is verified on whole sets.

A list isn't paired off.  Its members meet its leader, the member whose own lists are longest
(so the nearest to the middle of a group of near copies); verified links make components.
Then only members outside a list's largest component are compared with its members of other
components, by blocks of a bounded number of shingles, and what leaves a block are links
that join components, never pairs.  A pair is compared on its first common list only.

Texts without words, nulls included, are one class.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import BROADCAST_IDS, staged, with_rid
from .simhash import components, fingerprint, links

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 3
#: Shared bytes of 72 that a pair must reach: at similarity 0.8 it has 57.6 on average.
LEAST = 35
#: Shingles in a block of a list, pairs compared at once, and members taken up at once.
BLOCK, PAIRS, STEP = 1 << 20, 1 << 16, 2000
_rng = np.random.default_rng(20240611)
TIMES = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FLIPS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SIG = "rid long, k1 long, k2 long, n long, fp long, bands array<long>, sketch binary"
SIG_PA = pa.schema([*[(c, pa.int64()) for c in ("rid", "k1", "k2", "n", "fp")], ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
SET = "rid long, g array<long>"
SET_PA = pa.schema([("rid", pa.int64()), ("g", pa.list_(pa.int64()))])
TWO_PA = {c: pa.schema([(x, pa.int64()) for x in c]) for c in (("u", "v"), ("key", "rid"))}


def shingles(raw: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the shingles of the texts of one slab."""
    low = LOWER[raw]
    s, e, row = B.word_spans(low, offs)
    n = np.bincount(row, minlength=len(offs) - 1)
    at = np.append(0, np.cumsum(n))
    m = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    bounds = np.append(0, np.cumsum(m))
    doc = np.repeat(np.arange(len(n)), m)
    start = at[doc] + np.arange(bounds[-1]) - bounds[doc]
    word = B.span_hashes(low, s, e)
    return B.Rolling(word, 1).of(start, np.minimum(start + words, at[doc + 1])), bounds


def sketches_of(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the posting lists, positional bytes): a row for each text that has shingles."""
    first = bounds[:-1][bounds[1:] > bounds[:-1]]
    keys, sketch = np.empty((len(first), BANDS), dtype=np.uint64), np.empty((len(first), BANDS * ROWS), dtype=np.uint8)
    for b in range(BANDS):
        x = np.full(len(first), b, dtype=np.uint64)
        for r in range(b * ROWS, (b + 1) * ROWS):
            least = np.minimum.reduceat((h ^ FLIPS[r]) * TIMES[r], first)
            x = B.mix(x) ^ least
            sketch[:, r] = B.mix(least).astype(np.uint8)
        keys[:, b] = B.mix(x)
    return keys, sketch


def lists(sizes, values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), B.long_col(flat.ravel()))


def _per_slab(words: int, make):
    """One output batch for each slab, so that lists stay short."""

    @B.tidy
    def run(batches):
        for rb in batches:
            rid = np.asarray(rb.column(0)).astype(np.int64)
            raw, offs = B.buffer_of(rb.column(1))
            for lo, hi in B.slabs(offs):
                h, bounds = shingles(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], words)
                texts = (raw[offs[i] : offs[i + 1]].tobytes() for i in range(lo, hi))
                yield make(rid[lo:hi], h, bounds, [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], (fingerprint(t, words) for t in texts))

    return run


def _signed(rid, h, bounds, sets, prints):
    k = np.frombuffer(b"".join(hashlib.blake2b(g.tobytes(), digest_size=16).digest() for g in sets), dtype=np.uint64).reshape(-1, 2)
    n = np.array([len(g) for g in sets])
    keys, sketch = sketches_of(h, bounds) if len(h) else (np.zeros((0, BANDS), np.uint64), np.zeros((0, BANDS * ROWS), np.uint8))
    rows = iter(sketch)
    return B.batch(SIG_PA, B.long_col(rid), B.long_col(k[:, 0].copy()), B.long_col(k[:, 1].copy()), B.long_col(n), B.long_col(np.fromiter(prints, dtype=np.uint64, count=len(sets))), lists(np.where(n > 0, BANDS, 0), [keys]), pa.array([next(rows).tobytes() if x else b"" for x in n], pa.binary()))


def _sets(rid, h, bounds, sets, _):
    return B.batch(SET_PA, B.long_col(rid), lists([len(g) for g in sets], sets))


def matrix(col: pa.Array, width: int) -> np.ndarray:
    """The rows of a binary column of equal lengths."""
    return B.buffer_of(col)[0].reshape(-1, width)


def _tally(batches):
    """(u, v) of the pairs whose sketches share the least number of positional bytes."""
    for rb in batches:
        same = (matrix(rb.column(2), BANDS * ROWS) == matrix(rb.column(3), BANDS * ROWS)).sum(axis=1)
        yield pa.RecordBatch.from_arrays(list(rb.filter(pa.array(same >= LEAST)).columns[:2]), schema=TWO_PA["u", "v"])


def of_ids(rows: DataFrame, ids: DataFrame, how: str = "left_semi", rid: str = "rid") -> DataFrame:
    """The rows whose rid is (or, left_anti, isn't) among staged ids (column __x).

    Ids are broadcast only after they were counted: longs, so their size is proven with it.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    ids = ids.hint("broadcast" if few else "merge")
    return rows.join(ids, rows[rid] == ids["__x"], how)


def sets_of(rows: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(rid, g): the staged shingle sets of the texts of these ids."""
    ids = staged(ids, "ids")
    return staged(of_ids(rows.select("rid", "text"), ids).mapInArrow(_per_slab(words, _sets), SET), "sets")


def verified(rows: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have at least this Jaccard similarity."""
    pairs = staged(pairs.distinct(), "candidates")
    sets = sets_of(rows, pairs.select(F.explode(F.array("u", "v")).alias("__x")).distinct(), words)
    a, b = sets.select(F.col("rid").alias("ra"), F.col("g").alias("ga")), sets.select(F.col("rid").alias("rb"), F.col("g").alias("gb"))
    met = pairs.join(a.hint("merge"), F.col("u") == F.col("ra")).join(b.hint("merge"), F.col("v") == F.col("rb"))
    k = F.size(F.array_intersect("ga", "gb"))
    return met.select("u", "v", k.alias("k"), (F.size("ga") + F.size("gb")).alias("n")).filter(F.col("k") / (F.col("n") - F.col("k")) >= similarity).select("u", "v")


class Rows:
    """Members of lists, sorted by (key, block, side), as arrays."""

    def __init__(self, t: pa.Table):
        col = lambda c: np.asarray(t.column(c).combine_chunks()).astype(np.int64)
        self.key, self.block, self.side, self.rid, self.root, self.n = map(col, ("key", "block", "side", "rid", "root", "n"))
        self.sketch = matrix(t.column("sketch"), BANDS * ROWS)
        self.bands = np.asarray(t.column("bands").combine_chunks().flatten()).reshape(-1, BANDS)
        self.words = None
        if "g" in t.column_names:
            _, self.words = np.unique(np.asarray(t.column("g").combine_chunks().flatten()), return_inverse=True)
            self.at = np.append(0, np.cumsum(self.n))
            self.seen = np.zeros(int(self.words.max()) + 1 if len(self.words) else 0, dtype=np.int64)

    def pairs(self, carried: int, similarity: float):
        """(u, w) by chunks: pairs of different components on their first common list."""
        start = np.flatnonzero(np.append(True, (self.key[1:] != self.key[:-1]) | (self.block[1:] != self.block[:-1])))
        end = np.append(start[1:], len(self.key))
        u = np.flatnonzero(self.side == 0)
        stop = end[np.searchsorted(start, u, side="right") - 1]
        first = np.where(u < carried, carried, u + 1)  # carried ones have met before
        many = np.maximum(stop - first, 0)
        total = np.cumsum(many)
        lo = 0
        while lo < len(u):
            hi = max(int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, side="right")), lo + 1)
            m = many[lo:hi]
            a = np.repeat(u[lo:hi], m)
            w = np.repeat(first[lo:hi] - np.cumsum(m) + m, m) + np.arange(len(a))
            lo = hi
            ok = (self.root[a] != self.root[w]) & ((self.side[w] != 1) | (self.rid[a] < self.rid[w]))
            ok &= np.minimum(self.n[a], self.n[w]) >= similarity * np.maximum(self.n[a], self.n[w])
            a, w = a[ok], w[ok]
            common = (self.bands[a] == self.bands[w]).argmax(axis=1)
            ok = self.bands[a, common] == self.key[a]
            a, w = a[ok], w[ok]
            ok = (self.sketch[a] == self.sketch[w]).sum(axis=1) >= LEAST
            yield a[ok], w[ok]

    def linked(self, a: np.ndarray, w: np.ndarray, similarity: float) -> np.ndarray:
        """True where the sets of a pair have this similarity; a ascends."""
        out = np.zeros(len(a), dtype=bool)
        if not len(a):
            return out
        cut = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        for lo, hi in zip(cut, np.append(cut[1:], len(a)), strict=True):
            own = self.words[self.at[a[lo]] : self.at[a[lo] + 1]]
            self.seen[own] = 1
            n = self.n[w[lo:hi]]
            bounds = np.cumsum(n) - n
            at = np.repeat(self.at[w[lo:hi]] - bounds, n) + np.arange(int(n.sum()))
            k = np.add.reduceat(self.seen[self.words[at]], bounds)
            self.seen[own] = 0
            out[lo:hi] = k / (len(own) + n - k) >= similarity
        return out


def joining(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links that join what the ones before them left apart."""
    root: dict[int, int] = {}

    def find(x):
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for x, y in np.unique(np.stack((a, b), axis=1), axis=0).tolist() if len(a) else []:
        x2, y2 = find(x), find(y)
        if x2 != y2:
            root[y2] = x2
            out.append((x, y))
    return out


def _compare(similarity: float, exact: bool):
    """Exact: links (u, v) between components; else the (key, rid) of members that have a partner."""
    names = ("u", "v") if exact else ("key", "rid")

    @B.tidy
    def run(batches):
        held = None
        for rb in (b.slice(at, STEP) for b in batches for at in range(0, b.num_rows, STEP)):
            t = pa.Table.from_batches([rb])
            carried = held.num_rows if held is not None else 0
            if carried:
                t = pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            r = Rows(t)
            found = [np.zeros((0, 2), np.int64)]
            for a, w in r.pairs(carried, similarity):
                if exact:
                    ok = r.linked(a, w, similarity)
                    found.append(np.array(joining(r.root[a[ok]], r.root[w[ok]]), dtype=np.int64).reshape(-1, 2))
                else:
                    x = np.unique(np.append(a, w))
                    found.append(np.stack((r.key[x], r.rid[x]), axis=1))
            out = np.unique(np.concatenate(found), axis=0)
            yield B.batch(TWO_PA[names], B.long_col(out[:, 0].copy()), B.long_col(out[:, 1].copy()))
            held = t.filter(pa.array((r.key == r.key[-1]) & (r.block == r.block[-1]) & (r.side == 0)))

    return run


def dealt(members: DataFrame, least: int) -> DataFrame:
    """Members (key, rid, root, n, ...) of lists over several components, by blocks.

    Side 0 are the block's own members, which meet all others: 1, members that are some other
    block's own, and 2, those of the list's largest component.
    """
    roots = members.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    of = roots.groupBy("key").agg(F.max(F.struct("c", "root", "s")).alias("top"), F.sum("s").alias("s"), F.sum("c").alias("c"), F.count("*").alias("r")).filter((F.col("r") > 1) & (F.col("c") >= least))
    of = of.select(F.col("key").alias("key2"), F.col("top.root").alias("top"), F.ceil((F.col("s") - F.col("top.s")) / BLOCK).cast("int").alias("blocks"))
    met = members.join(of.hint("merge"), F.col("key") == F.col("key2")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = F.pmod(F.xxhash64("rid"), F.col("blocks")) == F.col("block")
    met = met.withColumn("side", F.when(F.col("root") == F.col("top"), 2).when(own, 0).otherwise(1)).drop("key2", "top", "blocks")
    return met.repartition("key", "block").sortWithinPartitions("key", "block", "side")


def simhash_links(rows: DataFrame, classes: DataFrame, words: int, similarity: float) -> DataFrame:
    """(u, v): texts that SimHash's index brings together and whose sets have this similarity.

    Texts of one fingerprint stand beside the smallest rid that has it, which also stands for
    the fingerprint in its links.
    """
    prints = staged(classes.groupBy("fp").agg(F.min("rid").alias("low")), "prints")
    near = links(prints.select("fp"))
    of = lambda side: prints.select(F.col("fp").alias(f"fp_{side}"), F.col("low").alias(f"low_{side}")).hint("merge")
    apart = near.join(of("u"), F.col("u") == F.col("fp_u")).join(of("v"), F.col("v") == F.col("fp_v")).select(F.col("low_u").alias("u"), F.col("low_v").alias("v"))
    same = classes.select("rid", "fp").join(of("u"), F.col("fp") == F.col("fp_u")).filter("rid > low_u").select(F.col("low_u").alias("u"), F.col("rid").alias("v"))
    return verified(rows, apart.unionByName(same), words, similarity)


def firsts(rows: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(first): the smallest rid of each component; `rows` holds (rid, text) with unique rids."""
    marked = rows.mapInArrow(_per_slab(words, _signed), SIG)
    classes = staged(marked.groupBy("k1", "k2").agg(F.min(F.struct("rid", "n", "fp", "bands", "sketch")).alias("x")).select("x.*"), "classes")
    linked = staged(simhash_links(rows, classes, words, similarity), "simhash")
    # texts of one root are linked, if not all that are linked have one root
    known = linked.groupBy(F.greatest("u", "v").alias("node")).agg(F.min(F.least("u", "v")).alias("root"))
    roots = staged(classes.join(known.hint("merge"), F.col("rid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rid")).drop("node", "fp"), "roots")
    posts = roots.select("rid", "root", F.explode("bands").alias("key"))
    # lists of one text or of one root have nothing left to link
    sizes = posts.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select(F.col("key").alias("key2"), "size")
    met = posts.join(sizes.hint("merge"), F.col("key") == F.col("key2"))
    per = met.groupBy(F.col("rid").alias("rid2")).agg(F.sum("size").alias("weight"), F.collect_list("key").alias("keys"))
    found = staged(roots.join(per.hint("merge"), F.col("rid") == F.col("rid2")).drop("rid2"), "listed")
    places = found.select(F.explode("keys").alias("key"), "rid", "root", "n", "weight", "sketch")
    heads = places.groupBy(F.col("key").alias("key2")).agg(F.max(F.struct("weight", (-F.col("rid")).alias("back"), "root", "n", "sketch")).alias("l"))
    close = F.least("n", "l.n") >= F.greatest("n", "l.n") * similarity
    stars = places.join(heads.hint("merge"), F.col("key") == F.col("key2")).filter((F.col("root") != F.col("l.root")) & close)
    stars = stars.select("rid", (-F.col("l.back")).alias("v"), "sketch", F.col("l.sketch").alias("other")).mapInArrow(_tally, "u long, v long")
    edges = staged(linked.unionByName(verified(rows, stars, words, similarity)), "links")
    roots = components(edges)
    rooted = staged(found.drop("root").join(roots.hint("merge"), F.col("rid") == F.col("node"), "left").select("rid", "n", "bands", "sketch", "keys", F.coalesce("root", "rid").alias("root")), "rooted")
    # lists of two are a leader and one more, who have met
    members = rooted.select(F.explode("keys").alias("key"), "rid", "root", "n", "bands", "sketch")
    left = staged(dealt(members, 3).mapInArrow(_compare(similarity, False), "key long, rid long").distinct(), "left")
    sets = sets_of(rows, left.select(F.col("rid").alias("__x")).distinct(), words).withColumnRenamed("rid", "rid3")
    left = left.select(F.col("key").alias("key4"), F.col("rid").alias("rid4"))
    again = members.join(left.hint("merge"), (F.col("key") == F.col("key4")) & (F.col("rid") == F.col("rid4")), "left_semi")
    rest = dealt(again.join(sets.hint("merge"), F.col("rid") == F.col("rid3")).drop("rid3"), 2).mapInArrow(_compare(similarity, True), "u long, v long")
    later = components(edges.unionByName(rest)).filter("node <> root").select("node")
    return classes.select(F.col("rid").alias("first")).join(later.hint("merge"), F.col("first") == F.col("node"), "left_anti")


def one_of_each_set(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with all their columns, that come first (by doc_id) in their component."""
    rows, rid = with_rid(docs)
    kept = staged(firsts(rows.select(F.col(rid).alias("rid"), F.col("text").cast("string").alias("text")), words, similarity), "firsts")
    gone = staged(rows.select(F.col(rid).alias("__x")).join(kept.hint("merge"), F.col("__x") == F.col("first"), "left_anti"), "copies")
    return of_ids(rows, gone, "left_anti", rid).select(*docs.columns)
