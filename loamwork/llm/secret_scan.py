"""Secret scans: fixed patterns, and a randomness test battery over token-like strings.

Candidates of the battery are maximal runs of 20 and more base64 characters that hold a digit
and a letter.  Each is read in the encoding its characters imply (hexadecimal, base32 or
base64), and three tests ask whether its symbols could be random: chi-squared uniformity over
eight parts of the alphabet, the number of runs above and below the middle, and the
correlation of neighbours.  Fisher's method joins their p-values.

A high joint p-value speaks for a secret, and what has to be controlled are ordinary strings
among those reported.  So the null hypothesis is "ordinary": within each encoding and length
class, a candidate's p-value under it is the share of ordinary strings that look as random.
These come from the corpus itself, every whole document glued in the styles of identifiers, paths,
capital and hexadecimal runs and cut at a place that its digest gives, and from a fixed list of
names for corpora with little text.
The Benjamini-Hochberg rule then finds, from histograms over all documents, the least p-value
that keeps the expected share of ordinary strings among the reported ones at `rate`.  What
reaches it is a span of kind "random".  Candidates that meet a span of the fixed patterns
aren't tested.

Built-in functions only.  Null or empty texts have no spans.  Rows aren't joined on their id,
so repeated and null doc_ids are kept apart.  Other columns are passed over.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .spans import bind, located, total

#: Fixed patterns; hex and access with their least lengths written into them (a run that is
#: too short fails whole, so the same matches are left).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
RATE, PARTS, BINS = 0.1, 8, 400
#: Length classes, by their least length: each is tested against ordinary strings of that length.
LENGTHS = (20, 24, 28, 32, 40, 48, 64)

ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Words of ordinary names, and how many strings of each class they make.
NAMES = (
    "get user name list item value index count total page size width height color style font image path file folder start end first last next prev "
    "create update delete find load save read write open close send receive connect request response handler manager service factory builder config "
    "default option setting version module package library test report daily weekly backup archive invoice customer order product account address"
).split()
NAMED = 400
#: What every match of ASSIGN holds in lower case.
ASSIGNED = ("passw", "secret", "token", "api")


def upper_tail(z):
    """P(Z > z) of the standard normal distribution (Abramowitz and Stegun 26.2.17)."""

    def tail(z, t):
        poly = F.lit(0.0)
        for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
            poly = t * (poly + c)
        return bind(F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly, lambda q: F.when(z >= 0, q).otherwise(1 - q))

    return F.greatest(bind(z, lambda z: bind(1 / (1 + 0.2316419 * F.abs(z)), lambda t: tail(z, t))), F.lit(1e-15))


def chi_tail(x, df: int):
    """P(chi-squared with df > x), by the Wilson-Hilferty cube root."""
    return upper_tail((F.pow(x / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def uniformity(v, k):
    expected = F.size(v).cast("double") / PARTS
    counts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda j: F.size(F.filter(v, lambda x: F.floor(x * PARTS / k) == j)))
    return chi_tail(F.aggregate(counts, F.lit(0.0), lambda a, c: a + (c - expected) * (c - expected) / expected), PARTS - 1)


def changes(v, k):
    """Wald-Wolfowitz runs above and below the middle of the alphabet, two-sided."""

    def z(h, n1, n):
        runs = total(F.zip_with(F.slice(h, F.lit(2), F.size(h) - 1), F.slice(h, F.lit(1), F.size(h) - 1), lambda a, b: (a != b).cast("int"))) + 1
        return bind(2 * n1 * (n - n1) / n + 1, lambda mean: F.when(mean > 2, (runs - mean) / F.sqrt((mean - 1) * (mean - 2) / (n - 1))).otherwise(F.lit(8.0)))

    high = F.transform(v, lambda x: (x * 2 >= k).cast("int"))
    return 2 * upper_tail(F.abs(bind(high, lambda h: bind(total(h).cast("double"), lambda n1: z(h, n1, F.size(v).cast("double"))))))


def correlation(v):
    """Lag-one serial correlation, two-sided."""

    def r(d):
        square = F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x)
        product = F.aggregate(F.zip_with(F.slice(d, F.lit(2), F.size(d) - 1), F.slice(d, F.lit(1), F.size(d) - 1), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return bind(square, lambda q: F.when(q > 0, product / q).otherwise(F.lit(1.0)))

    d = bind(total(v) / F.size(v), lambda mean: F.transform(v, lambda x: x - mean))
    return 2 * upper_tail(F.abs(bind(d, r)) * F.sqrt(F.size(v).cast("double")))


def battery(v, k):
    """Joint p-value of the three tests over symbols v (array<int> in 0..k-1), by Fisher."""
    logs = [F.log(F.least(p, F.lit(1.0))) for p in (uniformity(v, k), changes(v, k), correlation(v))]
    return chi_tail(F.greatest(-2 * (logs[0] + logs[1] + logs[2]), F.lit(0.0)), 6)


def size_of(n):
    """Index of the length class of a string of n characters."""
    out = F.lit(0)
    for k, least in enumerate(LENGTHS):
        out = F.when(n >= least, k).otherwise(out)
    return out


def tested(token, kind):
    """The battery's p-value of a string read in an encoding."""
    alphabet = F.element_at(F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv]), kind)
    plain = F.when(kind == "hex", F.lower(token)).otherwise(F.translate(token, "-_", "+/"))
    v = bind(plain, lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.instr(alphabet, F.substr(t, i, F.lit(1))) - 1))
    return bind(v, lambda v: bind(F.length(alphabet), lambda k: battery(v, k)))


def examined(m):
    """struct(start, end, encoding, size class, p) of a located candidate."""
    kind = F.when(F.rlike(m["m"], F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$")), "hex").when(F.rlike(m["m"], F.lit("^[A-Z2-7]+$")), "base32").otherwise("base64")
    return bind(kind, lambda k: F.struct(m["start"].alias("start"), m["end"].alias("end"), k.alias("encoding"), size_of(F.length(m["m"])).alias("size"), tested(m["m"], k).alias("p")))


def styles(words):
    """array<struct<encoding, style, s>>: text of words and blanks glued as ordinary long strings are."""
    one = lambda kind, style, s: F.struct(F.lit(kind).alias("encoding"), F.lit(style).alias("style"), s.alias("s"))
    return F.array(
        one("base64", 0, F.replace(F.initcap(words), F.lit(" "), F.lit(""))),
        one("base64", 1, F.replace(F.lower(words), F.lit(" "), F.lit("_"))),
        one("base64", 2, F.replace(F.lower(words), F.lit(" "), F.lit("/"))),
        one("base32", 0, F.regexp_replace(F.upper(words), "[^A-Z2-7]", "")),
        one("hex", 0, F.regexp_replace(F.lower(words), "[^0-9a-f]", "")),
    )


def ordinary(docs: DataFrame) -> DataFrame:
    """(encoding, size, style, p) of ordinary strings: one of every document for each style, and the named ones.

    Candidates themselves are left out.  A document's text decides which length and which
    place it gives; copies give one string.
    """
    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    words = text.select(F.trim(F.regexp_replace(F.regexp_replace("text", CANDIDATE, " "), "[^A-Za-z0-9]+", " ")).alias("w"), "h")
    spark = docs.sparkSession
    names = F.array(*[F.lit(x) for x in NAMES])
    at = lambda k: F.get(names, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(NAMES))).cast("int"))
    named = spark.range(NAMED * len(LENGTHS)).select(F.concat_ws(" ", *[x for k in range(0, 60, 4) for x in (*[at(k + j) for j in range(4)], (F.col("id") % 97).cast("string"))]).alias("w"), F.col("id").alias("h"))
    size = F.pmod("h", F.lit(len(LENGTHS))).cast("int")
    glued = words.unionByName(named).select("h", size.alias("size"), F.get(F.array(*[F.lit(x) for x in LENGTHS]), size).alias("n"), F.explode(styles(F.col("w"))).alias("x"))
    glued = glued.filter(F.length("x.s") >= F.col("n"))
    place = F.pmod(F.shiftright("h", 8), F.length("x.s") - F.col("n") + 1).cast("int") + 1
    cut = glued.select("x.encoding", "size", "x.style", F.substr("x.s", place, F.col("n")).alias("s")).distinct()
    return cut.select("encoding", "size", "style", tested(F.col("s"), F.col("encoding")).alias("p"))


def bin_of(p):
    """Bins of equal width in log p, the smallest p first."""
    return F.least(F.greatest(F.floor((F.log(p) + 34.6) * BINS / 34.6).cast("int"), F.lit(0)), F.lit(BINS - 1))


def limits(found: DataFrame, null: DataFrame, rate: float):
    """One row, a map from (encoding, size) to the least reported bin; at most a few dozen entries.

    A candidate's p-value is the largest that any style of ordinary strings gives it.
    """
    c = found.select(F.explode("candidates").alias("c")).select("c.encoding", "c.size", F.lit(-1).alias("style"), bin_of(F.col("c.p")).alias("bin"))
    both = c.unionByName(null.select("encoding", "size", "style", bin_of(F.col("p")).alias("bin")))
    both = both.groupBy("encoding", "size", "bin").agg(*[F.count_if(F.col("style") == k).alias(f"k{k + 1}") for k in range(-1, 3)])
    by = Window.partitionBy("encoding", "size")  # at most BINS rows
    least = by.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    n = lambda k: F.sum(f"k{k}").over(by)
    share = F.greatest(*[F.when(n(k) > 0, (1 + F.sum(f"k{k}").over(least)) / (1 + n(k))).otherwise(0.0 if k > 1 else 1.0) for k in (1, 2, 3)])
    reported = F.sum("k0").over(least)
    ok = both.withColumn("ok", (reported > 0) & (share <= rate * reported / n(0))).filter("ok").groupBy("encoding", "size").agg(F.min("bin").alias("bin"))
    return ok.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "encoding", "size"), "bin"))).alias("limits"))


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of every row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = lambda a: F.transform(a, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    # the second group's length is what the match has beyond its own prefix
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2))
    mixed = lambda m: F.rlike(m["m"], F.lit("[0-9]")) & F.rlike(m["m"], F.lit("[A-Za-z]"))
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    # a match of HEX or ACCESS is part of a long run, one of ASSIGN holds a word: few texts are searched for them
    low = F.lower("text")
    word = reduce(or_, [F.contains(low, F.lit(x)) for x in ASSIGNED])
    text = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumns({"word": word, "run": F.rlike("text", F.lit(CANDIDATE))})
    where = lambda cond, pattern: F.when(cond, located(F.col("text"), pattern)).otherwise(none)
    found = text.select(
        "doc_id",
        bare(F.filter(where(F.col("word"), ASSIGN), lambda m: value(m["m"]) >= 6)).alias("assign"),
        bare(where(F.col("run"), ACCESS)).alias("access"),
        bare(where(F.col("run"), HEX)).alias("hex"),
        F.filter(where(F.col("run"), CANDIDATE), mixed).alias("candidates"),
    )
    apart = lambda m: ~F.exists(F.concat("assign", "access", "hex"), lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))
    found = found.withColumn("candidates", F.transform(F.filter("candidates", apart), examined))
    found = staged(found, "secrets")
    d = found.crossJoin(F.broadcast(limits(found, ordinary(docs), rate)))  # one row
    tagged = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    base = F.concat(*[tagged(k, i) for i, k in enumerate(("assign", "access", "hex"))])
    d = d.withColumn("base", F.array_sort(base))
    passed = F.filter("candidates", lambda c: bin_of(c["p"]) >= F.coalesce(F.element_at(F.col("limits"), F.concat_ws(":", c["encoding"], c["size"])), F.lit(BINS)))
    d = d.withColumn("random", tagged(passed, 3))
    names = F.array(*[F.lit(x) for x in ("assign", "access", "hex", "random")])
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    n = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return d.select("doc_id", n("assign"), n("access"), n("hex"), n("random"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "random"))).alias("spans"))
