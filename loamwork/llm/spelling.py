"""Spelling variants: words within one edit, found over a reduced alphabet.

Words come from maximal runs of Latin letters.  (As the contract asks, the run's digest with
its doc_id decides on a dropped letter first.)  Letters are hashed to a few symbols; a word
near another has a reduced word that is equal or one edit away, so every reduced word's full
one-edit neighbourhood (deletions, replacements and insertions over the few symbols) is
generated and joined with the reduced vocabulary.  What meets is verified on the words
themselves.  Nearness has no direction, so each pair of a neighbourhood is made from one of its
two words only: the longer makes its deletions, and of two equally long ones that with the
earlier symbol makes the replacement.  That leaves (symbols + 1) / 2 rows a letter at most.
More symbols make more rows but fewer chance meetings.  Their number follows the vocabulary's size, so
that reduced words of the shortest length outnumber the words and meetings stay a few per
word at any size; the result is the same for any number.

Neighbours travel as 64-bit hashes beside the word's number.  A very long word's are made and sent
in pieces.

Nulls and texts without letters have no words.  A null doc_id is written as an empty string
where it is digested.  Repeated rows count again, further columns are ignored, an empty table
gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from . import crc
from .common import staged

LEAST_LETTERS, LEAST_COUNT, DROP, TIMES = 7, 2, 31, 10
HELD, BLOCK, PIECE = 100_000, 1 << 21, 1 << 18
ROWS_PER_TASK = 20_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LEAD = 0xC3  # U+00C0 to U+00FF are this byte and one more
COUNT_PA = pa.schema([("word", pa.string()), ("n", pa.int64())])
KEY_PA = pa.schema([("key", pa.int64()), ("id", pa.int64())])


def letter_spans(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the runs of letters in one slab of lowered bytes."""
    apart = np.ones(len(low), dtype=np.uint8)
    lead = low == LEAD
    apart[(low >= 97) & (low <= 122) | lead] = 0
    apart[1:][lead[:-1]] = 0
    return B.word_spans(apart, offs, np.arange(256) == 1)


def counted(held: dict, raw: np.ndarray, offs: np.ndarray, prefixes: list[bytes], least: int, drop: int) -> None:
    """Add the words of a slab's rows to held: bytes -> occurrences."""
    low = LOWER[raw]
    s, e, row = letter_spans(low, offs)
    letters = e - s - np.diff(np.append(0, np.cumsum(low == LEAD))[np.stack((s, e))], axis=0)[0]
    fits = letters >= least
    s, e, row, letters = s[fits], e[fits], row[fits], letters[fits]
    if not len(s):
        return
    flat = low.tobytes()
    dropped = np.zeros(len(s), dtype=bool)
    if drop:
        first = np.array([zlib.crc32(p) for p in prefixes], dtype=np.uint32)
        h = crc.joined(first[row], crc.of_spans(low, s, e), low, s, e)
        dropped = h % np.uint32(drop) == 0
        for i in np.flatnonzero(dropped & (letters > least)).tolist():
            word = flat[s[i] : e[i]].decode()
            at = int(h[i]) % len(word)
            key = (word[:at] + word[at + 1 :]).encode()
            held[key] = held.get(key, 0) + 1
    s, e = s[~dropped], e[~dropped]
    # one of each hash, and whatever turns out to be of other bytes
    _, one, of, n = np.unique(B.span_hashes(low, s, e), return_index=True, return_inverse=True, return_counts=True)
    same = crc.same_spans(low, s, e, low, s[one][of], e[one][of])
    n = n - np.bincount(of[~same], minlength=len(n))
    other = np.flatnonzero(~same)
    for x, y, k in zip(np.append(s[one], s[other]).tolist(), np.append(e[one], e[other]).tolist(), np.append(n, np.ones(len(other), n.dtype)).tolist(), strict=True):
        key = flat[x:y]
        held[key] = held.get(key, 0) + k


def vocabulary(docs: DataFrame, least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, drop: int = DROP) -> DataFrame:
    """(word, n): words of at least `least` letters that occur `least_count` times or more.

    `drop` 0 takes runs as they are.
    """

    def sent(held):
        return B.batch(COUNT_PA, pa.array([k.decode() for k in held], pa.string()), pa.array(list(held.values()), pa.int64()))

    @B.tidy
    def run(batches):
        held: dict[bytes, int] = {}
        for rb in batches:
            ids = rb.column(0).to_pylist()
            raw, offs = B.buffer_of(rb.column(1))
            for lo, hi in B.slabs(offs):
                prefixes = [b"%s:" % (b"" if i is None else str(i).encode()) for i in ids[lo:hi]]
                counted(held, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], prefixes, least, drop)
                if len(held) >= HELD:
                    yield sent(held)
                    held = {}
        yield sent(held)

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def symbols_for(words: int, shortest: int = LEAST_LETTERS) -> int:
    """Symbols with which reduced words of the shortest length outnumber the words."""
    k = 4
    while k**shortest < words:
        k += 1
    return k


def reduced(words: list[str], symbols: int) -> np.ndarray:
    """The letters of words of one length as symbols 1 to `symbols`, a row for each word."""
    x = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64).reshape(len(words), -1)
    return ((x * np.uint64(0x9E3779B1)) >> np.uint64(15)) % np.uint64(symbols) + np.uint64(1)


class Reduced:
    """Hashes of reduced words of one length and of their one-edit neighbours, from sums over both ends."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, x.shape[1]
        self.pow, self.inv = B.powers(self.n + 2, 0)
        self.left = np.zeros((len(x), self.n + 1), dtype=np.uint64)
        np.cumsum(x * self.pow[: self.n], axis=1, out=self.left[:, 1:])
        self.all = self.left[:, self.n :]

    @staticmethod
    def key(total: np.ndarray, length: int) -> np.ndarray:
        return B.mix(total ^ B.mix(np.full(1, length, dtype=np.uint64)))

    def own(self) -> np.ndarray:
        return self.key(self.all[:, 0], self.n)

    def near(self, lo: int, hi: int, symbols: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(keys, rows) of the neighbours made at places lo to hi - 1: a symbol deleted, or replaced by a later one."""
        x, left, right = self.x[:, lo:hi], self.left[:, lo:hi], self.all - self.left[:, lo + 1 : hi + 1]
        # of a run of equal symbols, the first is deleted
        before = np.concatenate((np.zeros((len(x), 1), np.uint64), self.x), axis=1)[:, lo:hi]
        row, at = np.nonzero(before != x)
        out = [(self.key(left[row, at] + right[row, at] * self.inv[1], self.n - 1), row)]
        rest, p = left + right, self.pow[lo:hi]
        for c in range(2, symbols + 1):
            row, at = np.nonzero(x < np.uint64(c))
            out.append((self.key(rest[row, at] + p[at] * np.uint64(c), self.n), row))
        return out


def _keyed(symbols: int, full: bool):
    """(key, id) of words (id, word): their own reduced words and, if `full`, the neighbours."""

    def sent(keys, ids):
        return B.batch(KEY_PA, B.long_col(np.concatenate(keys)), B.long_col(np.concatenate(ids)))

    @B.tidy
    def run(batches):
        for rb in batches:
            words, ids = rb.column(1).to_pylist(), np.asarray(rb.column(0))
            size = np.array([len(w) for w in words], dtype=np.int64)
            for n in np.unique(size).tolist():
                same = np.flatnonzero(size == n)
                many = max(PIECE // max(n * symbols, 1), 1)
                for k in range(0, len(same), many):
                    part = same[k : k + many]
                    r = Reduced(reduced([words[i] for i in part.tolist()], symbols))
                    yield sent([r.own()], [ids[part]])
                    for lo in range(0, n if full else 0, PIECE):
                        keys, rows = zip(*r.near(lo, min(lo + PIECE, n), symbols), strict=True)
                        yield sent(keys, [ids[part[x]] for x in rows])

    return run


def neighbours(vocab: DataFrame, symbols: int) -> DataFrame:
    """(key, id): each word's reduced word and the neighbours that are shorter or have a later symbol at one place.

    The rest of a neighbourhood is the same pairs seen from the other word: of two reduced
    words one edit apart, one is longer or has the earlier symbol, and that one makes the other.
    """
    return vocab.select("id", "word").mapInArrow(_keyed(symbols, True), "key long, id long")


def reduced_words(vocab: DataFrame, symbols: int) -> DataFrame:
    """(key, id): each word's own reduced word."""
    return vocab.select("id", "word").mapInArrow(_keyed(symbols, False), "key long, id long")


def near_pairs(vocab: DataFrame, symbols: int) -> DataFrame:
    """(id, near): both ways, every two words of (id, word) that differ by one edit."""
    made = neighbours(vocab, symbols)
    own = reduced_words(vocab, symbols).select(F.col("key").alias("key2"), F.col("id").alias("near"))
    met = made.join(own.hint("merge"), (F.col("key") == F.col("key2")) & (F.col("id") != F.col("near")))
    met = met.select(F.least("id", "near").alias("id"), F.greatest("id", "near").alias("near")).distinct()
    words = lambda a, b: vocab.select(F.col("id").alias(a), F.col("word").alias(b)).hint("merge")
    both = met.join(words("id1", "w1"), F.col("id") == F.col("id1")).join(words("id2", "w2"), F.col("near") == F.col("id2"))
    good = both.filter(F.levenshtein("w1", "w2", 1) == 1)
    return good.select(F.explode(F.array(F.struct("id", "near"), F.struct(F.col("near").alias("id"), F.col("id").alias("near")))).alias("p")).select("p.*")


def roots(forms: DataFrame, rounds: int = 20) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, twice as far each round.

    A form occurs ten times as often as its word, so chains are short and have no circles.
    """
    at = staged(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        step = at.select(F.col("word").alias("w2"), F.col("root").alias("next"))
        at = staged(at.join(step.hint("merge"), F.col("root") == F.col("w2"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not at.filter("moved").limit(1).take(1):
            return at.select("word", "root")
    raise RuntimeError("forms did not settle")


def variants(docs: DataFrame, symbols: int | None = None, times: int = TIMES, least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, drop: int = DROP) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of the vocabulary, its near words' number and its form.

    The form is the near word that occurs most (ties: the smallest), if `times` as often.
    """
    vocab = staged(vocabulary(docs, least, least_count, drop).select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")
    size = vocab.count()
    spread = vocab.repartition(max(size // ROWS_PER_TASK + 1, docs.sparkSession.sparkContext.defaultParallelism), "id")
    pairs = near_pairs(spread, symbols or symbols_for(size, least))
    other = vocab.select(F.col("id").alias("id2"), F.col("word").alias("w"), F.col("n").alias("m"))
    best = pairs.join(other.hint("merge"), F.col("near") == F.col("id2")).groupBy(F.col("id").alias("id1")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "w")).alias("top"))
    joined = vocab.join(best.hint("merge"), F.col("id") == F.col("id1"), "left")
    form_n = F.when(-F.col("top.m") >= times * F.col("n"), -F.col("top.m"))
    out = staged(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form_n.isNotNull(), F.col("top.w")).alias("form"), form_n.alias("form_n")), "forms")
    last = roots(out.filter("form IS NOT NULL")).select(F.col("word").alias("w2"), "root")
    return out.join(last.hint("merge"), F.col("word") == F.col("w2"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
