"""Quality rules: line labelling by a linear-chain conditional random field.

Every line with a word is a position; Viterbi decoding marks it content or boilerplate from
what its characters, words and repeats look like and from its neighbours.  A document is kept
if its base rules hold and the share of its words on content lines is at least `share`.

The field is trained here, on the lines of at most `max_docs` labelled documents (half of
either label, those of least hash of their doc_id) and at most `max_lines` lines of each, in
one run from a place that varies: a line takes its document's label, the field evens out the
noise of that.  Without labels of both kinds, fixed weights stand in.

Nulls and empty texts have no words; base_failed is true for them and kept is false.
Repeated rows and ids stay as they are; other columns are passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import few_by_hash

SHARE, MAX_DOCS, MAX_LINES = 0.35, 1500, 64
MIN_WORDS = 50
#: Lines of a batch are decoded in groups of documents of about so many bytes.
FEATURES = ("bias", "short", "long", "symbols", "pipes", "shouting", "capitals", "digits", "stutter", "repeats", "copy", "no_stop")
#: Weights for boilerplate where nothing is labelled, and for staying with a label.
FIXED_WEIGHTS = (-2.0, 0.3, -0.5, 6.0, 6.0, 6.0, 2.0, 1.0, 6.0, 2.0, 1.0, 0.3)
FIXED_STAY = 1.0

OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_words long, n_lines long"
OUT_PA = pa.schema([(c, pa.bool_() if c in ("base_failed", "kept") else pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words", "n_lines")])
TRAIN_OUT = "good boolean, lines array<array<float>>"


def _of(values: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(values)] = True
    return out


SYMBOL, PIPE, SHOUT = _of(b"#*$%&|<>"), _of(b"|"), _of(b"!")
UPPER, ALPHA, DIGIT = _of(bytes(range(65, 91))), _of(bytes([*range(65, 91), *range(97, 123)])), _of(b"0123456789")
STOP = _of(b".!?:;,\"')")
POINT = np.ones(256, dtype=bool)
POINT[128:192] = False  # continuation bytes


def seen_before(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal key stands earlier in the row, equal key stands in the row at all)."""
    n = len(keys)
    before, any_ = np.zeros(n, bool), np.zeros(n, bool)
    order = np.argsort(keys, kind="stable")
    k, r = keys[order], row[order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    before[order[1:]] = same
    any_[order[1:]] |= same
    any_[order[:-1]] |= same
    return before, any_


def measure(raw: np.ndarray, offs: np.ndarray):
    """Base counts of the rows of one slab, and (row, words, features) of its lines with words."""
    rows = len(offs) - 1
    s, e, wrow = B.word_spans(raw, offs)
    per_row = lambda at: np.bincount(at, minlength=rows)
    inside = ~B.SPACE[raw] & POINT[raw]
    words = B.span_hashes(raw, s, e)
    covered = np.zeros(len(s), dtype=bool)
    if len(s) >= 3:
        tri = B.Rolling(words, 1).every(3)
        own = np.flatnonzero(wrow[2:] == wrow[:-2])
        _, twice = seen_before(tri[own], wrow[own])
        at = own[twice]
        covered[at] = covered[at + 1] = covered[at + 2] = True
    # lines: from a row's start or a line feed to the next line feed or the row's end
    feed = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate((offs[:-1][np.diff(offs) > 0], feed + 1)))
    starts = starts[starts < len(raw)]
    lrow = np.searchsorted(offs, starts, side="right") - 1
    nxt = np.append(starts[1:], len(raw))
    ends = np.minimum(nxt, offs[lrow + 1])
    ends = ends - (raw[np.maximum(ends - 1, 0)] == 10)
    line_of = np.searchsorted(starts, s, side="right") - 1
    n_line = np.bincount(line_of, minlength=len(starts))
    full = n_line > 0
    starts, ends, lrow, n_line = starts[full], ends[full], lrow[full], n_line[full]
    number = np.cumsum(full) - 1
    line_of = number[line_of]
    copy, _ = seen_before(B.span_hashes(raw, starts, ends), lrow)
    base = {
        "n_words": per_row(wrow),
        "word_chars": B.span_sums(inside, offs[:-1], offs[1:]),
        "n_symbols": B.span_sums(SYMBOL[raw], offs[:-1], offs[1:]),
        "n_dup_lines": per_row(lrow[copy]),
        "n_repeat_words": per_row(wrow[covered]),
    }
    size = np.maximum(B.span_sums(inside, starts, ends), 1)
    part = lambda mask: B.span_sums(mask[raw], starts, ends) / size
    stutter = np.zeros(len(s), dtype=bool)
    if len(s) > 1:
        stutter[1:] = (words[1:] == words[:-1]) & (line_of[1:] == line_of[:-1])
    letters = np.maximum(B.span_sums(ALPHA[raw], starts, ends), 1)
    upper = B.span_sums(UPPER[raw], starts, ends)
    x = np.column_stack(
        (
            np.ones(len(starts)),
            n_line <= 3,
            n_line >= 8,
            np.minimum(part(SYMBOL) * 6, 1),
            np.minimum(part(PIPE) * 10, 1),
            np.minimum(part(SHOUT) * 10, 1),
            upper / letters > 0.5,
            part(DIGIT) > 0.2,
            np.bincount(line_of, stutter, minlength=len(starts)) / np.maximum(n_line, 1),
            np.bincount(line_of, covered, minlength=len(starts)) / np.maximum(n_line, 1),
            copy,
            ~STOP[raw[ends - 1]] if len(starts) else np.zeros(0, bool),
        )
    ).astype(np.float64)
    return base, lrow, n_line, x


class Field:
    """Two labels, 0 content and 1 boilerplate; emissions are linear in a line's features."""

    def __init__(self, weights=FIXED_WEIGHTS, moves=None):
        self.weights = np.array(weights, dtype=np.float64)
        self.moves = np.array(moves if moves is not None else ((FIXED_STAY, 0.0), (0.0, FIXED_STAY)), dtype=np.float64)

    def decode(self, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Most likely labels of the lines of several documents; rows ascend.

        All documents advance one line at a time together, longest first.
        """
        n = len(row)
        out = np.zeros(n, dtype=np.int64)
        if not n:
            return out
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        size = np.diff(np.append(first, n))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        score = np.zeros((n, 2))
        score[:, 1] = x @ self.weights
        back = np.zeros((n, 2), dtype=np.int8)
        live = np.searchsorted(-size, -np.arange(int(size[0]) + 1), side="left")  # documents with more than t lines
        for t in range(1, int(size[0])):
            at = first[: live[t]] + t
            via = score[at - 1][:, :, None] + self.moves
            back[at] = via.argmax(axis=1)
            score[at] += via.max(axis=1)
        last = first + size - 1
        label = score[last].argmax(axis=1)
        out[last] = label
        for t in range(int(size[0]) - 1, 0, -1):
            k = live[t]
            at = first[:k] + t
            label[:k] = back[at, out[at]]
            out[at - 1] = label[:k]
        return out

    @classmethod
    def trained(cls, docs: list[tuple[bool, np.ndarray]], rounds: int = 150, rate: float = 0.1, ridge: float = 0.01) -> Field:
        """By gradient ascent of the likelihood, forward and backward over padded documents."""
        docs = sorted(((g, x) for g, x in docs if len(x)), key=lambda d: -len(d[1]))
        if len({g for g, _ in docs}) < 2:
            return cls()
        # lines by place, documents by length: those that are as long as t lines come first
        size = np.array([len(x) for _, x in docs])
        m, top, k = len(docs), int(size[0]), len(FEATURES)
        x = np.zeros((top, m, k))
        for i, (_, lines) in enumerate(docs):
            x[: len(lines), i] = lines
        live = np.searchsorted(-size, -np.arange(top + 1), side="left")
        here = np.arange(top)[:, None] < size
        y = np.array([0 if g else 1 for g, _ in docs])
        # both kinds of document weigh the same
        cost = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / size / m
        f = cls(np.zeros(k), np.zeros((2, 2)))
        mean = [np.zeros(k), np.zeros((2, 2))]
        var = [np.zeros(k), np.zeros((2, 2))]
        stays = np.array([(cost * (size - 1) * (y == v)).sum() for v in (0, 1)])
        for step in range(1, rounds + 1):
            # label 0 weighs 1 on every line and label 1 weighs e; a and b are label 1's shares
            e, move = np.exp(np.clip(np.einsum("tmk,k->tm", x, f.weights), -60, 60)), np.exp(f.moves)
            a, b = np.zeros((top, m)), np.full((top, m), 0.5)
            a[0] = e[0] / (1 + e[0])
            for t in range(1, top):
                n = live[t]
                one = a[t - 1, :n]
                up = (move[0, 1] + (move[1, 1] - move[0, 1]) * one) * e[t, :n]
                a[t, :n] = up / (up + move[0, 0] + (move[1, 0] - move[0, 0]) * one)
            for t in range(top - 2, -1, -1):
                n = live[t + 1]
                up, down = e[t + 1, :n] * b[t + 1, :n], 1 - b[t + 1, :n]
                one = move[1, 0] * down + move[1, 1] * up
                b[t, :n] = one / (one + move[0, 0] * down + move[0, 1] * up)
            p1 = a * b / (a * b + (1 - a) * (1 - b)) * here
            gw = np.einsum("tm,tmk->k", (y * here - p1) * cost, x) - ridge * f.weights / len(f.weights)
            left, right = (1 - a[:-1], a[:-1]), (1 - b[1:], e[1:] * b[1:])
            pair = [[left[i] * move[i, j] * right[j] for j in (0, 1)] for i in (0, 1)]
            weight = here[1:] * cost / (pair[0][0] + pair[0][1] + pair[1][0] + pair[1][1])
            gm = np.diag(stays) - np.array([[np.vdot(weight, pair[i][j]) for j in (0, 1)] for i in (0, 1)]) - ridge * f.moves
            for j, (target, g) in enumerate(((f.weights, gw), (f.moves, gm))):
                mean[j] = 0.9 * mean[j] + 0.1 * g
                var[j] = 0.99 * var[j] + 0.01 * g * g
                target += rate * (mean[j] / (1 - 0.9**step)) / (np.sqrt(var[j] / (1 - 0.99**step)) + 1e-8)
        return f


def _features(max_lines: int):
    @B.tidy
    def run(batches):
        for rb in batches:
            raw, offs = B.buffer_of(rb.column(1))
            good, out = rb.column(0), []
            for lo, hi in B.slabs(offs):
                _, row, _, x = measure(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                n = np.diff(cut)
                # a run of lines from anywhere in the document, the same on every run
                at = cut[:-1] + (np.diff(offs[lo : hi + 1]) * 2654435761 >> 8) % np.maximum(n - max_lines + 1, 1)
                out += [x[at[i] : at[i] + min(n[i], max_lines)].astype(np.float32).tolist() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([good, pa.array(out, pa.list_(pa.list_(pa.float32())))], names=["good", "lines"])

    return run


def train_field(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> Field:
    """A field from at most max_docs labelled documents and max_lines lines of each."""
    few = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("lid"), (F.col("quality") > 0).alias("good"))
    few = few_by_hash(few, ["lid", "good"], max_docs, "good")
    joined = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(few), F.col("doc_id") == F.col("lid"))  # few has max_docs rows at most
    # where ids repeat, a label stands for the text of least hash
    one = joined.groupBy("lid", "good").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = one.select("good", "text").mapInArrow(_features(max_lines), TRAIN_OUT).collect()
    rows = sorted(((r.good, r.lines) for r in got), key=repr)  # in one order on every run
    return Field.trained([(g, np.array(x, dtype=np.float64).reshape(-1, len(FEATURES))) for g, x in rows])


def verdicts(texts: pa.Array, field: Field, share: float, min_words: int):
    """(counts by name, base_failed, kept) of a column of texts."""
    raw, offs = B.buffer_of(texts)
    parts = []
    for lo, hi in B.slabs(offs):
        base, row, words, x = measure(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        content = field.decode(x, row) == 0
        base["content_words"] = np.bincount(row, words * content, minlength=hi - lo).astype(np.int64)
        base["n_lines"] = np.bincount(row, minlength=hi - lo)
        parts.append(base)
    c = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    failed = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
    return c, failed, ~failed & (c["content_words"] >= share * c["n_words"])


def _judge(field: Field, share: float, min_words: int):
    @B.tidy
    def run(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            c, failed, kept = verdicts(rb.column(1), field, share, min_words)
            yield B.batch(OUT_PA, rb.column(0), *(B.long_col(c[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(kept), B.long_col(c["content_words"]), B.long_col(c["n_lines"]))

    return run


def judge(docs: DataFrame, labels: DataFrame | None = None, share: float = SHARE, min_words: int = MIN_WORDS, max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> DataFrame:
    """One row per row of docs: the base counts, base_failed, kept, content_words, n_lines."""
    field = train_field(docs, labels, max_docs, max_lines) if labels is not None else Field()
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_judge(field, share, min_words), OUT)


def keep_good(docs: DataFrame, labels: DataFrame | None = None, share: float = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs, with all their columns, that `judge` keeps; nothing is shuffled."""
    field = train_field(docs, labels) if labels is not None else Field()

    @B.tidy
    def run(batches):
        for rb in batches:
            if rb.num_rows:
                yield rb.filter(pa.array(verdicts(rb.column("text"), field, share, min_words)[2]))

    return docs.mapInArrow(run, docs.schema)
