"""Token ids in files of Simple-8b words.

A 64-bit word holds a 4-bit selector and 60 bits of equally wide ids; the selector packs as
many ids as fit: 60 of 1 bit ... 1 of 60 bits.  Selector 15 is the escape: the next word is
an id of its own.  Ids are coded in blocks of 128 that don't depend on each other; a file
keeps each block's word offset, so encoding and decoding run over all blocks at once.

Documents are dealt by range of doc_id (nulls first, equal ids by a hash of the text, then text) and tokenised in that
order; each task writes chunks of whole documents: shard number, ids before the chunk in its
shard, documents' ids and lengths, block offsets, words.  Files are Parquet with those columns,
written and read by Spark.

A null text is empty and gives only the end id.  Equal rows give equal runs one after the
other.  An empty table gives no rows.  Texts are tokenised whole.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .common import in_order, join_checked, shared_dir, staged

TOKENIZER, END_ID = "word_bpe_49k.json", 1
BLOCK = 128
#: Ids per word and their width, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
WIDTHS = 60 // COUNTS
ESCAPE = 15
CHUNK_IDS = 1 << 18
CACHE = 300_000
TEXT_SLAB = 2 << 20
GAP = re.compile(rb"[\x09-\x0d\x20]")

FILE = "shard int, seq int, before long, doc_ids array<long>, lengths array<long>, offsets binary, words binary"
FILE_PA = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("offsets", pa.binary()), ("words", pa.binary())])
DOC = "shard int, doc_id long, at long, n_tokens long, ids_crc32 long"
DOC_PA = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offset of each block and the end) of unsigned 64-bit ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    x = np.zeros(blocks * BLOCK + 64, dtype=np.uint64)
    x[:n] = ids
    wide = np.frexp(x.astype(np.float64))[1].astype(np.uint8)  # bits of an id, at least
    wide = wide[: blocks * BLOCK].reshape(blocks, BLOCK)
    wide = np.concatenate((wide, np.zeros((blocks, 64), np.uint8)), axis=1)  # what follows a block counts as 0
    choice = np.full((blocks, BLOCK), ESCAPE, dtype=np.uint8)
    peaks = {1: wide}
    for s in (1, 2, 4, 8, 16, 32):
        if s > 1:
            y = peaks[s // 2]
            peaks[s] = np.maximum(y, np.concatenate((y[:, s // 2 :], np.zeros((blocks, s // 2), np.uint8)), axis=1))
    for sel in range(len(COUNTS) - 1, -1, -1):
        c = int(COUNTS[sel])
        p = 1 << (c.bit_length() - 1)
        y = peaks[p]
        most = np.maximum(y[:, :BLOCK], y[:, c - p : c - p + BLOCK])
        choice[most <= WIDTHS[sel]] = sel
    step = np.append(COUNTS, [0, 1])
    size = np.full(blocks, BLOCK, dtype=np.int64)
    size[-1] = n - (blocks - 1) * BLOCK
    live, at = np.arange(blocks), np.zeros(blocks, dtype=np.int64)
    starts, sels = [], []
    while len(live):
        s = choice[live, at[live]]
        starts.append(live * BLOCK + at[live])
        sels.append(s)
        at[live] += step[s]
        live = live[at[live] < size[live]]
    starts, sels = np.concatenate(starts), np.concatenate(sels)
    order = np.argsort(starts)
    starts, sels = starts[order], sels[order]
    takes = 1 + (sels == ESCAPE)
    place = np.cumsum(takes) - takes
    words = np.zeros(int(takes.sum()), dtype=np.uint64)
    ends = np.minimum((starts // BLOCK + 1) * BLOCK, n)
    for sel in range(len(COUNTS)):
        i = np.flatnonzero(sels == sel)
        if len(i):
            w = np.full(len(i), sel << 60, dtype=np.uint64)
            for j in range(int(COUNTS[sel])):
                src = starts[i] + j
                w |= np.where(src < ends[i], x[np.minimum(src, n - 1)], np.uint64(0)) << np.uint64(j * int(WIDTHS[sel]))
            words[place[i]] = w
    i = np.flatnonzero(sels == ESCAPE)
    words[place[i]] = np.uint64(ESCAPE << 60)
    words[place[i] + 1] = x[starts[i]]
    first = np.searchsorted(starts, np.arange(blocks) * BLOCK)
    return words, np.append(place[first], len(words)).astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids of encoded blocks."""
    out = np.zeros(n, dtype=np.uint64)
    sels = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    # a word after an escape is raw; escapes are few, and a raw word may look like one
    at = -2
    for i in np.flatnonzero(sels == ESCAPE).tolist():
        if i != at + 1:
            raw[i + 1] = True
            at = i
    step = np.append(COUNTS, [0, 1])[sels]
    step[raw] = 0
    run = np.cumsum(step) - step
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets.astype(np.int64)))
    place = run - run[offsets[:-1].astype(np.int64)][block] + block * BLOCK
    ends = np.minimum((block + 1) * BLOCK, n)
    for sel in range(len(COUNTS)):
        i = np.flatnonzero((sels == sel) & ~raw)
        mask = np.uint64((1 << int(WIDTHS[sel])) - 1)
        for j in range(int(COUNTS[sel]) if len(i) else 0):
            to = place[i] + j
            ok = to < ends[i]
            out[to[ok]] = (words[i[ok]] >> np.uint64(j * int(WIDTHS[sel]))) & mask
    i = np.flatnonzero((sels == ESCAPE) & ~raw)
    out[place[i]] = words[i + 1]
    return out


#: Latin letters whose lower case is one letter of the same range.
PLAIN = "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and len(c.lower()) == 1 and "\u00df" <= c.lower() <= "\u024f")
#: What is neither ASCII nor such a letter, and the apostrophe (contractions).
ODD = re.compile(f"[^\t-\r\x20-\x26\x28-\x7e{PLAIN}]")
#: The tokenizer's own split of other text in lower case: letters, one digit, or neither.
PARTS = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f]+|[0-9]|[^\t-\r\x20a-z0-9\u00df-\u00f6\u00f8-\u024f]+")


class Encoder:
    """Ids of texts by the tokenizers library, part by part.

    The tokenizer drops white space before it splits, so a text's ids are those of its words
    in turn, and a plain word's are those of its parts (for such words lower case is all that
    its normaliser does).  New parts go to the library many at a time without its normaliser;
    the last id of a part, and no other, is a word end.  Words with other characters go
    through the tokenizer whole.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        if not os.path.isabs(name):
            import public_tokenizers

            name = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(name)
        own = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.ways = {True: own, False: (normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]))}
        self.whole = True
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.known: dict[str, bytes] = {}

    def use(self, whole: bool):
        """The tokenizer as it stands in its file, or (not whole) as parts go through it: one serves for both."""
        if whole != self.whole:
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.ways[whole]
            self.whole = whole
        return self.tokenizer

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.use(True).encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def keys(self, text: bytes) -> list[str]:
        """The text's parts; a word that isn't plain is marked by a line feed before it."""
        s = text.decode()
        if not ODD.search(s) and not any(t in s for t in self.special):
            return PARTS.findall(s.lower())
        out = []
        for w in text.split():
            s = w.decode()
            if ODD.search(s) or any(t in s for t in self.special):
                out.append("\n" + s)
            else:
                out += PARTS.findall(s.lower())
        return out

    def learn(self, new: list[str]) -> None:
        known = self.known
        parts = []
        for x in new:
            if x[0] == "\n":
                known[x] = self.ids(x[1:]).tobytes()
            else:
                parts.append(x)
        if not parts:
            return
        groups = [parts[i : i + 512] for i in range(0, len(parts), 512)]
        for g, e in zip(groups, self.use(False).encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=np.uint32)
            ends = (np.flatnonzero(self.ends[ids]) * 4 + 4).tolist()
            flat, at = ids.tobytes(), 0
            for w, e in zip(g, ends, strict=True):
                known[w] = flat[at:e]
                at = e

    def of(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of texts."""
        split = [self.keys(t) for t in texts]
        needed = set().union(*split)
        if len(self.known) > CACHE:  # what these texts need stays: frequent parts always do
            known = self.known
            self.known = {x: known[x] for x in needed.intersection(known)}
        new = needed.difference(self.known)
        if new:
            self.learn(list(new))
        get = self.known.__getitem__
        return [b"".join(map(get, parts)) for parts in split]


    def long(self, text: bytes) -> bytes:
        """The same of one long text, cut between words."""
        out, lo = [], 0
        while lo < len(text):
            gap = GAP.search(text, lo + TEXT_SLAB)
            hi = gap.start() if gap else len(text)
            out += self.of([text[lo:hi]])
            lo = hi
        return b"".join(out)


def token_batches(batches, name: str, end_id: int):
    """(doc ids, little-endian ids with the end id) of slabs of documents, in order."""
    encoder = B.kept(__name__, name, lambda: Encoder(name))
    end = np.array([end_id], dtype="<u4").tobytes()
    for rb in batches:
        raw, offs = B.buffer_of(rb.column(1))
        ids = rb.column(0).to_pylist()
        for lo, hi in B.slabs(offs, TEXT_SLAB):
            cut = (offs[lo : hi + 1] - offs[lo]).tolist()
            flat = raw[offs[lo] : offs[hi]].tobytes()
            texts = encoder.of([flat[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]) if cut[-1] <= 2 * TEXT_SLAB else [encoder.long(flat)]
            flat = None
            yield ids[lo:hi], [t + end for t in texts]


def _write(name: str, end_id: int):
    @B.tidy
    def run(batches):
        shard, seq, before = TaskContext.get().partitionId(), 0, 0
        held_ids, held = [], []

        def chunk():
            flat = np.frombuffer(b"".join(held), dtype="<u4").astype(np.uint64)
            words, offsets = encode(flat)
            return len(flat), B.batch(FILE_PA, pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([held_ids], pa.list_(pa.int64())), pa.array([[len(x) // 4 for x in held]], pa.list_(pa.int64())), pa.array([offsets.astype("<u4").tobytes()], pa.binary()), pa.array([words.astype("<u8").tobytes()], pa.binary()))

        size = 0
        for ids, texts in token_batches(batches, name, end_id):
            for i, t in zip(ids, texts, strict=True):
                held_ids.append(i)
                held.append(t)
                size += len(t) // 4
                if size >= CHUNK_IDS:
                    n, out = chunk()
                    yield out
                    seq, before, size, held_ids, held = seq + 1, before + n, 0, [], []
        if held:
            yield chunk()[1]

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Tokenise documents in ascending doc_id order and write the files under path."""
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    in_order(d, "doc_id").mapInArrow(_write(tokenizer, end_id), FILE).write.option("compression", "uncompressed").parquet(path)


def _read(batches):
    for rb in batches:
        for i in range(rb.num_rows):
            shard, _, before, docs, lengths, offsets, words = (rb.column(k)[i].as_py() for k in range(7))
            n = np.array(lengths, dtype=np.int64)
            ids = decode(np.frombuffer(words, "<u8"), np.frombuffer(offsets, "<u4"), int(n.sum())).astype("<u4")
            ends = np.cumsum(n)
            crc = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends.tolist(), lengths, strict=True)]
            yield B.batch(DOC_PA, pa.array([shard] * len(n), pa.int32()), pa.array(docs, pa.int64()), B.long_col(before + ends - n), B.long_col(n), pa.array(crc, pa.int64()))


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) decoded from the files."""
    files = spark.read.schema(FILE).parquet(path)
    totals = files.select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    # one row per shard
    bases = staged(totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base")), "bases")
    docs = join_checked(files.mapInArrow(B.tidy(_read), DOC), bases, ["shard"], "inner")
    return docs.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Write documents as token files in the shared folder and read them back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(spark, path)
