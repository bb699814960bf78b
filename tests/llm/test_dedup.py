import numpy as np
import pytest

from loamwork.llm import repeats, simhash
from loamwork.llm.substring_dedup import Words, remove_repeated_passages
from loamwork.llm.suffix_dedup import equal_suffixes, remove_repeated_bytes

from .helpers import covered, odd_documents, sha


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "other", "x") for i, t in rows], "doc_id long, text string, rid string, h string").repartition(3)


def check_bytes(spark, rows, length=100):
    docs = sorted((i, (t or "").encode()) for i, t in rows)
    want = covered(docs, length)
    got = {r.doc_id: r for r in remove_repeated_bytes(frame(spark, rows), length).collect()}
    assert len(got) == len(rows)
    for i, t in docs:
        m = want[i]
        spans = sum(x and not (j and m[j - 1]) for j, x in enumerate(m))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), sum(m), spans, sha(bytes(b for b, x in zip(t, m) if not x))), i


def check_words(spark, rows, length=20):
    docs = sorted((i, (t or "").encode().split()) for i, t in rows)
    want = covered(docs, length)
    got = {r.doc_id: r for r in remove_repeated_passages(frame(spark, rows), length).collect()}
    assert len(got) == len(rows)
    for i, t in docs:
        m = want[i]
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(t), sum(m), sha(b" ".join(b for b, x in zip(t, m) if not x))), i


def test_bytes_against_brute_force(spark):
    check_bytes(spark, odd_documents())


def test_words_against_brute_force(spark):
    check_words(spark, odd_documents())


def test_crowded_anchors_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CROWDED", 1)
    check_bytes(spark, odd_documents())
    check_words(spark, odd_documents())


def test_texts_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 256)
    check_bytes(spark, odd_documents())
    check_words(spark, odd_documents())


def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = frame(spark, [(None, text), (7, text), (7, text)])
    got = sorted((r.doc_id is not None, r.n_removed) for r in remove_repeated_passages(rows).collect())
    assert got == [(False, 0), (True, 60), (True, 60)]


def test_empty_table(spark):
    assert remove_repeated_bytes(frame(spark, [(1, "a")]).limit(0)).count() == 0
    assert remove_repeated_passages(frame(spark, [(1, "a")]).limit(0)).count() == 0
    assert simhash.near_duplicates(frame(spark, [(1, "a")]).limit(0)).count() == 0


def brute_components(rows):
    fp = {i: simhash.fingerprint((t or "").encode()) for i, t in rows}
    root = {i: i for i in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fp)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (f"{fp[i]:016x}", find(i)) for i in ids}


@pytest.mark.parametrize("long_list", [256, 1])
def test_simhash_components(spark, long_list):
    rows = odd_documents() + [(100 + k, " ".join([f"a{j}" for j in range(300)] + [f"z{k}"])) for k in range(12)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, rows), long_list).collect()}
    assert got == brute_components(rows)


def test_simhash_hash_is_sparks_own(spark):
    """XXH64 with seed 42, as Spark computes it for a single shingle."""
    h = spark.sql("SELECT xxhash64('one two three four') AS h").first().h
    assert simhash.fingerprint(b"ONE two  three\nfour") == h % (1 << 64)


def test_every_four_bytes_hold_a_triple():
    from itertools import combinations

    assert all(any(set(t) <= set(q) for t in simhash.triples()) for q in combinations(range(8), 4))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_one_of_each_keeps_columns(spark):
    d = frame(spark, odd_documents())
    kept = simhash.one_of_each(d)
    assert kept.columns == d.columns
    first = {c for _, c in brute_components(odd_documents()).values()}
    assert {r.doc_id for r in kept.collect()} == first


@pytest.mark.parametrize("length", [5, 8, 20, 101])
def test_radix_passes_against_trying_every_suffix(length):
    r = np.random.default_rng(length)
    raw = np.concatenate([r.integers(0, 2, 300), np.tile([1, 0, 1], 120), r.integers(0, 2, 40)]).astype(np.uint8)
    raw = np.concatenate([raw, raw[100:500]])
    i = np.arange(len(raw) - length + 1)
    bucket = i % 2
    seen, want = set(), []
    for k in i:
        x = (k % 2, raw[k : k + length].tobytes())
        want.append(x in seen)
        seen.add(x)
    assert equal_suffixes(raw, i, bucket, length).tolist() == want


def test_extension_against_trying_every_window():
    """Places of two seeds, with all or few of their windows inside the segment."""
    r = np.random.default_rng(3)
    t = Words(6, 2)
    texts, h, left, n = [], [], [], []
    for _ in range(400):
        reach, k = int(r.integers(0, 5)), int(r.integers(1, 4))
        k = min(k, reach + 1)
        words = [f"w{x}" for x in r.integers(0, 2, k + 5)]
        seed = int(r.integers(0, 2))
        words[reach : reach + 2] = [f"s{seed}", "s"]
        texts.append(" ".join(words).encode())
        h.append(seed)
        left.append(reach)
        n.append(k)
    by = np.argsort(h, kind="stable")
    texts, h, left, n = [texts[x] for x in by], np.array(h)[by], np.array(left)[by], np.array(n)[by]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, bounds = t.split(raw, np.append(0, np.cumsum([len(x) for x in texts])))
    seen, want = set(), []
    for s, g, reach, k in zip(texts, h, left, n, strict=True):
        for j in range(k):
            x = (g, reach - j, tuple(s.split()[j : j + 6]))
            want.append(x in seen)
            seen.add(x)
    assert t.again(raw, starts, ends, bounds[:-1], h, left, n).tolist() == want


def test_segments_that_share_half_a_hash_are_different(spark):
    """Texts whose segments have one anchor and the same upper 32 bits of the first hash."""
    text = "the quick brown fox jumps over the lazy dog and then walks home along the old river road by "
    check_bytes(spark, [(1, f"{text}00001753"), (2, f"{text}00148372"), (3, f"{text}00001753")])
    few = " ".join(f"w{i}" for i in range(18))
    check_words(spark, [(1, f"{few} x135540 y"), (2, f"{few} x173369 y"), (3, f"{few} x135540 y")])
