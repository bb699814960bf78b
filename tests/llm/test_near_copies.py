from loamwork.llm import near_copies, simhash

from .helpers import odd_documents, words
from .test_dedup import frame


def brute_firsts(rows):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()

    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in ids}


def near_rows():
    """Chains and groups of near copies, some of them within 0.8 of one neighbour only."""
    rows = odd_documents()
    for g in range(6):
        w = words(200, 50 + g, 5000)
        for k in range(12):
            w = list(w)
            w[(17 * k + g) % 200] = f"new{g}x{k}"
            rows.append((100 + 20 * g + (7 * k) % 12, " ".join(w)))
    base = words(200, 90, 5000)
    for k in range(20):
        w = list(base)
        for x in range(0, 40, 10):
            w[(9 * k + x) % 200] = f"own{k}x{x}"
        rows.append((400 + k, " ".join(w)))
    return rows


def test_pairs_beyond_four_bits_are_linked(spark):
    rows = near_rows()
    got = {r.doc_id for r in near_copies.one_of_each_set(frame(spark, rows)).collect()}
    assert got == brute_firsts(rows)
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in rows}
    assert (prints[1] ^ prints[3]).bit_count() > 4 and 3 not in got


def test_the_stage_takes_five_words_and_similarity(spark):
    import corpus_pipeline

    docs = frame(spark, odd_documents())
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == brute_firsts(odd_documents())


def test_no_rows(spark):
    assert near_copies.one_of_each_set(frame(spark, [(1, "a")]).limit(0)).count() == 0
    assert near_copies.one_of_each_set(frame(spark, [(1, None), (2, " ")])).count() == 1


def test_lists_of_many_blocks_and_batches(spark, monkeypatch):
    """Blocks of a few texts, and groups that end in the middle of a batch."""
    monkeypatch.setattr(near_copies, "BLOCK", 500)
    rows = near_rows()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.doc_id for r in near_copies.one_of_each_set(frame(spark, rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_firsts(rows)


def test_group_of_near_copies_whose_middle_is_missing(spark):
    """Some are linked to a few others only, and to no leader; columns clash."""
    import random

    base, r, rows = words(150, 7, 5000), random.Random(5), []
    for k in range(150):
        w = list(base)
        for x in r.sample(range(150), 1 + k % 7):
            w[x] = f"e{k}x{x}"
        if k % 5 == 0:  # a second edition
            w[20:34] = [f"second{j}" for j in range(14)]
        rows.append((k, " ".join(w)))
    d = spark.createDataFrame([(i, t, 0, "a", "b") for i, t in rows], "doc_id long, text string, __x long, rid string, first string").repartition(5)
    kept = near_copies.one_of_each_set(d)
    assert kept.columns == d.columns
    assert {x.doc_id for x in kept.collect()} == brute_firsts(rows)


def test_chances_of_a_pair_at_the_threshold():
    """What the docstring says of pairs at 0.8."""
    from math import comb

    n, p = near_copies.BANDS * near_copies.ROWS, near_copies.SIMILARITY
    assert (1 - p**near_copies.ROWS) ** near_copies.BANDS < 4e-8
    assert sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(near_copies.LEAST)) < 1e-9


def test_simhash_links_pairs_within_four_bits(spark, monkeypatch):
    """The stage's first step is SimHash's own index; its links are those of whole sets too."""
    rows = [(i, t) for i, t in near_rows() if t and t.split()] + [(900 + k, " ".join([*words(300, 3, 5000)[:299], f"last{k}"])) for k in range(8)]
    grams = {i: {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} for i, t in rows for w in [t.encode().lower().split()]}
    print_of = {i: simhash.fingerprint(t.encode(), 5) for i, t in rows}
    lows = {p: min(i for i in print_of if print_of[i] == p) for p in print_of.values()}
    alike = lambda a, b: 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])
    want = {(min(a, b), max(a, b)) for p, a in lows.items() for q, b in lows.items() if p < q and (p ^ q).bit_count() <= 4 and alike(a, b)}
    want |= {(lows[p], i) for i, p in print_of.items() if i != lows[p] and alike(lows[p], i)}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    classes = spark.createDataFrame([(i, signed(p)) for i, p in print_of.items()], "rid long, fp long")
    texts = spark.createDataFrame(rows, "rid long, text string")
    got = near_copies.simhash_links(texts, classes, 5, 0.8).collect()
    assert len(want) > 20 and {(min(r), max(r)) for r in map(tuple, got)} == want
    asked, made = [], near_copies.links
    monkeypatch.setattr(near_copies, "links", lambda *a: asked.append(1) or made(*a))
    assert {r.doc_id for r in near_copies.one_of_each_set(frame(spark, rows)).collect()} == brute_firsts(rows)
    assert asked == [1]
