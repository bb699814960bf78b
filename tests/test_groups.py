import random

import pytest

from loamwork.operators import groups


def brute_roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "cliques"])
def test_components(spark, kind):
    r = random.Random(7)
    links = {
        "chain": [(i, i + 1) for i in range(300)],
        "star": [(1000, i) for i in range(400)] + [(2000, 1000), (5000, 5001)],
        "random": [(r.randrange(400), r.randrange(400)) for _ in range(250)],
        "cliques": [(10 * k + i, 10 * k + j) for k in range(20) for i in range(5) for j in range(5)],
    }[kind]
    nodes = {x for u, v in links if u != v for x in (u, v)}
    want = brute_roots(nodes, links)
    got = groups.components(spark.createDataFrame(links + links[:5], "u long, v long").repartition(5)).collect()
    assert {x.node: x.root for x in got} == want and len(got) == len(want)


def test_no_links(spark):
    assert groups.components(spark.createDataFrame([], "u long, v long")).collect() == []
    assert groups.components(spark.createDataFrame([(3, 3)], "u long, v long")).collect() == []


def texts():
    r = random.Random(11)
    word = lambda: f"w{r.randrange(3000)}"
    out = {}
    base = [word() for _ in range(80)]
    for i in range(60):  # a crowd of near copies of one text, and of each other only through it
        w = list(base)
        w[r.randrange(80)] = word()
        out[i] = " ".join(w)
    chain = [word() for _ in range(60)]
    for i in range(60, 75):  # each near the next, the ends far apart
        chain = [*chain[2:], word(), word()]
        out[i] = " ".join(chain)
    for i in range(75, 120):
        out[i] = " ".join(word() for _ in range(r.randrange(1, 40)))
    out |= {120: out[3], 121: out[70].upper(), 122: "", 123: "  ", 124: None, 125: None, 126: "a b", 127: " ".join(base[:40]) + " " + " ".join(word() for _ in range(40))}
    return out


def brute_groups(rows, words=5, similarity=0.8):
    sets = {}
    for i, t in rows.items():
        if t is not None:
            w = t.lower().strip().split() or [""]
            sets[i] = {" ".join(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity]
    return brute_roots(rows, links), links


def test_groups_against_brute_force(spark):
    rows = texts()
    d = spark.createDataFrame([(t, i, "x") for i, t in rows.items()], "text string, id long, group_id string").repartition(6)
    want, _ = brute_groups(rows)
    got = {r.id: (r.group_id, r.n_rows) for r in groups.similar_groups(d, "id", "text").collect()}
    sizes = {g: sum(x == g for x in want.values()) for g in want.values()}
    assert got == {i: (g, sizes[g]) for i, g in want.items()}
    assert sizes[0] > 60 and len({want[i] for i in range(60, 75)}) < 15


def test_a_crowd_is_not_paired_with_itself(spark, monkeypatch):
    """Sixty near copies that are similar only where they changed nearby: few are left to compare one by one."""
    rows = {i: t for i, t in texts().items() if i < 60}
    want, links = brute_groups(rows)
    assert len(set(want.values())) == 1 and len(links) < 60 * 59 / 6
    compared = []
    cross, leaders = groups._cross_pairs, groups._leader_pairs
    monkeypatch.setattr(groups, "_cross_pairs", lambda *a: compared.append(cross(*a).count()) or cross(*a))
    monkeypatch.setattr(groups, "_leader_pairs", lambda *a: compared.append(leaders(*a).count()) or leaders(*a))
    got = groups.similar_groups(spark.createDataFrame(list(rows.items()), "id long, text string"), "id", "text").collect()
    assert {r.id: r.group_id for r in got} == want
    assert max(compared[:6]) <= 3 * 60 and sum(compared) < 60 * 59 / 2  # a round grows with the crowd


@pytest.mark.parametrize("leaders", [0, 1])
def test_what_leaders_leave_is_compared(spark, monkeypatch, leaders):
    monkeypatch.setattr(groups, "LEADERS", leaders)
    rows = texts()
    got = groups.similar_groups(spark.createDataFrame(list(rows.items()), "id long, text string"), "id", "text").collect()
    assert {r.id: r.group_id for r in got} == brute_groups(rows)[0]


def test_empty_table(spark):
    assert groups.similar_groups(spark.createDataFrame([], "id long, text string"), "id", "text").collect() == []


def test_sets_that_cannot_link_are_not_kept(spark):
    """Unrelated texts go before any key is made; what links stays, short texts and copies too."""
    from loamwork.operators import joins

    rows = {i: " ".join(f"u{i}x{k}" for k in range(200)) for i in range(40)}
    rows |= {100 + i: " ".join([f"n{k}" for k in range(200)] + [f"end{i}"]) for i in range(4)}
    rows |= {200: "a short text", 201: "a short  TEXT", 202: "", 203: rows[100], 204: None}
    d = spark.createDataFrame(list(rows.items()), "id long, text string")
    firsts, reps = joins.distinct_texts(d)
    assert {r.id: r.rep for r in reps.collect()} == {i: 100 if i == 203 else i for i in rows if i != 204}
    kept = {r.id for r in joins.linkable_sets(firsts, "text", 0.8).collect()}
    assert {100, 101, 102, 103, 200, 201} <= kept and len(kept & set(range(40))) < 4 and 203 not in kept
    pairs = {(r.id_a, r.id_b) for r in joins.shingle_pairs(firsts, "id", "text").collect()}
    assert pairs == {(a, b) for a in range(100, 104) for b in range(a + 1, 104)} | {(200, 201)}


def test_texts_that_only_share_passages_are_not_compared(spark, monkeypatch):
    """Every passage is in many texts and no two texts are similar, but for near copies: sets are moved for these only."""
    passage = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(12)]
    rows = {100 * i + j: f"{passage[i]} {passage[j]}" for i in range(12) for j in range(12) if i != j}
    rows |= {5000 + i: f"{passage[i]} {passage[i + 1]} w{i}" for i in range(5)} | {7000 + i: " ".join(f"u{i}x{k}" for k in range(50)) for i in range(20)} | {9000: None, 9001: rows[1]}
    compared, kept = [], []
    verify, keys = groups.jaccard_of, groups.prefix_keys
    monkeypatch.setattr(groups, "jaccard_of", lambda pairs, *a: compared.append(pairs.count()) or verify(pairs, *a))
    monkeypatch.setattr(groups, "prefix_keys", lambda sets, *a: kept.append(sets.count()) or keys(sets, *a))
    got = groups.similar_groups(spark.createDataFrame(list(rows.items()), "id long, text string"), "id", "text").collect()
    assert {r.id: r.group_id for r in got} == brute_groups(rows)[0]
    assert 5 <= sum(compared) < 100 and kept[0] < 140
