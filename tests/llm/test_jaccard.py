import random
from collections import Counter

import numpy as np
import pytest

from answerscope.llm import jaccard as J


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def plain(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, own in enumerate(sets):
        for g in own:
            where.setdefault(g, []).append(i)
    for i, own in enumerate(sets):
        for j, both in Counter(j for g in own for j in where[g] if j > i).items():
            if 100 * both >= 80 * (len(own) + len(sets[j]) - both):
                parent[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed, n=260):
    """Families whose members are edited to overlaps around 0.8, chains of them, a passage that many share, and copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage, rows = [word() for _ in range(60)], []
    while len(rows) < n:
        base = [word() for _ in range(rng.choice([3, 5, 6, 12, 40, 150, 400]))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 6, 25])):
            rows.append(" ".join(base))
            for _ in range(max(1, round(len(base) * rng.choice([0.005, 0.02, 0.03, 0.06])))):
                base[rng.randrange(len(base))] = word().upper()
            if rng.random() < 0.2:
                base.append(word())
    rows = rows + rng.sample(rows, 20) + [passage and " ".join(passage)] * 3
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "rounds", "tree_rows"), [(1, 2, 1024), (2, 0, 4), (3, 1, 1024)])
def test_components_equal_brute_force(docs_of, seed, rounds, tree_rows):
    rows = corpus(seed)
    got = J.jaccard_components(docs_of(rows), rounds=rounds, tree_rows=tree_rows).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_heads_hold_what_partners_share():
    """The bounds of the two prefixes, over random pairs that overlap just enough."""
    rng = np.random.default_rng(5)
    for _ in range(3000):
        n = int(rng.integers(1, 90))
        x = rng.choice(10**6, n, replace=False)
        m = int(rng.integers(J.needed(n), n + 1))
        y = np.concatenate([rng.choice(x, m, replace=False), rng.choice(np.arange(10**6, 2 * 10**6), int(rng.integers(0, n // 4 + 1)), replace=False)])
        both = m
        if 100 * both < 80 * (n + len(y) - both):
            continue
        hx, hy = (np.sort(v)[: J.head_length(len(v))] for v in (x, y))
        order = lambda v: (v * 7919) % 1000003  # noqa: E731  any second order
        kx, ky = (sorted(h, key=order)[: J.own_allowed(len(v))] for h, v in ((hx, x), (hy, y)))
        assert set(kx) & set(ky)


def test_trees_lose_no_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    sets = [np.unique(np.where(rng.random(40) < 0.06, rng.integers(0, 2**63, 40, dtype=np.int64), base)) for _ in range(150)]
    sets += [np.unique(rng.integers(0, 2**63, int(rng.integers(1, 90)), dtype=np.int64)) for _ in range(150)]
    bits = np.zeros((len(sets), J.BITS), dtype=np.uint8)
    for i, s in enumerate(sets):
        bits[i, s.view(np.uint64) >> np.uint64(64 - J.BITS.bit_length() + 1)] = 1
    spare = np.array([len(s) for s in sets]) - bits.sum(axis=1)
    packed, sizes, comps = np.packbits(bits, axis=1).view(np.uint64), np.array([len(s) for s in sets]), np.arange(len(sets)) % 40
    ids, a, b = np.arange(len(sets)), np.arange(0, 170), np.arange(170, 300)
    links = {(i, j) for i in ids for j in ids if i < j and comps[i] != comps[j] and 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - k)}
    tree = lambda at: J.SignatureTree(at, sizes[at], spare[at], packed[at], comps[at])
    own = tree(ids)
    found = [tuple(sorted(p)) for x, y in own.pairs(own, 80) for p in zip(x.tolist(), y.tolist(), strict=True)]
    assert len(found) == len(set(found)) and links <= set(found) and len(found) < 12_000
    across = {tuple(sorted(p)) for x, y in tree(a).pairs(tree(b), 80) for p in zip(x.tolist(), y.tolist(), strict=True)}
    assert {p for p in links if p[0] < 170 <= p[1]} <= across


def test_components_of_chains(session):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 120) if i % 30] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r.node: r.comp for r in J.components(session.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for a, b in edges:
        want.setdefault(a, a)
        want.setdefault(b, b)
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_edge_rows(edge):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    got = J.jaccard_components(edge).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)
    kept = J.drop_near_copies(edge)
    assert kept.columns == edge.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted("1 3 4 5 6 8 9 None None".split())
    assert J.jaccard_components(edge.limit(0)).count() == 0


def degrees(rows):
    """Distinct other sets that each row's set links to, by brute force."""
    sets = {s for _, t in rows if (s := shingles(t))}
    linked = Counter()
    for a in sets:
        for b in sets:
            if a != b and 100 * (both := len(a & b)) >= 80 * (len(a) + len(b) - both):
                linked[a] += 1
    return sorted(((d, linked[shingles(t)]) for d, t in rows), key=str)


@pytest.mark.parametrize(("seed", "tree_rows"), [(1, 1024), (2, 4)])
def test_links_equal_brute_force(docs_of, seed, tree_rows):
    """All links count, also those inside what is connected already; small blocks meet each other."""
    rows = corpus(seed)
    got = J.jaccard_components(docs_of(rows), tree_rows=tree_rows, links=True).collect()
    assert sorted(((r.doc_id, r.n_links) for r in got), key=str) == degrees(rows)
    assert sorted((tuple(r)[:3] for r in got), key=str) == plain(rows) and max(r.n_links for r in got) > 2


def test_links_of_edge_rows(edge):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    got = J.jaccard_components(edge, links=True)
    assert sorted(((r.doc_id, r.n_links) for r in got.collect()), key=str) == degrees(rows)
    assert J.jaccard_components(edge.limit(0), links=True).count() == 0


def test_comparing_the_sets_of_a_place_holds_little_beside_them():
    """512 sets of 1000 members of which all are shared: the bitmaps and the pairs at work stay narrow."""
    import tracemalloc

    rng = np.random.default_rng(5)
    members = [np.unique(rng.choice(40_000, 1000)).astype(np.int64) * 2**40 for _ in range(512)]
    left, right = np.triu_indices(512, 1)
    tracemalloc.start()
    both = J.common_members(members, left, right)
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    assert peak < 80, peak
    for k in rng.integers(0, len(left), 200):
        assert both[k] == len(np.intersect1d(members[left[k]], members[right[k]]))


def test_sets_without_common_members():
    members = [np.array([1, 2], dtype=np.int64), np.array([3], dtype=np.int64)]
    assert J.common_members(members, np.array([0]), np.array([1])).tolist() == [0]
