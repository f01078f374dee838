"""The size-aware join of shingle sets against all pairs."""

import re

import numpy as np
import pytest

from conftest_llm import prose
from patronage.llm import ngram_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[k:k + 4]) for k in range(max(1, len(words) - 3))) if words else frozenset()


def similar(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 85 * len(a | b)


def plain_linked(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for k in range(i):
            if find(i) != find(k) and similar(sets[i], sets[k]):
                root[find(i)] = find(k)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def changed(rnd, text, n):
    words = text.split()
    for _ in range(n):
        i = rnd.randrange(len(words))
        words[i:i + rnd.randrange(2)] = [prose(rnd, 1)] * rnd.randrange(2)
    return " ".join(words)


def corpus(rnd):
    """Families at every size, on both sides of the boundary, shared passages, copies in other cases and spaces."""
    texts = []
    for size in [4, 5, 6, 8, 9, 10, 12, 13, 14, 15, 16, 17, 18, 20, 23, 26, 30, 40, 60, 110, 300]:
        base = prose(rnd, size + 3)
        texts += [base] + [changed(rnd, base, rnd.randrange(0, 1 + max(1, size // 20))) for _ in range(6)]
        words = base.split()
        texts += [" ".join(words[:-1]), " ".join(words[1:]), " ".join(words + ["end"]), base.upper(), base.replace(" ", "\t\n")]
    passage = prose(rnd, 40)
    texts += [prose(rnd, 30) + " " + passage + " " + prose(rnd, 20) for _ in range(30)]
    texts += [None, None, "", "  \n", "one", "ONE", "one two three", "one two three four", "é é é é é", "É é é é é", "w " * 500, "w " * 700, "a b " * 200, "x" * 5000]
    rnd.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


def test_linked(documents, rnd):
    rows = corpus(rnd)
    rows += [rows[3], (None, rows[5][1]), (None, None), (None, "only here for once")]
    got = J.linked(documents(rows).repartition(4)).select("doc_id", "n_shingles", "component_id").collect()
    want = plain_linked(rows)
    assert sorted(map(tuple, got), key=str) == want
    assert len({r[2] for r in want}) < len(rows) - 60


@pytest.mark.parametrize("light", [0, 3, 13, 18])
def test_every_boundary_links_the_same(documents, rnd, monkeypatch, light):
    rows = corpus(rnd)
    monkeypatch.setattr(J, "boundary", lambda sizes: light)
    got = J.linked(documents(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == plain_linked(rows)


def test_blocks_of_a_large_family(documents, rnd, monkeypatch):
    """A family in many blocks, whose members are near the limit, so that one leader does not tie them all."""
    monkeypatch.setattr(J, "BLOCK", 5)
    base = prose(rnd, 120, longest=9)
    rows = [(i, changed(rnd, base, rnd.randrange(1, 7))) for i in range(60)]
    got = J.linked(documents(rows).repartition(3)).select("doc_id", "n_shingles", "component_id").collect()
    want = plain_linked(rows)
    assert sorted(map(tuple, got), key=str) == want
    assert 1 < len({r[2] for r in want}) < 60


def test_empty(documents):
    assert J.linked(documents([])).count() == 0
    assert [tuple(r)[:3] for r in J.linked(documents([(3, None)])).collect()] == [(3, 0, 3)]


def sets_at_the_limit(rnd, n, m):
    both = J.overlap(n, m)
    pool = np.unique(np.array([rnd.getrandbits(64) for _ in range(n + m - both)], "u8"))
    rnd_order = pool[np.array(rnd.sample(range(len(pool)), len(pool)))]
    return np.sort(rnd_order[:n]), np.sort(np.concatenate([rnd_order[:both], rnd_order[n:]]))


def test_linked_sets_always_meet(rnd):
    """At the least overlap that links, two sets share a list, whatever the sizes; small ones share a subset."""
    for n in [*range(1, 60), 100, 333, 1000, 5000]:
        for m in {n, J.partners(n)[-1], J.partners(n)[len(J.partners(n)) // 2]}:
            for _ in range(5):
                a, b = sets_at_the_limit(rnd, n, m)
                assert J._linked(a, b)
                assert set(J.list_keys(a).tolist()) & set(J.list_keys(b).tolist())
                if m <= 16:
                    assert set(J.subset_keys(a)[0].tolist()) & set(J.subset_keys(b)[0].tolist())


def test_subsets_prove_a_link(rnd):
    """Sets below the limit share no subset that one of them lists as the smaller set of a pair."""
    def smaller(x):
        key, small = J.subset_keys(x)
        return set(key[np.array(small)].tolist())

    for n in range(2, 17):
        for m in J.partners(n):
            a, b = sets_at_the_limit(rnd, n, max(n, m))
            b = np.sort(np.append(b[~np.isin(b, a[:1])], np.uint64(rnd.getrandbits(64)))) if np.isin(a[:1], b).all() else b
            if not J._linked(a, b):
                assert not smaller(a) & set(J.subset_keys(b)[0].tolist()) and not smaller(b) & set(J.subset_keys(a)[0].tolist())


def test_boundary_follows_the_cost():
    assert J.boundary({}) == 0
    few, many = J.boundary({10: 1000}), J.boundary({24: 1000})
    assert few >= 10 and many < 24
    assert J.subset_count(10) == sum(1 for _ in J.subset_keys(np.arange(10, dtype="u8"))[0])
