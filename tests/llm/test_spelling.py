"""Spelling variants against a plain version."""

import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from patronage.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows):
    found = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            found[run] += len(run) >= 7
    return {w: n for w, n in found.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows):
    words = plain_words(rows)
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 10 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out, key=str)


def edited(rnd, word, alphabet):
    at, kind = rnd.randrange(len(word) + 1), rnd.randrange(3)
    return word[:at] + (rnd.choice(alphabet) if kind else "") + word[at + (kind < 2):]


def corpus(rnd):
    bases = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(6, 12))) for _ in range(40)]
    words = []
    for base in bases:
        words += [base] * rnd.choice([1, 5, 60, 400])
        for _ in range(6):
            near = edited(rnd, base, "abcé")
            words += [near] * rnd.randrange(1, 12) + [edited(rnd, near, "abcß")] * rnd.randrange(1, 4)
    words += ["kettenwort"] * 500 + ["kettenwart"] * 40 + ["kettenwarx"] * 3  # a form of a form
    words += ["a" * n for n in range(7, 15) for _ in range(3)] + ["b" * 2000 + x + "c" * 2000 for x in ("", "b", "x", "xy") for _ in range(2)]
    rnd.shuffle(words)
    rows = [(rnd.choice([i, i, None]), " ".join(rnd.choice([w, w, w.upper(), w.title() + ","]) for w in words[i::60])) for i in range(60)]
    return rows + [rows[0], (5, None), (6, ""), (7, "12 3"), (None, "ÀÉÖßàéöÿ×÷ ÀÉÖßàéöÿ×÷")]


def test_variants(documents, rnd):
    rows = corpus(rnd)
    got = sorted(map(tuple, spelling.variants(documents(rows).repartition(3)).collect()), key=str)
    want = plain_variants(rows)
    assert got == want
    assert any(r[1] for r in want) and any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 3 for r in want)


def test_vocabulary(documents, rnd):
    rows = corpus(rnd)
    assert {r["word"]: r["n"] for r in spelling.vocabulary(documents(rows)).collect()} == plain_words(rows)


def test_empty(documents):
    assert spelling.variants(documents([])).count() == 0
    assert spelling.variants(documents([(1, "only short words, once thousands")])).count() == 0


def test_one_word(documents):
    rows = [(1, "sixteen sixteen"), (2, "sixteen")]
    assert list(map(tuple, spelling.variants(documents(rows)).collect())) == plain_variants(rows)


def test_hot_prefix_is_dealt(spark, monkeypatch):
    """The row of a node with many words is copied, and its states are spread over the copies."""
    monkeypatch.setattr(spelling, "HOT", 16)
    words = spark.createDataFrame([(f"prefix{chr(97 + i // 26)}{chr(97 + i % 26)}", 2) for i in range(500)], "word string, n bigint")
    edges, _ = spelling.trie(words)
    copies = edges.groupBy("node").agg(F.countDistinct("part").alias("n")).agg(F.max("n")).first()[0]
    assert copies == -(-500 // 16)
    near = Counter(r["word"] for r in spelling.near_words(words).collect())
    text = [r["word"] for r in words.collect()]
    assert near == Counter({w: sum(one_edit(w, x) for x in text) for w in text})


def test_edges_of_sorted_paths():
    """Every word has a chain of edges from its start; chains without a branch are one edge."""
    paths = sorted(">" + w for w in ("abcdefg", "abcdefgh", "abcdxyz", "abcq", "abdéé"))
    edges = {(node, label): (below, ends) for node, label, below, ends, *_ in spelling.sorted_edges(iter(paths))}
    assert edges == {
        (">abc", "d"): (3, False), (">abcd", "efg"): (2, True), (">abcdefg", "h"): (1, True), (">abcd", "xyz"): (1, True),
        (">abc", "q"): (1, True), (">abd", "éé"): (1, True)}
    assert list(spelling.sorted_edges(iter([]))) == []


def test_ranges_end_inside_a_prefix(spark):
    """Words of one prefix in many ranges: all neighbours are found, though no range sees the whole trie."""
    text = [f"aaaaaaa{x}{y}" for x in "abcdefgh" for y in "abcdefgh"]
    words = spark.createDataFrame([(w, 2) for w in text], "word string, n bigint").repartition(8)
    near = Counter(r["word"] for r in spelling.near_words(words).collect())
    assert near == Counter({w: sum(one_edit(w, x) for x in text) for w in text})


def test_levels_join_fewer_edges(spark, monkeypatch):
    """A level gets only edges at and below the nodes that it can stand at; no neighbour is lost, also behind many branches."""
    text = ["abcdefg"[:i] + x + "abcdefgh"[i:] + y for i in range(3, 8) for x in "klmn" for y in "rstu"]
    words = spark.createDataFrame([(w, 2) for w in text], "word string, n bigint").repartition(4)
    given, below = [], spelling._from_level
    monkeypatch.setattr(spelling, "_from_level", lambda edges, level: given.append(below(edges, level)) or given[-1])
    near = Counter(r["word"] for r in spelling.near_words(words).collect())
    assert near == Counter({w: sum(one_edit(w, x) for x in text) for w in text})
    n = [edges.count() for edges in given]
    assert len(n) > 3 and n == sorted(n, reverse=True) and n[-1] < n[0] / 2
