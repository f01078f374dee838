"""The Merkle manifest against plain trees."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import prose
from patronage.llm import manifest

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, digest string, place int, n string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def plain_proofs(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[name] = plain_levels([plain_leaf(r) for r in groups[name]])
    top = plain_levels([trees[name][-1][0] for name in names]) if names else None
    out = []
    for k, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            tampered = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            digest, path = plain_leaf((*r[:3], r[3] + 1, r[4]) if tampered else r), []
            for levels, at in ((trees[name], i), (top, k)):
                for level in levels[:-1]:
                    if at ^ 1 < len(level):
                        path.append(level[at ^ 1])
                        digest = h(path[-1] + digest if at & 1 else digest + path[-1])
                    else:
                        digest = h(digest)
                    at >>= 1
            root = top[-1][0]
            out.append((r[0], plain_leaf(r), trees[name][-1][0], root, h("".join(path)), digest, digest == root))
    return sorted(out, key=str)


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("levels", range(1, 12))
def test_address_is_recursive_halving(levels):
    """All places once; the upper half of the levels first, then each lower tree in one stretch."""
    places = [np.atleast_1d(manifest.address(levels, d, np.arange(1 << d))).tolist() for d in range(levels)]
    assert sorted(x for level in places for x in level) == list(range((1 << levels) - 1))
    if levels > 1:
        top = levels // 2
        assert sorted(x for level in places[:top] for x in level) == list(range((1 << top) - 1))
        for k in range(1 << top):
            below = [x for d in range(top, levels) for x in places[d][k << (d - top):(k + 1) << (d - top)]]
            assert max(below) - min(below) == len(below) - 1 == (1 << (levels - top)) - 2


@pytest.mark.parametrize("count", [1, 2, 3, 5, 8, 13, 16])
def test_block(count):
    leaves = [bytes([i]) * 32 for i in range(count)]
    levels = manifest._levels(count)
    nodes = bytearray(32 * ((1 << levels) - 1))
    root = manifest.build(nodes, levels, leaves)
    plain = plain_levels([x.hex() for x in leaves])
    assert root.hex() == plain[-1][0] == nodes[:32].hex()
    for i, leaf in enumerate(leaves):
        path = manifest.siblings(memoryview(nodes), levels, i, count)
        assert manifest.fold(leaf, i, count, path, levels - 1) == (root, b"")
        assert manifest.fold(b"?" * 32, i, count, path, levels - 1)[0] != root


def test_verify(spark, rnd):
    langs = ["en"] * 12 + ["de", "fr", "é", "z", None]
    rows = [(rnd.choice([i, i, None]), rnd.choice(["s", None]), rnd.choice(langs), rnd.choice([len(prose(rnd, 3)), None]), rnd.choice(["", None, prose(rnd, 5)])) for i in range(400)]
    rows += rows[:5] + [(7, "s", "en", 3, "one"), (7, "s", "en", 3, "two"), (900, "s", "only", 1, "x"), (901, "s", "long", 300_000, "ä" * 300_000)]
    got = manifest.verify(made(spark, rows).repartition(5)).collect()
    want = plain_proofs(rows)
    assert sorted(map(tuple, got), key=str) == want
    assert any(not r["verified"] for r in got) and any(r["verified"] for r in got)


@pytest.mark.parametrize("rows", [[], [(14, "s", None, 1, "a")], [(14, None, "en", 1, "a"), (15, None, "en", None, None)]])
def test_few_rows(spark, rows):
    assert sorted(map(tuple, manifest.verify(made(spark, rows)).collect()), key=str) == plain_proofs(rows)


def test_several_tiers(spark):
    """A group of more than 2,048 leaves: two tiers, the last block not full, and the path of every row gives the root."""
    rows = [(i, "s", "en" if i % 50 else "de", i, str(i)) for i in range(2150)]
    leaves = manifest.leaf_table(made(spark, rows))
    tiers = manifest.tree(leaves)
    assert len(tiers) == 2 and tiers[0].where("group = 'en'").count() == 3
    got = manifest.proofs(leaves, tiers)
    assert got.where(~F.col("verified")).isEmpty()
    want = {r[:5] for r in plain_proofs(rows)}
    assert {tuple(r)[:5] for r in got.collect()} == want
