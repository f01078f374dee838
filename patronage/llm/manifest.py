"""Merkle manifest of a table: digests of its rows in trees that are stored in van Emde Boas order.

Every group (language) has a binary tree over its leaves in order of their id. The tree is cut into aligned blocks of
``HEIGHT`` levels above 1,024 leaves; the roots of the blocks are the leaves of the blocks of the next tier, until one
block is left. The roots of the groups are the leaves of one more tree. A block is one row. Its digests lie in van Emde
Boas order: a tree is cut at half its height, the upper part comes first, then the lower trees from left to
right, each laid out the same way. Where a node lies follows from its depth and index alone (``address``), in the
construction as in the look-up of siblings, and a path touches few stretches of a block whatever the size of a cache line.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order_stats import join_on, ranked
from .common import saved

HEIGHT = 10  # steps from a leaf to the root of a full block: 1,024 leaves
SIZE = 32
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCKS = "group string, tier int, block bigint, n bigint, levels int, nodes binary"
PATHS = "group string, block bigint, place bigint, groups bigint, subroot binary, root binary, path binary"
PROOFS = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def address(levels: int, depth: int, index: np.ndarray | int) -> np.ndarray | int:
    """Place of a node in the van Emde Boas order of a complete tree with that many levels of nodes."""
    if levels == 1:
        return index * 0
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    below, inside = levels - top, depth - top
    return (1 << top) - 1 + (index >> inside) * ((1 << below) - 1) + address(below, inside, index & ((1 << inside) - 1))


@lru_cache(maxsize=None)
def _places(levels: int) -> list[list[int]]:
    return [address(levels, depth, np.arange(1 << depth)).tolist() for depth in range(levels)]


def parent(children: list[bytes]) -> bytes:
    """H of one or two digests, concatenated as hex text."""
    return sha256(b"".join(children).hex().encode()).digest()


def build(nodes: bytearray, levels: int, leaves: list[bytes], base: int = 0) -> bytes:
    """Fill the tree over ``leaves`` at ``base``: the lower trees, then the upper one over their roots; returns its root.

    A node without a right child is the H of the left one; trees without leaves stay zero.
    """
    if levels == 1:
        nodes[base * SIZE:(base + 1) * SIZE] = leaves[0]
        return leaves[0]
    top = levels // 2
    below = levels - top
    first, size, width = base + (1 << top) - 1, (1 << below) - 1, 1 << (below - 1)
    roots = [build(nodes, below, leaves[i:i + width], first + i // width * size) for i in range(0, len(leaves), width)]
    return build(nodes, top, [parent(roots[i:i + 2]) for i in range(0, len(roots), 2)], base)


def siblings(nodes: memoryview, levels: int, leaf: int, count: int) -> bytes:
    """Digests beside the path from a leaf to the root of its block, from the bottom; a node without a sibling adds none."""
    out, places = [], _places(levels)
    for depth in range(levels - 1, 0, -1):
        beside = leaf ^ 1
        if beside < count:
            at = places[depth][beside] * SIZE
            out.append(nodes[at:at + SIZE])
        leaf, count = leaf >> 1, (count + 1) >> 1
    return b"".join(out)


def fold(digest: bytes, place: int, count: int, path: bytes, steps: int) -> tuple[bytes, bytes]:
    """The digest ``steps`` levels up from ``place`` of ``count`` nodes, by the siblings of its path; and the unused rest of it."""
    at = 0
    for _ in range(steps):
        if place ^ 1 < count:
            beside, at = path[at:at + SIZE], at + SIZE
            digest = parent([beside, digest] if place & 1 else [digest, beside])
        else:
            digest = parent([digest])
        place, count = place >> 1, (count + 1) >> 1
    return digest, path[at:]


def field(column: Column) -> Column:
    """``-`` if null, else the UTF-8 byte count, ``:`` and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def row_digest(columns: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def leaf_table(
    docs: DataFrame, columns: Sequence[str] = COLUMNS, group_col: str = "lang", id_col: str = "doc_id",
    changed: Mapping[str, Column] | None = None, where: Column | None = None,
) -> DataFrame:
    """``group, doc_id, digest, changed, place, n``: a leaf per row, with its place among the ``n`` of its group.

    ``changed`` replaces columns in the rows that fulfil ``where``; their digest is in the column of that name, else it is null.
    Rows are dealt into ranges of (group, id, digest), so a group of any size is spread, and only one total a range is added up.
    """
    other = F.lit(None).cast("binary")
    if changed:
        other = F.when(where, row_digest([changed.get(c, F.col(c)) for c in columns]))
    rows = docs.select(
        F.col(group_col).cast("string").alias("group"), F.col(id_col).cast("bigint").alias("doc_id"),
        row_digest([F.col(c) for c in columns]).alias("digest"), other.alias("changed"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()]
    return saved(ranked(rows, order, ["group"], "place", "n"), "leaves")


def _levels(n: int) -> int:
    """Levels of the blocks of a group with ``n`` nodes in a tier: all, or just enough for the only block."""
    return min(HEIGHT, (n - 1).bit_length()) + 1


def _block_rows(tier: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels, rows = [], []
            for n, leaves in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                levels.append(_levels(n))
                nodes = bytearray(SIZE * ((1 << levels[-1]) - 1))
                build(nodes, levels[-1], [x["digest"] for x in leaves])
                rows.append(bytes(nodes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([tier] * len(rows), pa.int32()), batch.column(1), batch.column(2), pa.array(levels, pa.int32()), pa.array(rows, pa.binary())],
                _names(BLOCKS))

    return run


def _tier(leaves: DataFrame, tier: int) -> DataFrame:
    """Blocks of one tier from its leaves (group, place, n, digest); at most 1,024 of them meet in a row."""
    in_order = F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("leaves")
    blocks = leaves.groupBy("group", F.shiftright("place", HEIGHT).alias("block")).agg(F.first("n").alias("n"), in_order)
    return saved(blocks.mapInArrow(_block_rows(tier), BLOCKS), "manifest")


def _root_of(nodes: str) -> Column:
    return F.substring(nodes, 1, SIZE)  # the first node of the order


def _blocks_of(n: str = "n") -> Column:
    return F.shiftright(F.col(n) + ((1 << HEIGHT) - 1), HEIGHT)


_ONE = f"n <= {1 << HEIGHT}"
_MORE = f"n > {1 << HEIGHT}"


def tree(leaves: DataFrame) -> list[DataFrame]:
    """The manifest of ``leaves`` (group, place, n, digest): a table of blocks per tier, each written once.

    ``place`` counts from 0 among the ``n`` leaves of a group. A tier has a thousandth of the rows of the one below.
    """
    tiers = [_tier(leaves, 0)]
    while not (roots := tiers[-1].where(_MORE)).isEmpty():
        roots = roots.select("group", F.col("block").alias("place"), _blocks_of().alias("n"), _root_of("nodes").alias("digest"))
        tiers.append(_tier(roots, len(tiers)))
    return tiers


def group_roots(tiers: list[DataFrame]) -> DataFrame:
    """``group, digest``: the root of the last block of each group."""
    parts = [t.where(_ONE).select("group", _root_of("nodes").alias("digest")) for t in tiers]
    for part in parts[1:]:
        parts[0] = parts[0].unionByName(part)
    return parts[0]


def _path_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paths of all leaves of a block: their siblings inside it, then those on the block's own path."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            nodes, low = memoryview(r["nodes"]), r["block"] << HEIGHT
            count = min(r["n"] - low, 1 << HEIGHT)
            same = r["place"], r["groups"], r["subroot"], r["root"]
            out += [(r["group"], low + i, *same, siblings(nodes, r["levels"], i, count) + r["path"]) for i in range(count)]
        types = [pa.string(), *[pa.int64()] * 3, *[pa.binary()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, types)], _names(PATHS))


def paths(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """PATHS of the blocks of the lowest tier, from the last tier down; ``tops`` has those of the groups' roots.

    Both sides of every join have (group, block) once.
    """
    tops = tops.withColumn("block", F.lit(0).cast("bigint"))
    found = None
    for tier in reversed(tiers):
        last = join_on(tier.where(_ONE).select("group", "block"), tops, ["group", "block"]).select(*_names(PATHS))
        found = last if found is None else last.unionByName(found)
        if tier is not tiers[0]:
            found = saved(join_on(tier, found, ["group", "block"]).mapInArrow(_path_rows, PATHS), "paths")
    return found


def _proof_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            nodes, low, levels, blocks = memoryview(r["nodes"]), r["block"] << HEIGHT, r["levels"], -(-r["n"] >> HEIGHT)
            count = min(r["n"] - low, 1 << HEIGHT)
            subroot, root, above, known = r["subroot"].hex(), r["root"].hex(), r["path"].hex(), {}
            for x in r["members"]:
                slot = x["place"] - low
                own = siblings(nodes, levels, slot, count)
                top, _ = fold(x["changed"] or x["digest"], slot, count, own, levels - 1)
                if top not in known:  # from the root of the block on the paths are the same
                    whole, rest = fold(top, r["block"], blocks, r["path"], (blocks - 1).bit_length())
                    known[top] = fold(whole, r["place"], r["groups"], rest, (r["groups"] - 1).bit_length())[0].hex()
                out.append((x["doc_id"], x["digest"].hex(), subroot, root, sha256((own.hex() + above).encode()).hexdigest(), known[top], known[top] == root))
        types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, types)], _names(PROOFS))


def proofs(leaves: DataFrame, tiers: list[DataFrame] | None = None) -> DataFrame:
    """PROOFS of all leaves of ``leaf_table``: the siblings of each path as one digest, and the root that the path leads to.

    The path is folded from the changed digest where there is one; ``verified`` tells whether that gives the root. Groups are
    ordered by name, null first. Each block serves its leaves from one row, and its own path above comes down tier by tier.
    """
    tiers = tiers or tree(leaves)
    roots = saved(group_roots(tiers), "roots")
    ordered = saved(ranked(roots.withColumnRenamed("group", "name"), [F.col("name").asc_nulls_first()], [], "place", "n"), "groups")
    top = tree(ordered.select(F.lit("").alias("group"), "place", "n", "digest"))
    root = group_roots(top).select(F.col("digest").alias("root"))  # one row
    start = root.select(F.lit("").alias("group"), F.lit(0).cast("bigint").alias("place"), F.lit(1).cast("bigint").alias("groups"),
                        F.col("root").alias("subroot"), "root", F.unhex(F.lit("")).alias("path"))
    beside = join_on(top[0], paths(top, start), ["group", "block"]).mapInArrow(_path_rows, PATHS).select(F.col("block").alias("place"), "root", "path")
    tops = ordered.join(beside, "place").select(F.col("name").alias("group"), "place", F.col("n").alias("groups"), F.col("digest").alias("subroot"), "root", "path")
    tops = saved(tops, "tops")
    members = leaves.groupBy("group", F.shiftright("place", HEIGHT).alias("block")).agg(F.collect_list(F.struct("place", "doc_id", "digest", "changed")).alias("members"))
    found = join_on(tiers[0], paths(tiers, tops), ["group", "block"])
    return join_on(found, members, ["group", "block"]).mapInArrow(_proof_rows, PROOFS)


def verify(docs: DataFrame) -> DataFrame:
    """Proofs of all rows of ``documents``, those whose id has a crc32 that 7 divides with 1 more in ``n_chars`` (tampered).

    Nulls are ``-`` in a leaf and a group of their own; a null ``n_chars`` stays null and a row without an id is not tampered. Rows
    with one id are ordered by their digest, equal rows are leaves of their own. A text of any length is hashed whole, an empty
    one is ``0:``. An empty table gives no rows; other columns are not read.
    """
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return proofs(leaf_table(docs, changed={"n_chars": F.col("n_chars") + 1}, where=tampered))
