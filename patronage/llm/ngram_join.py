"""Similarity join of shingle sets, size-aware: subsets of small sets, scanned inverted lists for large ones.

Two sets of n <= m shingles link if they share at least ``overlap(n, m)`` of them. Below a boundary (light) a set lists its subsets of exactly
that size for each size its partner may have; sets that meet in one are linked, without a comparison. Above it (heavy) a set
scans inverted lists. A list of one shingle would hold every document of a shared passage, so a list is kept for the
shingles of a set in one range of their hash: the ranges outnumber the shingles that two similar sets may not share, so they agree
in a whole range at least. What meets in a list is compared. The boundary is where both ways cost the least rows.

Equal sets are one node. First every list is tied to one leader; what is linked to it is one class from then on. Then the pairs
of different classes that still share a list are compared, so no link between classes is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import saved, text_or_empty
from .near_copies import components, word_hashes

WORDS = 4
PERCENT = 85  # 100 * |both| >= 85 * |either|
LARGEST_LIGHT = 24  # largest boundary that is tried; a set of 25 has thousands of subsets
COMPARED = 8  # rows that a comparison of two sets costs as much as
BLOCK = 256  # nodes of a list or family in one block
LEAST = 8
ROWS = 1 << 21  # list rows that a task combines at once
ITEMS = "node binary, items binary"
SLOTS = 1024  # of the parities that a pair is tried by before it is compared
FOUND = "key bigint, handle bigint, other bigint"
LISTED = "key bigint, node binary, n bigint, least array<bigint>"
# The three lowest bits of a key tell what a row is.
LIST, EDGE, SUBSET, SMALL, KINDS = 0, 1, 2, 4, 7

_P, _Q = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _P
    x = (x ^ x >> np.uint64(27)) * _Q
    return x ^ x >> np.uint64(31)


def shingles(data: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles of UTF-8 bytes, A-Z lower-cased; fewer words are one shingle, none give none."""
    words = word_hashes(_LOWER[data])
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    h = np.full(n, np.uint64(min(k, len(words))))
    for i in range(min(k, len(words))):
        h = _mix(h * _Q + words[i:i + n])
    return np.unique(h)


def node_of(items: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(items.tobytes())[:12]


def handle_of(node: bytes) -> int:
    """Eight bytes that stand for a set until it is compared."""
    return int.from_bytes(node[:8], "little", signed=True)


def overlap(n: int, m: int) -> int:
    """Least number of common shingles of linked sets of n and m: 100 x >= 85 (n + m - x)."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def partners(n: int) -> range:
    """Sizes that a set linked to one of n shingles can have."""
    return range(-(-PERCENT * n // 100), 100 * n // PERCENT + 1)


def subset_count(n: int) -> int:
    return sum(comb(n, overlap(n, m)) for m in partners(n))


_BOUNDS = [1]


def size_class(n: int) -> int:
    """Sizes from a bound to the next; a partner of a set is in its class or the one beside it."""
    while _BOUNDS[-1] <= n:
        _BOUNDS.append(100 * _BOUNDS[-1] // PERCENT + 1)
    low, high = 0, len(_BOUNDS)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if _BOUNDS[middle] <= n else (low, middle)
    return low


def ranges(kind: int) -> tuple[int, int]:
    """Number of ranges for pairs whose smaller set is of that class, and how many of them two linked sets agree in at least."""
    size_class(_BOUNDS[kind])
    most = _BOUNDS[kind + 1] - 1
    apart = 3 * (most + 100 * most // PERCENT) // 37  # n + m - 2 * overlap(n, m) is at most 3/37 of n + m
    agree = 2 + apart // 16
    return apart + agree, agree


def list_keys(items: np.ndarray) -> np.ndarray:
    """Keys of the lists of a set: its shingles in each range of the hash, as the smaller and as the larger one of a pair.

    Linked sets agree in ``agree`` ranges at least. Empty ranges are left out, unless a set has that many of them.
    """
    kind = size_class(len(items))
    sums = np.zeros(len(items) + 1, "u8")
    np.cumsum(_mix(items * _P), out=sums[1:])
    keys = []
    for pair in {kind, max(0, kind - 1)}:
        count, agree = ranges(pair)
        edges = np.arange(count, dtype="u8") * np.uint64((1 << 64) // count)
        cut = np.append(np.searchsorted(items, edges), len(items))
        filled = cut[1:] > cut[:-1]
        key = _mix(_mix(sums[cut[1:]] - sums[cut[:-1]] + np.arange(count, dtype="u8")) + np.uint64(pair))
        keys.append(key[filled] if count - filled.sum() < agree else key)
    return np.concatenate(keys).view("i8")


def subset_keys(items: np.ndarray) -> tuple[np.ndarray, list[bool]]:
    """Keys of all subsets of the sizes at which partners link, and whether the set is the smaller one of the pair."""
    n, keys, small = len(items), [], []
    mixed = _mix(items * _Q)
    for m in partners(n):
        chosen = np.array(list(combinations(range(n), overlap(n, m))))
        key = _mix(mixed[chosen].sum(axis=1, dtype="u8") + np.uint64(min(n, m) << 32 | max(n, m)))
        keys.append(key)
        small += [n <= m] * len(key)
    return np.concatenate(keys).view("i8"), small


def boundary(sizes: dict[int, int]) -> int:
    """The largest light size, by the rows that ``sizes`` (sets per size) would give; sets that a heavy one can link to are listed too."""
    def cost(x: int) -> float:
        light = sum(c * subset_count(n) for n, c in sizes.items() if n <= x)
        first = -(-PERCENT * (x + 1) // 100)
        return light + sum(c * (2 * ranges(size_class(n))[0] + COMPARED) for n, c in sizes.items() if n >= first)

    return min(range(LARGEST_LIGHT + 1), key=cost)


def _bytes(text: pa.Scalar) -> np.ndarray:
    return np.frombuffer(text.as_buffer(), "u1")


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(_bytes(t)) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([len(h) for h in found], pa.int64()),
             pa.array(nodes := [node_of(h) if len(h) else None for h in found], pa.binary()), pa.array([x and handle_of(x) for x in nodes], pa.int64())],
            ["doc_id", "mark", "n", "node", "handle"])


def _found_rows(light: int):
    """The subsets of light sets and the lists of the others. Sets that meet in a task are tied there and one of them goes on."""
    first = -(-PERCENT * (light + 1) // 100)

    def batch_of(kind: int | np.ndarray, key: np.ndarray, handle: np.ndarray, other: np.ndarray | None = None) -> pa.RecordBatch:
        other = pa.nulls(len(key), pa.int64()) if other is None else pa.array(other)
        return pa.RecordBatch.from_arrays([pa.array(key & ~np.int64(KINDS) | kind), pa.array(handle), other], ["key", "handle", "other"])

    def combined(handles: list[int], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key = np.concatenate(keys)
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        head = np.append(True, key[1:] != key[:-1])
        leader = owner[np.flatnonzero(head)[np.cumsum(head) - 1]]
        pairs = np.unique((leader * len(keys) + owner)[leader != owner])
        names = np.array(handles, "i8")
        yield batch_of(LIST, key[head], names[owner[head]])
        yield batch_of(EDGE, _mix(pairs.astype("u8")).view("i8"), names[pairs // len(keys)], names[pairs % len(keys)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, handles, keys, held = set(), [], [], 0
            for text in batch.column(0):
                items = shingles(_bytes(text))
                node = node_of(items)
                if not len(items) or node in seen:
                    continue
                seen.add(node)
                handle = handle_of(node)
                if len(items) <= light:
                    key, small = subset_keys(items)
                    yield batch_of(SUBSET | np.where(small, SMALL, 0), key, np.full(len(key), handle))
                if len(items) >= first:
                    handles.append(handle)
                    keys.append(list_keys(items))
                    held += len(keys[-1])
                    if held >= ROWS:
                        yield from combined(handles, keys)
                        handles, keys, held = [], [], 0
            if handles:
                yield from combined(handles, keys)

    return run


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(_bytes(t)).tobytes() for t in batch.column(1)], pa.binary())], ["node", "items"])


def _listed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All lists of each set, with the set's least few lists."""
    for batch in batches:
        keys = [list_keys(np.frombuffer(x.as_buffer(), "u8")) for x in batch.column(1)]
        row = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
        n = pa.array([len(x.as_buffer()) // 8 for x in batch.column(1)], pa.int64())
        least = pa.array([np.sort(k)[:LEAST] for k in keys], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else []).cast(pa.int64()), batch.column(0).take(row), n.take(row), least.take(row)], ["key", "node", "n", "least"])


def parities(items: np.ndarray) -> bytes:
    """For each slot whether an odd number of items falls into it. Two sets have at least as many items apart as slots."""
    return np.packbits((np.bincount((items % np.uint64(SLOTS)).astype("i8"), minlength=SLOTS) & 1).astype("u1")).tobytes()


def _parity_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parities(np.frombuffer(x.as_buffer(), "u8")) for x in batch.column(1)], pa.binary())], ["node", "odd"])


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[at] == b).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with the same first ``keys`` columns."""
    unit, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != unit:
                if rows:
                    yield unit, rows
                unit, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield unit, rows


def _link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each unit, whose sets come before its pairs; a pair that links of the unit already connect is not compared."""
    unit, sets, root, a, b = None, {}, {}, [], []

    def find(x: bytes) -> bytes:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for key, left, right, items in zip(*(c.to_pylist() for c in batch.columns)):
            if key != unit:
                unit, sets, root = key, {}, {}
            if items is not None:
                sets[left], root[left] = np.frombuffer(items, "u8"), left
            elif (x := find(left)) != (y := find(right)) and _linked(sets[left], sets[right]):
                root[y] = x
                a.append(left)
                b.append(right)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
        a, b = [], []


def _compared(pairs: DataFrame, items: DataFrame, family: DataFrame) -> DataFrame:
    """Links among ``pairs``, compared in units: two blocks of nodes with all their pairs, each set once.

    ``family`` (node, label) puts nodes that are likely to meet into the same blocks of at most about ``BLOCK`` nodes.
    """
    sizes = family.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    block = F.xxhash64("label", F.pmod(F.xxhash64("node"), "parts")).alias("block")
    blocks = saved(family.join(sizes, "label").select("node", block), "blocks")
    for name in ("a", "b"):
        pairs = pairs.join(blocks.select(F.col("node").alias(name), F.col("block").alias(f"{name}_block")), name)
    unit = F.xxhash64(F.least("a_block", "b_block"), F.greatest("a_block", "b_block")).alias("unit")
    pairs = saved(pairs.select(unit, "a", "b"), "units")
    members = pairs.select("unit", F.explode(F.array("a", "b")).alias("node")).distinct().join(items, "node")
    rows = members.select("unit", F.col("node").alias("a"), F.lit(None).cast("binary").alias("b"), "items")
    rows = rows.unionByName(pairs.withColumn("items", F.lit(None).cast("binary")))
    ordered = rows.repartition("unit").sortWithinPartitions("unit", F.col("b").asc_nulls_first())
    return saved(ordered.mapInArrow(_link_rows, "a binary, b binary"), "links")


def _met_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different classes in a block of a list, or of two blocks of it, that their sizes and parities allow to be linked.

    Linked sets have at most 3/37 of their items apart, so no link is lost. A pair that also shares a lesser list, as far as the least lists of
    both tell, is left to that one.
    """
    for (key, one, two), rows in _runs(batches, 3):
        if len(rows) < 2:
            continue
        node, kind, n, block, least, odd = zip(*rows)
        numbers = {k: i for i, k in enumerate(set(kind))}
        kind, n, block = np.array([numbers[k] for k in kind]), np.array(n, "i8"), np.array(block)
        odd = np.frombuffer(b"".join(odd), "u8").reshape(len(rows), -1)
        table = np.full((len(rows), LEAST), np.iinfo("i8").max)
        for i, x in enumerate(least):
            table[i, :len(x)] = x
        a, b = [], []
        for i in range(len(rows) - 1):
            fits = (kind[i + 1:] != kind[i]) & (100 * np.minimum(n[i + 1:], n[i]) >= PERCENT * np.maximum(n[i + 1:], n[i]))
            if one != two:
                fits &= block[i + 1:] != block[i]
            at = np.flatnonzero(fits) + i + 1
            if not len(at):
                continue
            at = at[37 * np.bitwise_count(odd[at] ^ odd[i]).sum(axis=1, dtype="i8") <= 3 * (n[at] + n[i])]
            lesser = table[i][table[i] < key]
            if len(at) and len(lesser):
                at = at[~np.isin(table[at], lesser).any(axis=1)]
            a += [min(node[i], node[j]) for j in at.tolist()]
            b += [max(node[i], node[j]) for j in at.tolist()]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _still_apart(items: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of different classes that share a list; a list of many sets is dealt into blocks, and every two of them meet."""
    listed = saved(items.mapInArrow(_listed_rows, LISTED).join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")), "listed")
    kind = F.xxhash64("class")
    several = listed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min(kind).alias("low"), F.max(kind).alias("high")).where("low != high")
    rest = listed.join(several.select("key", F.ceil(F.col("rows") / BLOCK).alias("blocks")), "key")
    rest = rest.join(items.mapInArrow(_parity_rows, "node binary, odd binary"), "node")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    unit = ["key", "one", "two"]
    rest = rest.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "node", "class", "n", "block", "least", "odd")
    met = rest.repartition(*unit).sortWithinPartitions(*unit)
    return met.mapInArrow(_met_rows, "a binary, b binary").distinct()


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def set_links(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, class``: connected sets of ``sets`` (doc_id, mark, n, node, handle); ``texts`` has mark and text."""
    few = sets.where(F.col("n").between(1, LARGEST_LIGHT)).select("n", "node").distinct().groupBy("n").count().collect()  # a row a size
    light = boundary({r["n"]: r["count"] for r in few})
    found = texts.select("text").mapInArrow(_found_rows(light), FOUND)
    kind = F.col("key").bitwiseAND(F.lit(EDGE | SUBSET))
    found = found.withColumn("other", F.coalesce("other", F.when(kind == LIST, F.min("handle").over(Window.partitionBy("key")))))
    found = saved(found.where((kind == SUBSET) | (F.col("handle") != F.col("other"))), "found")

    # From handles to the sets they stand for.
    met = found.where(kind != SUBSET).select(F.least("handle", "other").alias("a"), F.greatest("handle", "other").alias("b")).distinct()
    subsets = found.where(kind == SUBSET).select(F.col("key").bitwiseAND(F.lit(~KINDS)).alias("key"), "handle", F.col("key").bitwiseAND(F.lit(SMALL)).alias("small"))
    smallest = subsets.where("small > 0").groupBy("key").agg(F.min("handle").alias("leader"))
    sure = subsets.join(smallest, "key").where("handle != leader").select(F.col("handle").alias("a"), F.col("leader").alias("b")).distinct()
    known = sets.where("node is not null").select("handle", "node").distinct()

    def of_handles(pairs: DataFrame) -> DataFrame:
        for name in ("a", "b"):
            pairs = pairs.join(known.select(F.col("handle").alias(name), F.col("node").alias(f"{name}_node")), name)
        return pairs.select(*_ordered("a_node", "b_node"))

    pairs, sure = saved(of_handles(met), "pairs"), of_handles(sure)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.col("a").alias("label")).groupBy("node").agg(F.min("label").alias("label"))
    nodes = saved(nodes, "families")
    marks = sets.join(nodes.select("node"), "node").groupBy("node").agg(F.min("mark").alias("mark"))
    items = marks.join(texts, "mark").dropDuplicates(["node"]).select("node", "text").mapInArrow(_item_rows, ITEMS)
    items = saved(items, "items")
    links = saved(_compared(pairs, items, nodes).unionByName(sure), "links")
    classes = components(links)
    more = saved(_still_apart(items, classes).join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        classes = components(_compared(more, items, nodes), classes)
    return classes


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, node``: per document the size of its set of distinct 4-word shingles and the least id that links reach.

    Null, empty and blank texts have no shingles and link with nothing (``component_id`` is their id). Copies, repeated rows included, are one
    node and linked; a null id is never the least one of others. Long texts are taken whole. Only links between classes of sets are compared, and
    neither lists, partners nor candidates are capped. An empty table gives no rows; other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    texts = texts.withColumn("mark", F.unhex(F.md5("text")))
    sets = saved(texts.select("doc_id", "mark", "text").mapInArrow(_set_rows, "doc_id bigint, mark binary, n bigint, node binary, handle bigint"), "sets")
    classes = set_links(sets, texts.select("mark", "text"))
    ids = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low")).join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    ids = saved(ids, "ids")
    least = ids.groupBy("class").agg(F.min("low").alias("component_id"))
    out = sets.join(ids.join(least, "class").select("node", "component_id"), "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "node")
