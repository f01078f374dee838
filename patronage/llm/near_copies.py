"""Near copies by Order MinHash: sketches of several least occurrence-labelled k-mers in the order of the text.

A text is the sequence of its k-mers of five words; the i-th occurrence of a k-mer is an item of its own. A sketch takes the
least few items under a seeded hash and keeps them in text order, so that texts meet in it if they share items in the same
order. Texts of few items also meet in exact keys (``few_keys``). Candidates are verified by a banded alignment of the item sequences: the similarity is
aligned / (items of both - aligned), at least 0.8.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, saved

WORDS = 5
SIMILARITY = 0.8
SKETCHES = 20
LEAST = 4
FEW = 14  # items of a text that also gets exact keys
BLOCK = 512  # nodes of a bucket in one block
NEAREST = 4  # close pairs of a node that are aligned before the rest
NODE_BITS = 16  # bits of the map of nodes for each of them
MAP_BITS = 1 << 26  # bits of the map of nodes at most; a fuller one lets more texts through
_WIDTH = 1 << 16  # items hashed at once
_REMEMBERED = 32 << 20

_BASE, _P, _Q = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _P
    x = (x ^ x >> np.uint64(27)) * _Q
    return x ^ x >> np.uint64(31)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), "u8")
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLE = {"up": _powers(int(_BASE), 1 << 14), "down": _powers(pow(int(_BASE), -1, 1 << 64), 1 << 14)}


def _table(name: str, n: int) -> np.ndarray:
    if len(_TABLE[name]) < n:
        _TABLE[name] = _powers(int(_BASE) if name == "up" else pow(int(_BASE), -1, 1 << 64), n)
    return _TABLE[name][:n]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each word of UTF-8 bytes: a polynomial in the bytes, from prefix sums."""
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[data], [True])).view("i1")))
    first, end = edges[::2], edges[1::2]
    if not len(first):
        return np.zeros(0, "u8")
    sums = np.zeros(len(data) + 1, "u8")
    np.cumsum((data.astype("u8") + np.uint64(1)) * _table("up", len(data)), out=sums[1:])
    return _mix((sums[end] - sums[first]) * _table("down", len(data))[first])


def items(data: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of the occurrence-labelled k-mers of a text in order; fewer than k words are one item."""
    words = word_hashes(data)
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    h = np.zeros(n, "u8")
    for i in range(min(k, len(words))):
        h = h * _BASE + words[i:i + n]
    h = _mix(h)
    order = np.argsort(h, kind="stable")
    runs = h[order]
    again = runs[1:] == runs[:-1]
    if again.any():
        place = np.arange(n)
        start = np.maximum.accumulate(np.where(np.concatenate(([True], ~again)), place, 0))
        label = np.empty(n, "u8")
        label[order] = (place - start).astype("u8")
        h = np.where(label > 0, _mix(h + label * _P), h)
    return h


def sketches(h: np.ndarray, count: int = SKETCHES, least: int = LEAST) -> np.ndarray:
    """One key per seed: its least items in text order."""
    seeds = _mix(np.arange(1, count + 1, dtype="u8") * _BASE)[:, None]
    rows = np.arange(count)
    place = np.zeros((count, 0), "i8")
    value = np.zeros((count, 0), "u8")
    for low in range(0, len(h), _WIDTH):
        v = (h[low:low + _WIDTH] ^ seeds) * _P
        v ^= v >> np.uint64(32)
        for _ in range(min(least, v.shape[1])):
            at = v.argmin(axis=1)
            place = np.column_stack((place, at + low))
            value = np.column_stack((value, v[rows, at]))
            v[rows, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
    if place.shape[1] > least:
        first = np.argsort(value, axis=1, kind="stable")[:, :least]
        place = np.take_along_axis(place, first, axis=1)
    place.sort(axis=1)
    key = seeds[:, 0].copy()
    for column in h[place].T:
        key = _mix(key * _BASE + column)
    return key.view("i8")


@lru_cache
def _without(n: int, d: int) -> np.ndarray:
    return np.array(list(combinations(range(n), n - d)))


def few_keys(h: np.ndarray) -> np.ndarray:
    """Keys of a text of few items: all of them, and all but each one or two.

    Two such texts with up to 26 items together are similar only if two items at most are not aligned, so they share one of
    these keys: one text without one or two items is the other, or both are equal without one.
    """
    n = len(h)
    found = [np.zeros(0, "u8")]
    if LEAST <= n <= FEW:
        for d in range(1 + (n > 4) + (n > 9)):
            key = np.full(len(_without(n, d)), _Q)
            for column in h[_without(n, d)].T:
                key = _mix(key * _BASE + column)
            found.append(key)
    return np.unique(np.concatenate(found)).view("i8")


def similarity(a: np.ndarray, a_order: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned items over the items of both, 0.0 where it is less than ``least``.

    At this similarity at most (n + m)(1 - s) / (1 + s) items of both are not aligned, so an alignment stays that near to
    the diagonal. Items differ within a text, so the alignment is the longest increasing run of the
    matched places inside the band.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    ranked = a[a_order]
    at = np.minimum(np.searchsorted(ranked, b), n - 1)
    there = np.flatnonzero(ranked[at] == b)
    place = a_order[at[there]]
    band = (n + m) * (1 - least) / (1 + least)
    place = place[np.abs(place - there) <= band]
    need = least * (n + m) / (1 + least) - 1e-9
    if len(place) < need:
        return 0.0
    if (np.diff(place) <= 0).any():
        tails: list[int] = []
        for x in place.tolist():
            i = bisect_left(tails, x)
            tails[i:i + 1] = [x]
        aligned = len(tails)
    else:
        aligned = len(place)
    return aligned / (n + m - aligned) if aligned >= need else 0.0


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, rows = [], []
        for i, text in enumerate(batch.column(1)):
            h = items(np.frombuffer(text.as_buffer(), "u1"))
            if len(h):
                keys.append(np.concatenate((sketches(h), few_keys(h))))
                rows.append(i)
        if rows:
            node = batch.column(0).take(pa.array(np.repeat(rows, [len(x) for x in keys])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), node], ["key", "node"])


def _parities(h: np.ndarray) -> np.ndarray:
    """For each slot of the hash whether an odd number of items falls into it; at least two slots an item, as bytes."""
    bits = max(64, 1 << (2 * len(h) - 1).bit_length())
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype("i8"), minlength=bits) & 1).astype("u1"), bitorder="little")


def _parity_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [items(np.frombuffer(text.as_buffer(), "u1")) for text in batch.column(1)]
        columns = [batch.column(0), pa.array([len(h) for h in found], pa.int64()), pa.array([_parities(h).tobytes() for h in found], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["node", "n", "parities"])


def _close(rows: list[tuple], one: bool, least: float) -> Iterator[tuple[bytes, bytes, int]]:
    """The pairs of rows (node, class, block, n, parities) of different classes that can be similar; of different blocks unless ``one``.

    An item that only one of two texts has changes one parity, so the texts differ in as many items as parities at least. Similar
    texts differ in at most (n + m)(1 - s) / (1 + s) items, and no pair that is left out here is similar.
    """
    widths: dict[int, list[tuple]] = {}
    for row in rows:
        widths.setdefault(len(row[4]), []).append(row)
    numbers: dict[bytes, int] = {}
    tables = {}
    for width, same in widths.items():
        bits = np.frombuffer(b"".join(r[4] for r in same), "u8").reshape(len(same), -1)
        tables[width] = same, bits, *(np.array(x, "i8") for x in zip(*((numbers.setdefault(r[1], len(numbers)), r[2], r[3]) for r in same)))
    for width, (same, bits, kind, block, n) in tables.items():
        for other in tables:
            if other < width:
                continue
            others, far, far_kind, far_block, m = tables[other]
            while far.shape[1] > bits.shape[1]:  # slots that the narrower text does not tell apart
                far = far[:, :far.shape[1] // 2] ^ far[:, far.shape[1] // 2:]
            for i in range(len(same)):
                low = i + 1 if other == width else 0
                fits = (far_kind[low:] != kind[i]) & (np.minimum(m[low:], n[i]) >= least * np.maximum(m[low:], n[i]))
                if not one:
                    fits &= far_block[low:] != block[i]
                at = np.flatnonzero(fits) + low
                if not len(at):
                    continue
                odd = np.bitwise_count(far[at] ^ bits[i]).sum(axis=1, dtype="i8")
                near = odd <= (n[i] + m[at]) * (1 - least) / (1 + least) + 1e-9
                for j, x in zip(at[near].tolist(), odd[near].tolist()):
                    a, b = same[i][0], others[j][0]
                    yield (a, b, x) if a < b else (b, a, x)


def _close_rows(least: float):
    """The close pairs of each unit: a block of a bucket or two of them, in rows that are sorted by unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []

        def ended() -> pa.RecordBatch:
            a, b, odd = list(zip(*set(_close(rows, unit[1] == unit[2], least)))) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(odd, pa.int64())], ["a", "b", "odd"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != unit:
                    if len(rows) > 1:
                        yield ended()
                    unit, rows = row[:3], []
                rows.append(row[3:])
        if len(rows) > 1:
            yield ended()

    return run


def _close_pairs(rest: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``a, b, odd``: the pairs of different classes in a bucket of ``rest`` (key, node, class) that can be similar.

    A bucket is dealt into blocks of about ``BLOCK`` nodes, and every two of its blocks meet in a unit of their own.
    """
    several = rest.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("class").alias("low"), F.max("class").alias("high")).where("low != high")
    several = several.select("key", F.ceil(F.col("rows") / BLOCK).alias("blocks"))
    rest = saved(rest.join(several, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")), "several")
    nodes = rest.select("node").distinct()
    parities = saved(texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(_parity_rows, "node binary, n bigint, parities binary"), "parities")
    met = rest.join(parities, "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    unit = ["key", "one", "two"]
    met = met.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "node", "class", "block", "n", "parities")
    met = met.repartition(*unit).sortWithinPartitions(*unit)
    return met.mapInArrow(_close_rows(least), "a binary, b binary, odd bigint").distinct()


def _links(least: float):
    """The pairs (a, b) of a batch whose texts are similar. Items of recent texts are remembered, up to ``_REMEMBERED`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        held = 0

        def of(name: bytes, text: pa.Scalar) -> np.ndarray:
            nonlocal held
            if name not in known:
                h = items(np.frombuffer(text.as_buffer(), "u1"))
                if held + h.nbytes > _REMEMBERED:
                    known.clear()
                    held = 0
                known[name] = h
                held += h.nbytes
            return known[name]

        last, order = None, None
        for batch in batches:
            keep = []
            first, second = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (x, y) in enumerate(zip(first, second)):
                a, b = of(x, batch.column(2)[i]), of(y, batch.column(3)[i])
                if x != last:
                    last, order = x, np.argsort(a)
                keep.append(similarity(a, order, b, least) > 0)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """``node, class``: the least node that each node of ``links`` (a, b) is connected to.

    Every round a node takes the least class among its neighbours' and its own, and then the class of that
    class; rounds are written to the shared folder. ``start`` gives classes that are known to be connected.
    """
    edges = links.select("a", "b").union(links.select("b", "a"))
    if start is not None:
        edges = edges.union(start.select(F.col("node").alias("a"), F.col("class").alias("b"))).union(start.select("class", "node"))
    edges = saved(edges.where("a != b"), "edges")
    classes = saved(edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("class")), "classes")
    while True:
        near = edges.join(classes.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "class", F.lit(None).cast("binary").alias("old"))
        lower = near.unionByName(classes.withColumn("old", F.col("class"))).groupBy("node").agg(F.min("class").alias("class"), F.max("old").alias("old"))
        above = classes.select(F.col("node").alias("class"), F.col("class").alias("above"))
        lower = lower.join(above, "class", "left").select("node", F.least("class", F.coalesce("above", "class")).alias("class"), "old")
        lower = saved(lower, "classes")
        classes = lower.select("node", "class")
        if lower.where("class != old").isEmpty():
            return classes


def _compared(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs whose texts are similar. A text travels once to its pairs as ``b`` and the pair then to its ``a``."""
    second = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    both = second.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a").select("a", "b", "a_text", "b_text")
    return both.mapInArrow(_links(least), "a binary, b binary")


def _marked(known: DataFrame, nodes: DataFrame, most: int = MAP_BITS) -> DataFrame:
    """``node, text`` of ``known`` whose slot one of ``nodes`` (node) has set in a bitmap, which is sent to the texts (8 MB at most)."""
    bits = min(most, 1 << max(15, (NODE_BITS * nodes.count() - 1).bit_length()))
    slot = F.pmod(F.xxhash64("node"), F.lit(bits))
    place, bucket = F.bitmap_bit_position(slot), F.bitmap_bucket_number(slot)
    # Dealt by bucket first: one bitmap of a bucket is made, not one in every task.
    maps = nodes.select(bucket.alias("bucket"), place.alias("place")).repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bitmap"))
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(F.col("place") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = known.select("node", "text", bucket.alias("bucket"), place.alias("place")).join(F.broadcast(maps), "bucket")
    return marked.where(F.getbit(byte, (F.col("place") % 8).cast("int")) == 1).select("node", "text")


def _of_nodes(known: DataFrame, nodes: DataFrame, most: int = MAP_BITS) -> DataFrame:
    """``node, text``: the text of each of ``nodes`` (node), once.

    Texts without a partner end where they are read. The map of the nodes can only let too many through; the join behind the
    shuffle is exact.
    """
    # Copies of a text collapse before the shuffle.
    return _marked(known, nodes, most).groupBy("node").agg(F.first("text").alias("text")).join(nodes, "node", "left_semi")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``doc_id, node, class, class_id``: a row per document, with the least id of its class of copies.

    Equal texts are one node (the digest of the text) and are not compared. In each bucket of a sketch all nodes are compared to
    one leader. Then all pairs of different classes in a bucket meet, in blocks of bounded size: those whose parities allow it (``_close``, which
    leaves out no similar pair) are aligned, the nearest ones of each node first and then all that are still of different
    classes. At the end no bucket holds a similar pair of different classes, and no bucket, partner or candidate is capped; what
    grows with the square of a bucket are blocks of parities, not texts. Buckets, links and classes stay distributed.

    A null text is a class of its own (``class_id`` is its id); texts without a word are copies only if they are equal. Repeated
    rows share a class. Long texts are sketched whole, in parts. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("node", F.unhex(F.md5("text")))
    ids = saved(rows.select("doc_id", "node"), "nodes")
    known = rows.where("node is not null")
    sketched = known.select("node", "text").mapInArrow(_sketch_rows, "key bigint, node binary")
    # Copies of a text collapse before the shuffle.
    rest = saved(sketched.distinct(), "sketches")
    classes = None
    heads = rest.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z").select("key", "a")
    rest = saved(rest.join(heads, "key"), "open-buckets")
    pairs = saved(rest.where("node != a").select("a", F.col("node").alias("b")).distinct(), "pairs")
    if not pairs.isEmpty():
        # Every node that shares a bucket is in the first pairs, so their texts serve all steps.
        nodes = saved(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "pair-nodes")
        texts = saved(_of_nodes(known, nodes), "texts")
        classes = components(saved(_compared(pairs, texts, least), "links"))
        rest = rest.select("key", "node").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
        close = saved(_close_pairs(rest, texts, least).join(pairs, ["a", "b"], "left_anti"), "close")
        # The nearest pairs of each node first: most of the others are of one class then.
        both = close.withColumn("node", F.explode(F.array("a", "b")))
        rank = F.row_number().over(Window.partitionBy("node").orderBy("odd", "a", "b"))
        pairs = saved(both.withColumn("rank", rank).where(F.col("rank") <= NEAREST).select("a", "b").distinct(), "pairs")
        if not pairs.isEmpty():
            classes = components(saved(_compared(pairs, texts, least), "links"), classes)
            left = close.select("a", "b").join(pairs, ["a", "b"], "left_anti")
            for name in ("a", "b"):
                left = left.join(classes.select(F.col("node").alias(name), F.col("class").alias(f"{name}_class")), name, "left")
            left = saved(left.where(F.coalesce("a_class", "a") != F.coalesce("b_class", "b")).select("a", "b"), "pairs")
            if not left.isEmpty():
                classes = components(saved(_compared(left, texts, least), "links"), classes)

    if classes is None:
        out = ids.withColumn("class", F.col("node"))
    else:
        out = ids.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    out = saved(out, "members")
    least_id = out.where("class is not null").groupBy("class").agg(F.min(F.struct("doc_id", "node")).alias("kept"), F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    out = out.join(least_id, "class", "left")
    return out.select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"),
        "node", (F.col("class").isNull() | F.struct("doc_id", "node").eqNullSafe(F.col("kept"))).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class with all its columns: the one with the least id.

    Documents with a null text all stay; empty texts are one class, as equal texts are. Of repeated rows one stays. Long texts are taken whole, and
    a table without rows stays empty. Any other columns go along, whatever their names.
    """
    names = docs.columns
    key, kept_id, kept_key = free_names(names, "text_key", "kept_id", "kept_key")
    found = near_copies(docs, id_col, text_col)
    kept = found.where("kept and node is not null").select(F.col("doc_id").alias(kept_id), F.col("node").alias(kept_key)).distinct()
    keyed = docs.withColumn(key, F.unhex(F.md5(F.col(text_col).cast("string"))))
    same = F.col(key).eqNullSafe(F.col(kept_key)) & F.col(id_col).cast("bigint").eqNullSafe(F.col(kept_id))
    whole = keyed.where(F.col(key).isNotNull()).join(kept, same, "left_semi").dropDuplicates([id_col, key])
    return whole.unionByName(keyed.where(F.col(key).isNull())).select(*names)
