"""Remove byte strings that occur elsewhere, by backward extension on a positional Burrows-Wheeler transform.

A transform of the whole corpus fits no task, so strings that can be equal are brought together first. Every window of
``length`` bytes has one anchor in it, the leftmost least hash of its 16-byte grams, which depends on nothing but
the window. Equal windows have equal anchors at equal places, so windows are compared only within the group of an anchor's gram.

In a group the contexts of the anchor (the bytes its windows cover) stand in columns. They are put in the order of the bytes
from the anchor on. Then all of them are extended backwards together, one byte a step: a stable sort by the byte in front
gives the order one column further left, and the common prefix of two neighbours is one more than the least on the way
between them before (the transform's interval expansion). A prefix that can no longer reach ``length`` leaves the sweep.
A window is repeated if the common prefix with a neighbour in the order of its column has ``length`` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, saved, text_or_empty

GRAM = 16
SEGMENT_BITS = 20  # windows of a long text are taken in segments of this many bits
GROUP_ROWS = 4096  # contexts of one group in a task; larger groups are divided
BATCH_BYTES = 16 << 20

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

ANCHORS = "h bigint, ctx bigint, doc bigint, mark bigint, first bigint, last bigint, pos bigint"
CONTEXTS = "h bigint, ctx bigint, n bigint, k bigint, doc bigint, mark bigint, first bigint, pos bigint, low bigint, high bigint, bytes binary"
SPANS = "doc bigint, mark bigint, first bigint, until bigint"
REMOVED = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each position on."""
    x = data.astype("u8")
    for shift in (1, 2, 4):
        x = x[:-shift] | x[shift:] << np.uint64(8 * shift)
    h = x[:-8] * _A ^ (x[8:] ^ x[8:] >> np.uint64(31)) * _B
    h ^= h >> np.uint64(32)
    h *= _C
    h ^= h >> np.uint64(29)
    return h


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:len(x) - (width - step)], x[width - step:]) if width > step else x


def anchors(data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Gram hash, position, first and last window of each anchor of a text, by segments of its windows."""
    width, windows, mask = length - GRAM + 1, len(data) - length + 1, np.uint64((1 << SEGMENT_BITS) - 1)
    most = (1 << SEGMENT_BITS) - width
    for low in range(0, max(windows, 0), most):
        high = min(windows, low + most)
        h = gram_hashes(data[low:high + length - 1])
        least = sliding_minimum(h & ~mask | np.arange(len(h), dtype="u8"), width)
        at = (least & mask).astype("i8")
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        last = np.concatenate((first[1:], [high - low])) - 1
        yield h[at[first]].view("i8"), low + at[first], low + first, low + last


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, mark = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            parts, ctx, rows = [], [], []
            for i, text in enumerate(batch.column(2)):
                raw = text.as_buffer()
                if len(raw) < length:
                    continue
                view = memoryview(raw)
                for h, pos, first, last in anchors(np.frombuffer(raw, "u1"), length):
                    parts.append((h, first, last, pos))
                    rows.append((i, len(h)))
                    ctx += [xxhash.xxh3_64_intdigest(view[a:b + length], p - a) for a, b, p in zip(first.tolist(), last.tolist(), pos.tolist())]
            if not parts:
                continue
            row = np.repeat([i for i, _ in rows], [n for _, n in rows])
            h, first, last, pos = (np.concatenate(x) for x in zip(*parts))
            columns = h, np.array(ctx, "u8").view("i8"), doc[row], mark[row], first, last, pos
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h", "ctx", "doc", "mark", "first", "last", "pos"])

    return run


def repeated_windows(group: np.ndarray, lefts: list[bytes], rights: list[bytes], length: int) -> list[np.ndarray]:
    """For each row the numbers of bytes before its anchor at which a repeated window starts.

    ``group``: number of the row's group, rows of a group stand together. ``lefts``: the bytes before the anchor,
    ``rights``: those from the anchor on, at most ``length``.
    """
    k = len(group)
    before, after = np.fromiter(map(len, lefts), "i8", k), np.fromiter(map(len, rights), "i8", k)
    order = np.array(sorted(range(k), key=lambda i: (group[i], rights[i])), "i8")
    width = int(before.max(initial=0))
    left = np.zeros((k, width), "u1")
    right = np.zeros((k, int(after.max(initial=1))), "u1")
    for i in range(k):
        if lefts[i]:
            left[i, :before[i]] = np.frombuffer(lefts[i], "u1")[::-1]
        right[i, :after[i]] = np.frombuffer(rights[i], "u1")
    common = np.zeros(k, "i8")  # with the row before in the order
    for low in range(1, k, 4096):  # in parts, to hold only a few rows' comparisons
        a, b = order[low - 1:min(k, low + 4096) - 1], order[low:low + 4096]
        differ = right[a] != right[b]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), right.shape[1])
        common[low:low + len(b)] = np.where(group[a] == group[b], np.minimum(first, np.minimum(after[a], after[b])), 0)
    hits: list[tuple[np.ndarray, int]] = []
    for step in range(width + 1):
        if step:
            active = np.flatnonzero(before[order] >= step)
            rows = order[active]
            key = group[rows] << 8 | left[rows, step - 1]
            moved = np.argsort(key, kind="stable")
            key, at = key[moved], active[moved]
            same = np.flatnonzero(key[1:] == key[:-1]) + 1
            new = np.zeros(len(at), "i8")
            begin, end = at[same - 1] + 1, at[same]
            new[same] = common[end] + 1
            far = np.flatnonzero(end != begin)
            if len(far):
                bounds = np.column_stack((begin[far], end[far] + 1)).ravel()
                new[same[far]] = np.minimum.reduceat(np.append(common, 0), bounds)[::2] + 1
            order, common = rows[moved], new
        following = np.append(common[1:], 0)
        best = np.maximum(common, following)
        full = np.flatnonzero(best >= length)
        if len(full):
            hits.append((order[full], step))
        # What is left of a row bounds how long its prefix can get.
        alive = best + before[order] - step >= length
        if not alive.all():
            keep = np.flatnonzero(alive)
            if len(keep) < 2:
                break
            least = np.minimum.reduceat(common[:keep[-1] + 1], np.concatenate(([0], keep[:-1] + 1)))
            order, common = order[keep], least
            common[0] = 0
    rows = np.concatenate([r for r, _ in hits]) if hits else np.zeros(0, "i8")
    steps = np.concatenate([np.full(len(r), s) for r, s in hits]) if hits else np.zeros(0, "i8")
    sort = np.argsort(rows, kind="stable")
    cut = np.searchsorted(rows[sort], np.arange(k + 1))
    return [steps[sort[cut[i]:cut[i + 1]]] for i in range(k)]


def _sweep(length: int):
    def spans(rows: list[tuple]) -> pa.RecordBatch:
        names, group = np.unique([r[0] for r in rows], return_inverse=True)
        found = repeated_windows(group, [r[6][:r[5]] for r in rows], [r[6][r[5]:] for r in rows], length)
        out = []
        for (_, n, doc, mark, pos, _, _), steps in zip(rows, found):
            if n == 1 and len(steps):  # the others are known to be repeated
                start = np.sort(pos - steps)
                edge = np.flatnonzero(np.diff(start) > 1)
                out += [(doc, mark, a, b + length) for a, b in zip(start[np.append(0, edge + 1)].tolist(), start[np.append(edge, len(start) - 1)].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*out)) or [()] * 4)], ["doc", "mark", "first", "until"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        held = 0
        for batch in batches:
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            left = pc.subtract(c["pos"], c["first"])
            for row in zip(*(x.to_pylist() for x in (c["h"], c["n"], c["doc"], c["mark"], c["pos"], left, c["bytes"]))):
                if held >= BATCH_BYTES and row[0] != waiting[-1][0]:  # groups stay whole
                    yield spans(waiting)
                    waiting, held = [], 0
                waiting.append(row)
                held += len(row[6]) + 100
        if waiting:
            yield spans(waiting)

    return run


def _contexts(length: int):
    """Bytes of the listed contexts of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, mark, text, wanted in zip(*(batch.column(i) for i in range(4))):
                raw = memoryview(text.as_buffer())
                doc, mark = doc.as_py(), mark.as_py()
                out += [(w["h"], w["ctx"], w["n"], w["k"], doc, mark, w["first"], w["pos"], 0, length - GRAM, bytes(raw[w["first"]:w["last"] + length])) for w in wanted.as_py()]
            yield _context_batch(out)

    return run


def _halves(length: int):
    """Divide windows that start ``low`` to ``high`` bytes before the anchor in two, each named by what its windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                data, longest = r["bytes"], r["pos"] - r["first"]
                shortest = longest - (len(data) - length)
                middle = (r["low"] + r["high"]) // 2
                for x, y in ((r["low"], middle), (middle + 1, r["high"])):
                    a, b = max(x, shortest), min(y, longest)
                    if a <= b:
                        part = data[longest - b:longest - a + length]
                        h = xxhash.xxh3_64_intdigest(data[longest - x:longest - y + length], (r["h"] & 0xFFFFFFFF) << 24 | x << 12 | y)
                        ctx = xxhash.xxh3_64_intdigest(part, b)
                        out.append((_signed(h), _signed(ctx), r["n"], 0, r["doc"], r["mark"], r["pos"] - b, r["pos"], x, y, part))
            yield _context_batch(out)

    return run


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 10 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 11, types)], [x.strip().split()[0] for x in CONTEXTS.split(",")])


def _row_key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(-1 << 63))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, mark, text``: rows with the same id and text are one place, and what one of them loses the other loses too."""
    text = text_or_empty(F.col(text_col))
    return docs.select(_row_key(id_col).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))


def repeated_spans(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc, mark, first, until``: byte ranges whose windows of ``length`` bytes all start elsewhere too; they may overlap."""
    texts = _texts(docs, id_col, text_col)
    found = saved(texts.mapInArrow(_anchor_rows(length), ANCHORS), "anchors")

    # How often each context occurs, and how many different ones its gram has. Both combine before the shuffle.
    place = F.xxhash64("doc", "mark", "pos", "first")
    kinds = found.groupBy("h", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place"))
    kinds = saved(kinds, "contexts")
    several = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    open_kinds = kinds.join(several, "h", "left").where("n > 1 or k > 1").withColumn("k", F.coalesce("k", F.lit(1)))
    marked = saved(found.join(open_kinds, ["h", "ctx"]), "marked")
    known = [marked.where("n > 1").select("doc", "mark", "first", (F.col("last") + length).alias("until"))]

    # Contexts that are alone but share their gram are compared, with one of each kind that is not alone.
    wanted = marked.where("k > 1").where((F.col("n") == 1) | (F.col("place") == place))
    wanted = wanted.groupBy("doc", "mark").agg(F.collect_set(F.struct("h", "ctx", "n", "k", "first", "last", "pos")).alias("wanted"))
    # Repeated rows count in n; their contexts are taken from one of them.
    once = texts.groupBy("doc", "mark").agg(F.first("text").alias("text"))
    contexts = once.join(wanted, ["doc", "mark"]).mapInArrow(_contexts(length), CONTEXTS)
    contexts = saved(contexts, "context-bytes")

    ready = []
    while True:
        ready.append(contexts.where(F.col("k") <= group_rows))
        large = contexts.where(F.col("k") > group_rows)
        if large.isEmpty():
            break
        halves = saved(large.mapInArrow(_halves(length), CONTEXTS).withColumn("place", place), "halves")
        kinds = halves.groupBy("h", "ctx").agg(F.sum("n").alias("n"), F.min("place").alias("one"))
        several = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        kinds = kinds.join(several, "h", "left").where("n > 1 or k > 1").withColumn("k", F.coalesce("k", F.lit(1)))
        alone = F.col("n") == 1
        halves = saved(halves.drop("k").withColumnRenamed("n", "own").join(kinds, ["h", "ctx"]), "divided")
        known.append(halves.where((F.col("n") > 1) & (F.col("own") == 1)).select("doc", "mark", "first", (F.col("first") + F.length("bytes")).alias("until")))
        contexts = halves.where("k > 1").where(alone | (F.col("place") == F.col("one"))).select(*[x.strip().split()[0] for x in CONTEXTS.split(",")])

    groups = ready[0]
    for more in ready[1:]:
        groups = groups.unionByName(more)
    swept = groups.repartition("h").sortWithinPartitions("h").mapInArrow(_sweep(length), SPANS)
    for more in known:
        swept = swept.unionByName(more)
    return swept


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, until in sorted((s["first"], s["until"]) for s in spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], until)
        else:
            out.append([first, until])
    return [(a, b) for a, b in out]


def _left(raw: memoryview, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(raw)]))


def _with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with a last column: the spans of each row, null where it has none."""
    names = docs.columns
    doc, mark, span_doc, span_mark, lists = free_names(names, "row_key", "row_mark", "span_key", "span_mark", "_spans")
    found = spans.groupBy(F.col("doc").alias(span_doc), F.col("mark").alias(span_mark)).agg(F.collect_set(F.struct("first", "until")).alias(lists))
    keyed = docs.withColumns({doc: _row_key(id_col), mark: F.xxhash64(text_or_empty(F.col(text_col)))})
    return keyed.join(found, (F.col(doc) == F.col(span_doc)) & (F.col(mark) == F.col(span_mark)), "left").select(*names, lists)


def removed(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """What is left of each text, as UTF-8 bytes, without the bytes covered by a string of ``length`` bytes that also starts elsewhere.

    Strings are judged on the input, overlapping ones and those of the same document count, and none crosses two
    documents. A null text is empty; texts shorter than ``length`` lose nothing; repeated rows are different documents, so
    long ones lose everything. ``text`` is what is left, without characters that lost some of their bytes. A text of any length is one row, its windows are taken in segments. An empty table gives no rows;
    other columns are not read.

    Groups with more than ``group_rows`` different contexts are divided by where their windows start, as often as it takes;
    a half is named by the bytes its windows share, which keeps equal windows together. At a single start a count decides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = memoryview(text.as_buffer())
                spans = _merged(spans or [])
                left = _left(raw, spans) if spans else raw
                whole = bytes(left).decode("utf-8", "ignore") if spans else text.as_py()
                out.append((len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(left).hexdigest(), whole))
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, types))], [x.split()[0] for x in REMOVED.split(", ")])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    spans = repeated_spans(rows, length, "doc_id", "text", group_rows)
    return _with_spans(rows, spans, "doc_id", "text").mapInArrow(run, REMOVED)


def cut_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs`` with the repeated bytes cut out of the text; a character that lost a byte goes whole.

    ``chars_col``, where there is one, becomes the length of a text that was cut. Null texts stay null, empty and short ones as they are; repeated rows
    lose what they share with each other. Other columns go along, whatever their names. An empty table stays empty.
    """
    names = docs.columns
    at = names.index(text_col)
    size = names.index(chars_col) if chars_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[:-1]
            texts = []
            for text, spans in zip(batch.column(at), batch.columns[-1].to_pylist()):
                if spans:
                    texts.append(_left(memoryview(text.as_buffer()), _merged(spans)).decode("utf-8", "ignore"))
                else:
                    texts.append(text.as_py())
            columns[at] = pa.array(texts, columns[at].type)
            if size is not None:
                changed = pa.array([s is not None for s in batch.columns[-1].to_pylist()], pa.bool_())
                columns[size] = pc.if_else(changed, pc.cast(pc.utf8_length(columns[at]), columns[size].type), columns[size])
            yield pa.RecordBatch.from_arrays(columns, names)

    spans = repeated_spans(docs, length, id_col, text_col)
    return _with_spans(docs, spans, id_col, text_col).mapInArrow(run, docs.schema)
