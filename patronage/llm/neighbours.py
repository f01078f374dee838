"""Nearest neighbours by shifted space-filling curves: Hilbert orders of projected vectors, range-partitioned by Spark.

Every curve has its own random projection and shift. A query looks at the rows whose keys stand near its own in the
order of each curve; what the windows of all curves find is merged and ranked by the exact inner product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

CURVES = 4
DIMENSIONS = 6
BITS = 10
BLOCK = 2048
SPAN = 32  # blocks of a tile at most
ASKED = 16384  # queries of a tile at most
CHUNK = 256  # queries that are multiplied with a block at a time
SAMPLE = 4096  # vectors that the projections' means and widths are fitted on
PROBES = 64  # queries that the width of the windows is fitted on
WANTED = 0.96  # share of the probes' neighbours that the windows must hold

PLACED = "curve int, part int, place bigint, query boolean, mark bigint"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows), by the transposed form of the index."""
    x = cells.astype("i8").T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(flip, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Curves:
    """Projections and shifts of all curves, scaled to a bounded sample of the vectors.

    For the largest inner product, rows get one more component that gives all of them the largest norm and queries get 0.
    """

    def __init__(self, sample: np.ndarray, norm: float, seed: int):
        rng = np.random.default_rng(seed)
        self.norm = norm
        sample = self.lifted(sample, False)
        width = sample.shape[1]
        self.axes = [np.linalg.qr(rng.standard_normal((width, min(width, DIMENSIONS))))[0] for _ in range(CURVES)]
        self.low, self.scale = [], []
        for axes in self.axes:
            seen = sample @ axes
            spread = np.maximum(seen.std(axis=0), 1e-12)
            shift = rng.uniform(-0.5, 0.5, axes.shape[1])
            self.low.append(seen.mean(axis=0) - (3 + shift) * spread)
            self.scale.append((1 << BITS) / (6 * spread))

    def lifted(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        rest = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(0, self.norm ** 2 - (vectors ** 2).sum(axis=1)))
        return np.column_stack((vectors, rest))

    def keys(self, vectors: np.ndarray, query: bool, used: int = CURVES) -> list[np.ndarray]:
        lifted = self.lifted(vectors, query)
        out = []
        for axes, low, scale in zip(self.axes[:used], self.low, self.scale):
            cells = np.clip((lifted @ axes - low) * scale, 0, (1 << BITS) - 1).astype("i8")
            out.append(hilbert_keys(cells, BITS))
        return out


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.array(v, "<f8").tobytes() for v in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), *batch.columns[1:]], ["vector", *batch.schema.names[1:]])


def _query_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.array(v, "<f8").tobytes() for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(0)], ["vector", "query_id"])


def _with_keys(curves: Curves, used: int):
    """``curve, key`` of the first curves, and all columns; the vector is the first one and the flag of queries the second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            vectors = _vectors(batch.column(0))
            if not len(query):
                continue
            for curve, (rows, asked) in enumerate(zip(curves.keys(vectors, False, used), curves.keys(vectors, True, used))):
                key = np.where(query, asked, rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), curve, "i4")), pa.array(key), *batch.columns], ["curve", "key", *batch.schema.names])

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of a sorted partition; a query stands between the rows before and behind it."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        row = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        place = at + np.cumsum(row) - row
        at += int(row.sum())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.full(len(row), part, "i4")), pa.array(place.astype("i8")), *batch.columns[1:]],
            ["curve", "part", "place", *batch.schema.names[1:]])


def _best(scores: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: list[list[int]], most: int) -> Iterator[list[tuple[float, int]]]:
    """The ``most`` nearest ids for each query, the score computed pair by pair."""
    k = min(most, scores.shape[1])
    top = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < scores.shape[1] else np.tile(np.arange(k), (len(scores), 1))
    for q, chosen in zip(queries, top):
        exact = (rows[chosen] * q).sum(axis=1)
        yield sorted((-s, i) for s, j in zip(exact.tolist(), chosen.tolist()) for i in ids[j])[:most]


FOUND = "mark bigint, found array<struct<score: double, vec_id: bigint>>"
_FOUND_TYPE = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))


def _found_batch(marks: list[int], found: list[list[tuple[float, int]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(marks, pa.int64()), pa.array([[{"score": -s, "vec_id": i} for s, i in f] for f in found], _FOUND_TYPE)], ["mark", "found"])


def _ranks(groups: np.ndarray) -> np.ndarray:
    """Places of sorted group numbers within their group."""
    first = np.flatnonzero(np.diff(groups, prepend=-1))
    return np.arange(len(groups)) - np.repeat(first, np.diff(first, append=len(groups)))


class _Rows:
    """The rows of a tile in the order of their blocks."""

    def __init__(self, rows: pa.Table):
        order = np.argsort(rows["low"].to_numpy(), kind="stable")
        block = rows["low"].to_numpy()[order]
        self.vectors = _vectors(rows["vector"])[order]
        self.norm = float(np.sqrt((self.vectors ** 2).sum(axis=1).max()))
        ids = rows["ids"].combine_chunks().take(pa.array(order))
        self.offsets, self.ids = ids.offsets.to_numpy(), ids.values.to_numpy()
        self.least = self.ids[self.offsets[:-1]]  # ids are in order
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        self.blocks = list(zip(block[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(block)]))

    def nearest(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id): the ``most`` nearest ids for each query in the blocks from its ``low`` to its ``high``, which both ascend.

        Blocks are multiplied at once; a pair that could be among the nearest, for all that rounding may do, gets its score by itself.
        """
        slack = 8 * queries.shape[1] * np.finfo(float).eps * np.sqrt((queries ** 2).sum(axis=1)) * self.norm
        slack = np.where(np.isfinite(slack), slack, np.inf)
        floor = np.full(len(queries), -np.inf)
        none = np.zeros(0, "i8")
        kept = (none, none, np.zeros(0))
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def merged():
            q, r = (np.concatenate(x) for x in zip(*waiting))
            score = np.concatenate([np.zeros(0), *((self.vectors[r[i:i + 65536]] * queries[q[i:i + 65536]]).sum(axis=1) for i in range(0, len(q), 65536))])
            q, r, score = (np.concatenate(x) for x in zip(kept, (q, r, score)))
            order = np.lexsort((self.least[r], -score, q))
            q, r, score = q[order], r[order], score[order]
            rank = _ranks(q)
            last = rank == most - 1
            floor[q[last]] = np.where(slack[q[last]] < np.inf, score[last] - slack[q[last]], -np.inf)
            return q[rank < most], r[rank < most], score[rank < most]

        for block, start, end in self.blocks:
            first, stop = int(np.searchsorted(high, block, "left")), int(np.searchsorted(low, block, "right"))
            if first >= stop:
                continue
            scores = queries[first:stop] @ self.vectors[start:end].T
            least = floor[first:stop].copy()
            fresh = np.flatnonzero(least == -np.inf)
            if len(fresh) and end - start > most:
                least[fresh] = np.partition(scores[fresh], end - start - most, axis=1)[:, end - start - most] - slack[first:stop][fresh]
            q, r = np.divmod(np.flatnonzero(scores >= least[:, None]), end - start)
            waiting.append((q + first, r + start))
            count += len(q)
            if count >= most * len(queries):
                kept, waiting, count = merged(), [], 0
        if waiting:
            kept = merged()
        q, r, score = kept
        size = self.offsets[r + 1] - self.offsets[r]
        each = np.repeat(np.arange(len(r)), size)
        found = self.ids[np.repeat(self.offsets[r], size) + _ranks(each)]
        order = np.lexsort((found, -score[each], q[each]))
        q, score, found = q[each][order], score[each][order], found[order]
        near = _ranks(q) < most
        return q[near], score[near], found[near]


def _search_tiles(most: int):
    """The nearest of each query of a tile among the rows of the tile; one list for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        table = pa.Table.from_batches(held) if held else None
        for tile in table["tile"].unique() if held else ():
            here = table.filter(pc.equal(table["tile"], tile))
            there, asked = here.filter(pc.invert(here["query"])), here.filter(here["query"]).sort_by([("low", "ascending"), ("high", "ascending")])
            if not there.num_rows or not asked.num_rows:
                continue
            rows = _Rows(there)
            for at in range(0, asked.num_rows, CHUNK):
                part = asked.slice(at, CHUNK)
                q, score, found = rows.nearest(_vectors(part["vector"]), part["low"].to_numpy(), part["high"].to_numpy(), most)
                first = np.flatnonzero(np.diff(q, prepend=-1))
                lists = pa.ListArray.from_arrays(
                    pa.array([*first, len(q)], pa.int32()), pa.StructArray.from_arrays([pa.array(score), pa.array(found)], ["score", "vec_id"]))
                yield pa.RecordBatch.from_arrays([pa.array(part["mark"].to_numpy()[q[first]]), lists.cast(_FOUND_TYPE)], ["mark", "found"])

    return run


def _scan(probes: np.ndarray, marks: list[int], most: int):
    """The nearest of each batch of rows to a fixed set of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _vectors(batch.column(0))
                yield _found_batch(marks, list(_best(probes @ vectors.T, probes, vectors, batch.column(1).to_pylist(), most)))

    return run


def _merged(found: DataFrame, most: int) -> DataFrame:
    """The nearest of all windows; an array has at most ``most`` entries for each tile of a query. What two curves found stands side by side."""
    every = F.array_sort(F.flatten(F.collect_list(F.transform("found", lambda x: F.struct((-x["score"]).alias("far"), x["vec_id"].alias("vec_id"))))))
    ordered = found.groupBy("mark").agg(every.alias("found"))
    return ordered.select("mark", F.slice(F.filter("found", lambda x, i: (i == 0) | (x != F.get("found", i - 1))), 1, most).alias("found"))


def _offsets(ordered: DataFrame) -> tuple[dict[int, int], int]:
    """Rows before each partition, and all rows, from one total per partition."""
    totals = ordered.groupBy("part").agg(F.count(F.when(~F.col("query"), 1)).alias("n")).collect()
    starts, at = {}, 0
    for row in sorted(totals):
        starts[row["part"]] = at
        at += row["n"]
    return starts, at


def _half_width(index: DataFrame, queries: DataFrame, ordered: DataFrame, starts: dict[int, int], most: int) -> int:
    """The least distance in places that holds ``WANTED`` of the probes' true neighbours on their nearest curve."""
    probes = queries.orderBy(F.xxhash64("mark", F.lit(1))).limit(PROBES).collect()
    marks = [r["mark"] for r in probes]
    vectors = np.array([np.frombuffer(r["vector"], "<f8") for r in probes])
    named = index.select("vector", F.array(F.xxhash64("vector")).alias("ids"))
    truth = {r["mark"]: [x["vec_id"] for x in r["found"] if x["vec_id"] != r["mark"]] for r in _merged(named.mapInArrow(_scan(vectors, marks, most), FOUND), most).collect()}
    wanted = sorted({m for found in truth.values() for m in found} | set(marks))
    place: dict[tuple[bool, int], dict[int, int]] = {}
    for r in ordered.where(F.col("mark").isin(wanted)).select("curve", "part", "place", "query", "mark").collect():
        place.setdefault((r["query"], r["mark"]), {})[r["curve"]] = starts[r["part"]] + r["place"]
    gaps = sorted(min(abs(at - place[False, m][c]) for c, at in place[True, q].items()) for q, found in truth.items() for m in found)
    return max(most, gaps[min(len(gaps) - 1, int(WANTED * len(gaps)))] + 1) if gaps else most


class _Windows:
    """Blocks, spans of blocks and tiles of the places on ``curves`` orders of ``n`` rows, one behind the other.

    A span has blocks of one curve. Its rows are copied to each of its tiles, which share its queries.
    """

    def __init__(self, starts: dict[int, int], n: int, curves: int, reach: int, span: int):
        self.starts, self.n, self.reach, self.span = starts, n, reach, span
        self.stride = (n - 1) // (BLOCK * span) + 2
        self.tiles, self.first = np.ones(curves * self.stride, "i8"), np.arange(curves * self.stride)

    def deal(self, asked: dict[int, int]) -> int:
        """Tiles for spans with so many queries; a span without any has none."""
        for span in range(len(self.tiles)):
            self.tiles[span] = -(-asked.get(span, 0) // ASKED)
        self.first = np.cumsum(self.tiles) - self.tiles
        return int(self.tiles.sum())

    def blocks(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """First and last block and span of each row of ``curve, part, place, query``: its own, or those of its window."""
        curve, query = batch.column(0).to_numpy().astype("i8"), batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
        place = np.fromiter((self.starts[p] for p in batch.column(1).to_pylist()), "i8", batch.num_rows) + batch.column(2).to_numpy()
        margin = np.where(query, self.reach, 0)
        low = np.clip(place - margin, curve * self.n, (curve + 1) * self.n - 1) // BLOCK
        high = np.clip(place + margin, curve * self.n, (curve + 1) * self.n - 1) // BLOCK
        shift = curve * self.stride - curve * self.n // (BLOCK * self.span)
        return query, low, high, low // self.span + shift, high // self.span + shift

    def spans(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries of each span in a part of the queries."""
        count = np.zeros(len(self.tiles), "i8")
        for batch in batches:
            if batch.num_rows:
                _, _, _, first, last = self.blocks(batch)
                steps = np.zeros(len(count) + 1, "i8")
                np.add.at(steps, first, 1)
                np.add.at(steps, last + 1, -1)
                count += np.cumsum(steps)[:-1]
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["span", "n"])

    def to_tiles(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows to all tiles of their span, queries to one tile of every span that their window touches."""
        for batch in batches:
            if not batch.num_rows:
                continue
            query, low, high, first, last = self.blocks(batch)
            mark = batch.column(4).to_numpy()
            count = np.where(query, last - first + 1, self.tiles[first])
            row = np.repeat(np.arange(len(count)), count)
            step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            span = first[row] + np.where(query[row], step, 0)
            tile = self.first[span] + np.where(query[row], mark[row] % np.maximum(self.tiles[span], 1), step)
            for at in range(0, len(row), 4096):
                part = pa.array(row[at:at + 4096])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tile[at:at + 4096].astype("i4")), pa.array(low[row[at:at + 4096]]), pa.array(high[row[at:at + 4096]]), *(batch.column(i).take(part) for i in (3, 4, 5, 6))],
                    ["tile", "low", "high", "query", "mark", "vector", "ids"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 11) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` its ``k`` nearest found rows of ``vectors`` but itself.

    Nearest is the largest inner product in double precision; ties go to the smaller id. Null vectors, zero ones, those
    with a null or non-finite component, those with another length than most and rows without an id take no part. Equal
    vectors are one row of the index with their k + 1 least ids, which is all that a result can hold; repeated rows count once.

    All rows are on every curve that is used. The projections are scaled to ``SAMPLE`` vectors. The half width of the windows is fitted
    on ``PROBES`` queries that are compared with all rows: it is the least that holds ``WANTED`` of their true neighbours
    in one curve or another. Random vectors need wide windows, vectors in clusters narrow ones. Where the windows on all curves
    would look at as many rows as there are, one window over the whole of one curve takes their place. Rows and queries meet in tiles of bounded size. Columns but the two are not
    read; empty tables give no rows.
    """
    most = k + 1

    def valid(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        return rows.where(F.coalesce(fine, F.lit(False)))

    rows, asked = valid(vectors), valid(queries)
    widths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    if not widths:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    width = widths[0]["width"]
    rows, asked = (x.where(F.size("v") == width) for x in (rows, asked))

    first = Window.partitionBy("v").orderBy("vec_id")
    index = rows.withColumn("_n", F.dense_rank().over(first)).where(F.col("_n") <= most)
    index = index.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    index = saved(index.select("v", "ids").mapInArrow(_to_bytes, "vector binary, ids array<bigint>"), "vectors")
    asked = asked.distinct().mapInArrow(_query_bytes, "vector binary, query_id bigint")
    asked = saved(asked.withColumn("mark", F.xxhash64("vector")), "queries")
    different = asked.groupBy("mark").agg(F.first("vector").alias("vector"))

    norm = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] ** 0.5
    sample = index.orderBy(F.xxhash64("vector")).limit(SAMPLE).select("vector").collect()
    curves = Curves(np.array([np.frombuffer(r[0], "<f8") for r in sample]), norm, seed)

    both = index.select("vector", F.lit(False).alias("query"), F.xxhash64("vector").alias("mark"), "ids").unionByName(
        different.select("vector", F.lit(True).alias("query"), "mark", F.lit(None).cast("array<bigint>").alias("ids")))

    def placed(used: int, *columns: str) -> DataFrame:
        """Rows and queries with their places in the orders of the first curves."""
        types = "".join(f", {c} {both.schema[c].dataType.simpleString()}" for c in columns)
        keyed = both.select("vector", "query", "mark", "ids").mapInArrow(
            _with_keys(curves, used), "curve int, key bigint, vector binary, query boolean, mark bigint, ids array<bigint>")
        ordered = keyed.select("curve", "key", "query", "mark", *columns).repartitionByRange("curve", "key", "mark").sortWithinPartitions("curve", "key", "mark", "query")
        return saved(ordered.select("curve", "query", "mark", *columns).mapInArrow(_places, PLACED + types), "curves")

    if different.isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    places = placed(CURVES)
    starts, n = _offsets(places)
    n //= CURVES
    reach = _half_width(index, different, places, starts, most)
    used = CURVES if CURVES * (2 * reach + BLOCK) < n else 1
    ordered = placed(used, "vector", "ids")
    tasks = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    windows = _Windows(_offsets(ordered)[0], n, used, reach if used > 1 else n, max(1, min(SPAN, used * n // (BLOCK * tasks))))
    spans = ordered.where("query").select("curve", "part", "place", "query").mapInArrow(windows.spans, "span bigint, n bigint")
    tiles = windows.deal(dict(spans.groupBy("span").agg(F.sum("n")).collect()))
    dealt = ordered.mapInArrow(windows.to_tiles, "tile int, low bigint, high bigint, query boolean, mark bigint, vector binary, ids array<bigint>")
    found = dealt.repartitionById(tiles, "tile").mapInArrow(_search_tiles(most), FOUND)
    best = asked.select("query_id", "mark").join(_merged(found, most), "mark")
    best = best.withColumn("found", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k))
    best = best.select("query_id", F.posexplode("found").alias("rank", "hit"))
    return best.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.far")).alias("score"))

