"""Token files with directly addressable codes: any token can be read without decoding its block.

A block holds whole documents. An id is split into chunks of 8 bits. Level 0 has the lowest chunk of every
id and a bitmap that tells which ids go on; level 1 has the next chunk of those that do, and so on. A rank
directory holds the number of set bits before every 512th bit, so the place of an id in the next level
takes one directory entry and at most 64 bytes of the bitmap.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty
from .tokens import encoder

END = 0
RANK_BITS = 512
BLOCK_IDS = 1 << 18
BLOCKS = ("shard int, block int, shard_start bigint, n_ids bigint, doc_ids array<bigint>, doc_lengths array<bigint>, "
          "levels array<binary>, bitmaps array<binary>, ranks array<binary>")
_BLOCK_TYPES = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("shard_start", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())),
    ("levels", pa.list_(pa.binary())), ("bitmaps", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])


def encode_block(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, bitmaps and rank directories of unsigned ids; the last level has no bitmap."""
    levels, bitmaps, ranks = [], [], []
    rest = ids.astype("<u4")
    while True:
        levels.append((rest & 0xFF).astype("u1").tobytes())
        rest = rest >> 8
        more = rest > 0
        if not more.any():
            return levels, bitmaps, ranks
        counts = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype="<u4")
        bitmaps.append(np.packbits(more, bitorder="little").tobytes())
        ranks.append((np.cumsum(counts, dtype="<u4") - counts).astype("<u4").tobytes())
        rest = rest[more]


def decode_block(n_ids: int, levels: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a block, level by level from the top."""
    sizes = [len(x) for x in levels]
    ids = np.frombuffer(levels[-1], "u1").astype("<u4")
    for k in range(len(levels) - 2, -1, -1):
        more = np.unpackbits(np.frombuffer(bitmaps[k], "u1"), count=sizes[k], bitorder="little").view(bool)
        low = np.frombuffer(levels[k], "u1").astype("<u4")
        low[more] |= ids << 8
        ids = low
    assert len(ids) == n_ids
    return ids


def token_at(i: int, levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes]) -> int:
    """The i-th id of a block, from one chunk of each level it has."""
    value = 0
    for k, level in enumerate(levels):
        value |= level[i] << (8 * k)
        if k == len(bitmaps) or not bitmaps[k][i >> 3] >> (i & 7) & 1:
            return value
        first = i // RANK_BITS
        part = bitmaps[k][first * RANK_BITS // 8:i // 8]
        before = int.from_bytes(part, "little").bit_count() + (bitmaps[k][i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
        i = int.from_bytes(ranks[k][4 * first:4 * first + 4], "little") + before
    return value


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all documents as blocks, in ascending order of the document id.

    Documents are range-partitioned by id; a partition is one shard. Each document ends with id 0. Null ids come
    first; rows with the same id are ordered by their text. A null text is empty. A block ends after the document
    that reaches ``block_ids``, so a very long text is a block of its own. Other columns are not read.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        end = END.to_bytes(4, "little")
        block, start, n, doc_ids, lengths, ids = 0, 0, 0, [], [], []

        def done():
            levels, bitmaps, ranks = encode_block(np.frombuffer(b"".join(ids), "<u4"))
            row = [shard, block, start, n, doc_ids, lengths, levels, bitmaps, ranks]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK_TYPES)], schema=_BLOCK_TYPES)

        for batch in batches:
            for doc, found in zip(batch.column(0).to_pylist(), enc.encode_many(batch.column(1))):
                ids.append(found + end)
                doc_ids.append(doc)
                lengths.append(len(ids[-1]) // 4)
                n += lengths[-1]
                if n >= block_ids:
                    yield done()
                    block, start, n, doc_ids, lengths, ids = block + 1, start + n, 0, [], [], []
        if doc_ids:
            yield done()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "zstd").parquet(path)


def _shard_starts(blocks: DataFrame) -> dict[int, int]:
    """The first global position of each shard, from one total per shard."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    starts, at = {}, 0
    for row in sorted(totals):
        starts[row["shard"]] = at
        at += row["n"]
    return starts


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32`` of the decoded ids, and ``ids`` themselves."""
    starts = _shard_starts(read_blocks(spark, path))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row["n_ids"], row["levels"], row["bitmaps"])
                n = np.array(row["doc_lengths"], "i8")
                ends = np.cumsum(n)
                raw = [ids[e - k:e].tobytes() for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts[row["shard"]] + row["shard_start"] + ends - n), pa.array(n),
                     pa.array(np.fromiter(map(zlib.crc32, raw), "i8", len(raw))), pa.array(raw, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return read_blocks(spark, path).mapInArrow(documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")


def read_tokens(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """``position, token`` for a table of global positions, read by rank without decoding any block.

    Positions meet the blocks by cells of ``BLOCK_IDS`` positions, so a cell has at most that many of them. A position
    asked for twice is answered once; one that no block has, or null, gives no row.
    """
    starts = _shard_starts(read_blocks(spark, path))
    shards = F.create_map(*[F.lit(x) for item in starts.items() for x in item]) if starts else None
    if shards is None:
        return positions.limit(0).select(F.col("position").cast("bigint"), F.lit(0).cast("bigint").alias("token"))
    blocks = read_blocks(spark, path).withColumn("low", shards[F.col("shard")] + F.col("shard_start"))
    cells = F.sequence(F.floor(F.col("low") / BLOCK_IDS), F.floor((F.col("low") + F.col("n_ids") - 1) / BLOCK_IDS))
    blocks = blocks.withColumn("cell", F.explode(cells))
    wanted = positions.select(F.col("position").cast("bigint")).where("position is not null")
    wanted = wanted.withColumn("cell", F.floor(F.col("position") / BLOCK_IDS)).groupBy("cell").agg(F.collect_set("position").alias("positions"))
    hits = wanted.join(blocks, "cell").select("positions", "low", "n_ids", "levels", "bitmaps", "ranks")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = [p for p in row["positions"] if row["low"] <= p < row["low"] + row["n_ids"]]
                ids = [token_at(p - row["low"], row["levels"], row["bitmaps"], row["ranks"]) for p in at]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(ids, pa.int64())], ["position", "token"])

    return hits.mapInArrow(read, "position bigint, token bigint")
