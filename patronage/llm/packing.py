"""Concatenate and cut: global token offsets from partition totals, then windows of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, text_or_empty
from .tokens import encoder

END = 0
TOKENS = "doc_id bigint, part int, part_start bigint, n_tokens bigint, ids binary"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def token_table(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every document with its offset in its partition, written once to the shared folder.

    ``ids`` are little-endian, 2 bytes each where the vocabulary allows it, else 4.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        small, end = enc.vocabulary <= 1 << 16, END.to_bytes(4, "little")
        for batch in batches:
            ids = [x + end for x in enc.encode_many(batch.column(1))]
            n = np.fromiter((len(x) // 4 for x in ids), "i8", len(ids))
            if small:
                ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(ids), part, "i4")), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())],
                ["doc_id", "part", "part_start", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    return saved(rows.mapInArrow(encode, TOKENS), "tokens")


def partition_starts(tokens: DataFrame) -> dict[int, int]:
    """Second pass: the offset of each partition, from one total per partition."""
    totals = tokens.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("n")).collect()
    starts, at = {}, 0
    for row in sorted(totals):
        starts[row["part"]] = at
        at += row["n"]
    return starts


def cut(tokens: DataFrame, window: int) -> DataFrame:
    """One row for each piece of a document between two multiples of ``window`` of the whole stream.

    A document that crosses a boundary has a piece on either side; only the last sequence is not full.
    """
    starts = partition_starts(tokens)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(3).to_numpy()
            base = np.fromiter((starts[p] for p in batch.column(1).to_pylist()), "i8", len(n))
            first = base + batch.column(2).to_numpy()
            low = first // window
            count = (first + n - 1) // window - low + 1
            row = np.repeat(np.arange(len(n)), count)
            sequence = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = np.maximum(sequence * window, first[row])
            length = np.minimum((sequence + 1) * window, (first + n)[row]) - begin
            start = begin - first[row]
            crc, last, ids = np.empty(len(row), "i8"), -1, b""
            column = batch.column(4)
            for k, (r, s, m) in enumerate(zip(row.tolist(), start.tolist(), length.tolist())):
                if r != last:
                    raw = column[r].as_buffer()
                    ids, last = memoryview(np.frombuffer(raw, f"<u{len(raw) // int(n[r])}").astype("<u4")).cast("B"), r
                crc[k] = zlib.crc32(ids[4 * s:4 * (s + m)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), *map(pa.array, (start, length, crc, n[row], sequence, begin - sequence * window))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return tokens.mapInArrow(pieces, PIECES)


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of ``window`` tokens.

    Pass 1 encodes each partition as it is read (no shuffle), with offsets within the partition. Pass 2 adds up
    one total per partition; with these offsets every document knows its place in the whole stream and cuts
    itself. A null or empty text is one end token. A long text takes as many sequences as it needs.
    Repeated rows and repeated or null ids are packed row by row; other columns are not read.
    An empty table gives no rows.
    """
    return cut(token_table(docs, tokenizer, id_col, text_col), window)
