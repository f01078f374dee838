"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, text_or_empty

TRAIN_ROWS = 10_000  # labelled rows that are learned from, at most
MIN_DOCS = 4  # of these rows that a feature must be in
EPOCHS = 10
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.0
FILTER_BITS = 22
THRESHOLD = 0.7
_CACHE = 400_000

_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_PAIR, _SKIP, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))
_KNOWN: dict[str, int] = {}


def _word(word: str) -> int:
    """Case and marks around a word do not count."""
    h = zlib.crc32(_EDGE.sub("", word.lower()).encode())
    if len(_KNOWN) >= _CACHE:
        _KNOWN.clear()
    _KNOWN[word] = h
    return h


def features(text: str) -> np.ndarray:
    """Hashes of the words, the pairs and the pairs with one word between; they may repeat."""
    words = text.split()
    found = list(map(_KNOWN.get, words))
    if None in found:
        found = [_word(w) if h is None else h for h, w in zip(found, words)]
    h = np.array(found, "u8")
    return np.concatenate((h * _MIX, (h[:-1] * _PAIR ^ h[1:]) * _MIX, (h[:-2] * _SKIP ^ h[2:] << np.uint64(1)) * _MIX))


class Ftrl:
    """FTRL-proximal with a learning rate per coordinate; L1 keeps those that carry little at exactly 0. Coordinate 0 is the constant."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l2 = alpha, beta, l2
        self.l1 = np.full(size, l1)
        self.l1[0] = 0.0  # the constant is not shrunk
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at) -> np.ndarray:
        z, l1 = self.z[at], self.l1[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / rate)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - rate * w
        self.n[at] += g * g


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature hashes, their weights and the constant, learned from (text, label).

    At most ``rows`` rows are learned from, those with the least seeded hash of the text. Texts become sets of features where
    they are read; the bounded sample then meets in one task, in a seeded order, since every update needs the one
    before. Features in fewer than ``MIN_DOCS`` rows are left out. Only non-zero weights leave the task.
    """
    sample = labelled.where("text is not null and label is not null").withColumn("turn", F.xxhash64("text", F.lit(7)))
    sample = sample.orderBy("turn", "label").limit(rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(features(t)).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *batch.columns[1:]], ["features", "label", "turn"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, labels = [], []
        for batch in batches:
            seen += [np.frombuffer(x, "u8") for x in batch.column(0).to_pylist()]
            labels += batch.column(1).to_pylist()
        every = np.sort(np.concatenate(seen)) if seen else np.zeros(0, "u8")
        often = every[MIN_DOCS - 1:][every[MIN_DOCS - 1:] == every[:len(every) - MIN_DOCS + 1]] if len(every) >= MIN_DOCS else every[:0]
        kept = np.unique(often)
        del every
        rows = [np.append(_places(kept, x) + 1, 0) for x in seen]
        model = Ftrl(len(kept) + 1)
        for epoch in range(epochs):
            for i in np.random.default_rng(epoch).permutation(len(rows)):
                model.learn(rows[i], float(labels[i]))
        w = model.weights(slice(None))
        at = np.flatnonzero(w[1:])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(kept[at], np.uint64(0)).view("i8")), pa.array(np.append(w[1:][at], w[0])), pa.array([False] * len(at) + [True])],
            ["feature", "weight", "constant"])

    encoded = saved(sample.select("text", F.col("label").cast("int").alias("label"), "turn").mapInArrow(encode, "features binary, label int, turn bigint"), "features")
    model = encoded.orderBy("turn", "label").coalesce(1).mapInArrow(learn, "feature bigint, weight double, constant boolean").collect()
    constant = sum(r["weight"] for r in model if r["constant"])
    model = sorted((r["feature"] & (1 << 64) - 1, r["weight"]) for r in model if not r["constant"])
    return np.array([f for f, _ in model], "u8"), np.array([w for _, w in model], "f8"), constant


def _places(names: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where the sorted ``names`` hold any of ``found``."""
    if not len(names) or not len(found):
        return np.zeros(0, "i8")
    at = np.minimum(np.searchsorted(names, found), len(names) - 1)
    return at[names[at] == found]


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of each whole text. The weights go with the tasks; the sample bounds their number."""
    names, weights, constant = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - FILTER_BITS)
        possible = np.zeros(1 << FILTER_BITS, bool)  # most features have no weight
        possible[names >> shift] = True

        def total(text: str) -> float:
            found = features(text)
            return constant + weights[_places(names, np.unique(found[possible[found >> shift]]))].sum()

        for batch in batches:
            sums = np.array([total(t) for t in batch.column(1).to_pylist()], "f8")
            score = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype("i4"))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double, predicted int")


def held_out(id_column) -> F.Column:
    """crc32 of the id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, learned from the labels of rows that are not held out.

    Only the text is an input. Labels are a bounded sample of ``rows``: so many ids with the least seeded hash, joined to the
    documents as a broadcast of that size, so the documents are read twice and never shuffled. Several labels of one
    id count as their largest. Null and empty texts are scored by the constant alone; repeated rows score alike; without a
    label every score is 0.5. Other columns are not read.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(texts.join(F.broadcast(known), "doc_id").select("text", "label"), rows)
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
