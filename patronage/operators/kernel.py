"""Kernel classifier: random Fourier features of the Gaussian kernel in front of a linear support vector fit.

Rows are sparse (slots, values). The direction of a slot is drawn from the seed and the slot alone, so tasks agree on it without a matrix
that grows with the number of slots, and new slots need no fit. exp(-gamma |x - y|^2) is the expected product of two rows' features
(Rahimi and Recht, 2007); ``kernel_error`` measures how far off the drawn ones are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .encode import CATEGORICAL, CONTINUOUS, minmax_scale


def sparse_rows(frame: DataFrame, categorical: Sequence[str] = CATEGORICAL, continuous: Sequence[str] = CONTINUOUS, bits: int = 24) -> DataFrame:
    """``id, [label,] slots, values``: one slot per category and value by hash, and one per continuous column.

    A NULL category has no slot and a NULL number is 0. Continuous columns are taken as they are, see ``scaled``.
    """
    def slot(text: Column) -> Column:
        return F.pmod(F.xxhash64(text), F.lit(1 << bits)).cast("int")

    entries = [F.when(F.col(c).isNotNull(), F.struct(slot(F.concat(F.lit(f"{c}="), F.col(c).cast("string"))).alias("slot"), F.lit(1.0).alias("value"))) for c in categorical]
    entries += [F.struct(slot(F.lit(c)).alias("slot"), F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("value")) for c in continuous]
    found = F.filter(F.array(*entries), lambda e: e.isNotNull() & (e["value"] != 0))
    label = [F.col("label").cast("double").alias("label")] if "label" in frame.columns else []
    return frame.select("id", *label, found.alias("e")).select("id", *[c for c in ("label",) if label], F.col("e.slot").alias("slots"), F.col("e.value").alias("values"))


def scaled(train: DataFrame, *others: DataFrame, columns: Sequence[str] = CONTINUOUS) -> list[DataFrame]:
    """All frames with ``columns`` scaled together to [0, 1]."""
    label = train.schema["label"].dataType
    frames = [train.withColumn("frame", F.lit(0))] + [f.withColumns({"frame": F.lit(i), "label": F.lit(None).cast(label)}) for i, f in enumerate(others, 1)]
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    whole = materialise(minmax_scale(whole, columns), "scaled")
    return [whole.where(F.col("frame") == i).drop("frame", *([] if i == 0 else ["label"])) for i in range(len(frames))]


def directions(slots: np.ndarray, size: int, gamma: float, seed: int) -> np.ndarray:
    """A row of normal draws of variance 2 gamma for each slot."""
    return np.array([np.random.default_rng([seed, int(s)]).normal(0.0, (2 * gamma) ** 0.5, size) for s in slots]).reshape(len(slots), size)


def features(slots: np.ndarray, values: np.ndarray, owner: np.ndarray, rows: int, size: int, gamma: float, seed: int) -> np.ndarray:
    """sqrt(2 / size) cos(w x + b) of ``rows`` rows, whose entries are (owner, slot, value)."""
    kinds, at = np.unique(slots, return_inverse=True)
    w = directions(kinds, size, gamma, seed)
    phase = np.random.default_rng([seed, 1 << 40]).uniform(0, 2 * np.pi, size)
    out = np.tile(phase, (rows, 1))
    for low in range(0, len(slots), 4096):  # a part of the entries at a time
        part = slice(low, low + 4096)
        np.add.at(out, owner[part], w[at[part]] * values[part, None])
    return np.cos(out) * (2.0 / size) ** 0.5


def mapped(rows: DataFrame, size: int = 512, gamma: float = 0.1, seed: int = 42) -> DataFrame:
    """``rows`` with their random features as a vector ``features`` instead of slots and values."""
    keep = [c for c in rows.columns if c not in ("slots", "values")]
    types = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 2048):
                batch = whole.slice(low, 2048)
                slots, values = batch.column(len(keep)), batch.column(len(keep) + 1)
                owner = np.repeat(np.arange(batch.num_rows), slots.value_lengths().to_numpy())
                z = features(np.asarray(slots.flatten()), np.asarray(values.flatten(), "f8"), owner, batch.num_rows, size, gamma, seed)
                column = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype="i4") * size), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], column], [*keep, "z"])

    found = rows.select(*keep, "slots", "values").mapInArrow(run, f"{types}, z array<double>")
    return found.select(*keep, array_to_vector("z").alias("features"))


def default_gamma(rows: DataFrame) -> float:
    """1 / number of slots that occur."""
    return 1.0 / max(1, rows.select(F.explode("slots").alias("slot")).distinct().count())


def fit(rows: DataFrame, size: int = 512, gamma: float | None = None, c: float = 1.0, iterations: int = 50, seed: int = 42) -> tuple[LinearSVCModel, float]:
    """The linear fit on the random features of ``label, slots, values``, and the gamma it took."""
    rows = materialise(rows.where("label is not null"), "kernel-rows")
    gamma = gamma or default_gamma(rows)
    train = materialise(mapped(rows.select("label", "slots", "values"), size, gamma, seed), "kernel-features")
    return LinearSVC(maxIter=iterations, regParam=1.0 / (c * max(1, train.count())), standardization=False).fit(train), gamma


def margins(model: LinearSVCModel, rows: DataFrame, size: int = 512, gamma: float = 0.1, seed: int = 42) -> DataFrame:
    """``id, score``: the signed distance to the boundary."""
    return model.transform(mapped(rows.select("id", "slots", "values"), size, gamma, seed)).select("id", vector_to_array("rawPrediction")[1].alias("score"))


def kernel_error(rows: DataFrame, size: int = 512, gamma: float = 0.1, seed: int = 42, sample: int = 200) -> float:
    """Root mean square difference between the kernel and the product of features, over all pairs of ``sample`` rows (a stated bound)."""
    found = rows.select("slots", "values").limit(sample).toPandas()
    slots = np.concatenate([np.asarray(s) for s in found["slots"]])
    values = np.concatenate([np.asarray(v, "f8") for v in found["values"]])
    owner = np.repeat(np.arange(len(found)), [len(s) for s in found["slots"]])
    z = features(slots, values, owner, len(found), size, gamma, seed)
    kinds, at = np.unique(slots, return_inverse=True)
    x = np.zeros((len(found), len(kinds)))
    np.add.at(x, (owner, at), values)
    apart = (x ** 2).sum(1)[:, None] + (x ** 2).sum(1)[None] - 2 * x @ x.T
    return float(np.sqrt(((z @ z.T - np.exp(-gamma * apart)) ** 2).mean()))
