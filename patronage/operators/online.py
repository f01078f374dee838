"""Online linear learner under quantile loss over hashed sparse features.

Each pass goes through the rows of every part in order, with the normalised per-coordinate adaptive updates of "Normalized
Online Learning" (Ross, Mineiro, Langford, 2013). Parts start a pass from the same weights. Afterwards the weights are averaged
coordinate by coordinate, weighed by the squared gradients that each part saw, as a distributed sum; so only
coordinates that occur, at most 2^bits of them, reach the driver. With one part this is the plain sequential loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

ROWS_PER_PART = 100_000
PASSED = "slot bigint, gradients double, weighed double, largest double, loss double, n bigint, held_loss double, held bigint"


@dataclass
class Linear:
    """Weights and what the updates need: largest value and sum of squared gradients per slot, the scale of the examples and their number."""

    weights: np.ndarray
    largest: np.ndarray
    gradients: np.ndarray
    scale: float = 0.0
    seen: float = 0.0

    @classmethod
    def empty(cls, bits: int) -> Linear:
        return cls(*(np.zeros(1 << bits) for _ in range(3)))

    def copy(self) -> Linear:
        return Linear(self.weights.copy(), self.largest.copy(), self.gradients.copy(), self.scale, self.seen)


def learn(model: Linear, slots: np.ndarray, values: np.ndarray, label: float, tau: float, rate: float) -> float:
    """One example; returns its pinball loss before the update."""
    size = np.abs(values)
    largest = model.largest[slots]
    grown = size > largest
    if grown.any():
        model.weights[slots[grown]] *= largest[grown] / size[grown]
        model.largest[slots[grown]] = size[grown]
        largest = np.maximum(largest, size)
    residual = label - float(model.weights[slots] @ values)
    slope = -tau if residual > 0 else 1 - tau
    model.scale += float(((values / largest) ** 2).sum())
    model.seen += 1
    gradient = slope * values
    model.gradients[slots] += gradient ** 2
    model.weights[slots] -= rate * np.sqrt(model.seen / model.scale) * gradient / (largest * np.sqrt(model.gradients[slots]))
    return -slope * residual


class _Batch:
    """What the updates of a batch of rows need beside the weights, worked out at once where no row that teaches has a larger value than ``start`` knows."""

    def __init__(self, largest: np.ndarray, slots: np.ndarray, values: np.ndarray, starts: np.ndarray, tau: float):
        self.slots, self.values, self.largest = slots, values, largest
        self.scales = np.add.reduceat((values / np.where(largest > 0, largest, 1.0)) ** 2, starts).tolist()
        self.gradients = {slope: slope * values for slope in (-tau, 1 - tau)}
        self.squares = {slope: x ** 2 for slope, x in self.gradients.items()}

    @classmethod
    def of(cls, start: Linear, slots: np.ndarray, values: np.ndarray, ends: np.ndarray, held: np.ndarray, tau: float) -> _Batch | None:
        starts = np.append(0, ends[:-1])
        largest = start.largest[slots]
        if not len(ends) or (starts >= ends).any() or not (np.abs(values) <= largest)[~np.repeat(held, ends - starts)].all():
            return None
        return cls(largest, slots, values, starts, tau)

    def learn(self, model: Linear, row: int, low: int, high: int, label: float, tau: float, rate: float) -> float:
        """``learn`` of a row."""
        slots = self.slots[low:high]
        weights = model.weights[slots]
        residual = label - float(weights @ self.values[low:high])
        slope = -tau if residual > 0 else 1 - tau
        model.scale += self.scales[row]
        model.seen += 1
        squares = model.gradients[slots]
        squares += self.squares[slope][low:high]
        model.gradients[slots] = squares
        np.sqrt(squares, out=squares)
        squares *= self.largest[low:high]
        step = self.gradients[slope][low:high] * (rate * sqrt(model.seen / model.scale))
        step /= squares
        weights -= step
        model.weights[slots] = weights
        return -slope * residual


def _pass_rows(start: Linear, tau: float, rate: float):
    """Rows of each part through a copy of the model; per slot what the average needs, and one row of totals (slot -1)."""

    def ended(model: Linear, totals: list[float]) -> pa.RecordBatch:
        more = model.gradients - start.gradients
        slots = np.flatnonzero(model.largest)
        columns = [np.append(slots, -1), np.append(more[slots], model.scale - start.scale), np.append(more[slots] * model.weights[slots], 0.0), np.append(model.largest[slots], 0.0)]
        columns += [np.append(np.zeros(len(slots)), x).astype(t) for x, t in zip(totals, ("f8", "i8", "f8", "i8"))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in PASSED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, model, totals, alone = None, None, [0.0, 0, 0.0, 0], False
        for batch in batches:
            slots, values = (np.asarray(batch.column(i).flatten()) for i in (3, 4))
            slots = slots.astype("i8")  # the type that numpy looks up by
            ends = np.cumsum(batch.column(3).value_lengths().to_numpy())
            low, known = 0, _Batch.of(start, slots, values, ends, batch.column(2).to_numpy(zero_copy_only=False), tau)
            for row, (p, label, held, high) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), ends.tolist())):
                if p != part:
                    if part is not None:
                        yield ended(model, totals)
                    part, model, totals, alone = p, start.copy(), [0.0, 0, 0.0, 0], False
                if held:
                    residual = label - float(start.weights[slots[low:high]] @ values[low:high])
                    totals[2] += max(tau * residual, (tau - 1) * residual)
                elif known is not None and not alone:
                    totals[0] += known.learn(model, row, low, high, label, tau, rate)
                else:
                    alone = True  # this row may have raised the largest value of a slot
                    totals[0] += learn(model, slots[low:high], values[low:high], label, tau, rate)
                totals[3 if held else 1] += 1
                low = high
        if part is not None:
            yield ended(model, totals)

    return run


def fit(
    rows: DataFrame, tau: float = 0.6, passes: int = 45, rate: float = 0.85, bits: int = 18, rows_per_part: int = ROWS_PER_PART,
    hold_out: int | None = 10, patience: int = 3,
) -> tuple[Linear, list[tuple[float, float | None]]]:
    """The model after ``passes`` over ``id, label, slots, values``; and per pass the loss of its updates and that of the held-out rows.

    One row in ``hold_out``, by a hash of its id, teaches nothing: it rates the weights a pass starts with. Passes end where ``patience`` of them brought no
    better weights, and the best ones are returned; without held-out rows the last ones are. Rows without a label are left out; an
    empty table gives zeros. Rows are dealt into parts by a hash of their id, ordered by another one and written once, so a lost
    task goes through the same rows in the same order.
    """
    rows = rows.where("label is not null")
    parts = max(1, -(-rows.count() // rows_per_part))
    place = F.xxhash64(F.lit(1), "id", "label", "slots", "values")
    held = F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(hold_out)) == 0 if hold_out else F.lit(False)
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "label", held.alias("held"), "slots", "values", place.alias("place"))
    dealt = materialise(dealt.repartition(parts, "part").sortWithinPartitions("part", "place"), "examples").drop("place")
    model, losses = Linear.empty(bits), []
    best = model, np.inf, 0
    for number in range(passes + (hold_out is not None)):
        passed = dealt.mapInArrow(_pass_rows(model, tau, rate), PASSED)
        passed = (passed.coalesce(1) if parts == 1 else passed).groupBy("slot").agg(
            F.sum("gradients"), F.sum("weighed"), F.max("largest"), F.sum("loss"), F.sum("n"), F.sum("held_loss"), F.sum("held"), F.count(F.lit(1))).toArrow()
        if not passed.num_rows:
            break
        slot, more, weighed, largest, loss, n, held_loss, held_n, count = (c.to_numpy() for c in passed.columns)
        total = int(np.flatnonzero(slot == -1)[0])
        rated = float(held_loss[total] / held_n[total]) if held_n[total] else None
        losses.append((float(loss[total] / max(1, n[total])), rated))
        if rated is not None and rated < best[1]:
            best = model, rated, number
        if rated is not None and number - best[2] >= patience or number == passes:
            break
        model = model.copy()
        slots = slot[at := np.flatnonzero((slot >= 0) & (more > 0))]
        model.weights[slots] = weighed[at] / more[at]
        model.largest[slots] = largest[at]
        model.gradients[slots] += more[at] / count[total]
        model.scale += float(more[total] / count[total])
        model.seen += float(n[total] / count[total])
    return (best[0] if np.isfinite(best[1]) else model), losses


def predict(model: Linear, rows: DataFrame) -> DataFrame:
    """``id, score`` of ``id, slots, values``; the weights, at most 2^bits, go along with the task."""
    used = np.flatnonzero(model.weights)
    weights = model.weights[used]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, values = (np.asarray(batch.column(i).flatten()) for i in (1, 2))
            at = np.minimum(np.searchsorted(used, slots), max(0, len(used) - 1))
            product = np.where(used[at] == slots, weights[at] * values, 0.0) if len(used) else np.zeros(len(slots))
            sums = np.append(0.0, np.cumsum(product))
            ends = np.append(0, np.cumsum(batch.column(1).value_lengths().to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums[ends[1:]] - sums[ends[:-1]])], ["id", "score"])

    return rows.select("id", "slots", "values").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, score double")


def pinball(rows: DataFrame, tau: float = 0.6) -> float:
    """Mean quantile loss of ``label, score``."""
    residual = F.col("label") - F.col("score")
    return rows.agg(F.avg(F.greatest(tau * residual, (tau - 1) * residual))).first()[0]
