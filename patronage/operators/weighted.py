"""Weighted factorization of implicit pairs with one ridge for all, by alternating normal equations.

A pair with value r has confidence 1 + alpha r and preference 1, any other pair confidence 1 and preference 0. The factors of one side
come from those of the other: x = (G + sum alpha r y y' + ridge I)^-1 sum (1 + alpha r) y, where G, the Gram matrix of all
y, is shared. The sums are one grouped aggregation over the pairs, combined before the shuffle, so a hot customer or item
is a single row when it is solved. The ridge is not scaled by the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def start(ids: DataFrame, rank: int, seed: int) -> DataFrame:
    """``id, f0..``: seeded factors between 0 and 1 / sqrt(rank), a function of the id."""
    unit = [F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), F.col("id").cast("bigint")), 11) / F.lit(float(1 << 53) * rank ** 0.5) for k in range(rank)]
    return ids.select("id", *[u.alias(f"f{k}") for k, u in enumerate(unit)])


def _pairs_of(rank: int) -> list[tuple[int, int]]:
    return [(i, k) for i in range(rank) for k in range(i, rank)]


def gram(factors: DataFrame, rank: int) -> np.ndarray:
    """Sum of y y' over all rows: one row of sums."""
    sums = factors.agg(*[F.coalesce(F.sum(F.col(f"f{i}") * F.col(f"f{k}")), F.lit(0.0)) for i, k in _pairs_of(rank)]).first()
    out = np.zeros((rank, rank))
    for (i, k), x in zip(_pairs_of(rank), sums):
        out[i, k] = out[k, i] = x
    return out


def solved(pairs: DataFrame, factors: DataFrame, rank: int, ridge: float, alpha: float) -> DataFrame:
    """``id, f0..`` of the side ``own`` of ``own, other, value``, given those of ``other``."""
    shared = gram(factors, rank) + ridge * np.eye(rank)
    upper = np.triu_indices(rank)

    def y(k: int) -> Column:
        return F.col(f"f{k}")

    sums = [F.sum(alpha * F.col("value") * y(i) * y(k)).alias(f"a{i}_{k}") for i, k in _pairs_of(rank)]
    sums += [F.sum((1 + alpha * F.col("value")) * y(k)).alias(f"b{k}") for k in range(rank)]
    rows = pairs.join(factors.withColumnRenamed("id", "other"), "other").groupBy(F.col("own").alias("id")).agg(*sums)
    width = len(sums)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.column_stack([c.to_numpy() for c in batch.columns[1:]]) if batch.num_rows else np.zeros((0, width))
            left = np.zeros((len(values), rank, rank))
            left[:, upper[0], upper[1]] = values[:, :len(upper[0])]
            left[:, upper[1], upper[0]] = values[:, :len(upper[0])]
            found = np.linalg.solve(left + shared, values[:, len(upper[0]):, None])[..., 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in found.T)], ["id", *(f"f{k}" for k in range(rank))])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(solve, f"id {kind}, " + ", ".join(f"f{k} double" for k in range(rank)))


def weighted_factors(pairs: DataFrame, rank: int = 10, iterations: int = 4, ridge: float = 0.02, alpha: float = 1.0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``vec_id, features`` of the users and of the items of ``user_idx, item_idx, value``, after ``iterations`` of users, then items.

    Pairs are dealt once by user and once by item, and factors are written after each half, so no lineage grows. Repeated pairs add
    up, pairs with a null part are left out, users and items without pairs have no factors, and an empty table gives none.
    """
    pairs = pairs.where("user_idx is not null and item_idx is not null and value is not null").groupBy("user_idx", "item_idx").agg(F.sum(F.col("value").cast("double")).alias("value"))
    pairs = materialise(pairs, "pairs")
    by_user = materialise(pairs.select(F.col("user_idx").alias("own"), F.col("item_idx").alias("other"), "value").repartition("other"), "by-user")
    by_item = materialise(pairs.select(F.col("item_idx").alias("own"), F.col("user_idx").alias("other"), "value").repartition("other"), "by-item")
    items = materialise(start(pairs.select(F.col("item_idx").alias("id")).distinct(), rank, seed), "items")
    users = None
    for _ in range(iterations):
        users = materialise(solved(by_user, items, rank, ridge, alpha), "users")
        items = materialise(solved(by_item, users, rank, ridge, alpha), "items")
    if users is None:
        users = items.limit(0)

    def table(factors: DataFrame) -> DataFrame:
        return factors.select(F.col("id").cast("bigint").alias("vec_id"), F.array(*[f"f{k}" for k in range(rank)]).alias("features"))

    return table(users), table(items)


def loss(pairs: DataFrame, users: DataFrame, items: DataFrame, ridge: float = 0.02, alpha: float = 1.0) -> float:
    """The weighted squared error over all pairs, present or not, and the ridge; the absent ones come from the Gram matrices."""
    def flat(table: DataFrame, rank: int) -> DataFrame:
        return table.select("vec_id", *[F.col("features")[k].alias(f"f{k}") for k in range(rank)])

    first = users.first()
    if first is None:
        return 0.0
    rank = len(first["features"])
    u, v = gram(flat(users, rank), rank), gram(flat(items, rank), rank)
    guess = F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    met = pairs.join(users.select(F.col("vec_id").alias("user_idx"), F.col("features").alias("u")), "user_idx").join(
        items.select(F.col("vec_id").alias("item_idx"), F.col("features").alias("v")), "item_idx")
    present = met.agg(F.coalesce(F.sum((1 + alpha * F.col("value")) * (1 - guess) ** 2 - guess ** 2), F.lit(0.0))).first()[0]
    return float(present + (u * v).sum() + ridge * (np.trace(u) + np.trace(v)))
