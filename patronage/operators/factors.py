"""User x item pairs, factorization, and features from the factors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp_score, dot, log_scale, product
from ..session import materialise, shared_dir
from .order_stats import join_on, ranked

RANK = 10  # of the fits
ITEM_KEYS = ("category", "company", "brand")


def user_numbers(counts: DataFrame) -> DataFrame:
    """(id, user_idx): dense numbers from 1 in id order."""
    users = counts.select("id").distinct()
    return ranked(users, [F.col("id")]).select(
        "id", (F.col("rank0") + 1).cast("int").alias("user_idx"))


def item_numbers(counts: DataFrame, keys: Sequence[str] = ITEM_KEYS) -> DataFrame:
    """(keys, item_idx): dense numbers from 1 in key order, over the distinct items of the catalogue."""
    items = counts.select(*keys).distinct()
    return ranked(items, [F.col(k) for k in keys]).select(
        *keys, (F.col("rank0") + 1).cast("int").alias("item_idx"))


def numbered(counts: DataFrame, keys: Sequence[str] = ITEM_KEYS) -> DataFrame:
    """Per (id, keys) rows with their user_idx and item_idx. The counts are written once, as all three read them."""
    counts = materialise(counts, "counts")
    return join_on(join_on(counts, user_numbers(counts), ["id"]), item_numbers(counts, keys), keys)


def pair_counts(transactions: DataFrame, keys: Sequence[str] = ITEM_KEYS, only_count: int | None = None) -> DataFrame:
    """(user_idx, item_idx, n, value): purchases per pair and their log scale."""
    counts = transactions.groupBy("id", *keys).agg(F.count(F.lit(1)).alias("n"))
    pairs = numbered(counts, keys).select("user_idx", "item_idx", "n", log_scale("n").alias("value"))
    return pairs if only_count is None else pairs.where(F.col("n") == only_count)


def value_cutoff(pairs: DataFrame, cutoff: float = 1.5) -> DataFrame:
    return pairs.where(F.col("value") > cutoff)


def als_implicit(pairs: DataFrame, rank: int = RANK, iterations: int = 4, reg: float = 0.02, alpha: float = 1.0,
                 seed: int = 42) -> ALSModel:
    shared_dir(pairs.sparkSession)
    return ALS(rank=rank, maxIter=iterations, regParam=reg, implicitPrefs=True, alpha=alpha, seed=seed,
               userCol="user_idx", itemCol="item_idx", ratingCol="value").fit(pairs)


def als_explicit(
    ratings: DataFrame, rank: int = RANK, iterations: int = 50, reg: float = 0.1, holdout: float = 0.2, seed: int = 42
) -> DataFrame:
    """Holdout predictions of a non-negative factorization of (user_idx, item_idx, rating) with bias.

    The bias is the user mean plus the item mean less the overall mean; the factors fit what is left,
    shifted to start at 0.
    """
    # The split must not change when a lost executor's rows are computed again.
    ratings = materialise(ratings, "ratings")
    shared_dir(ratings.sparkSession)
    train, test = ratings.randomSplit([1 - holdout, holdout], seed)
    by_user = train.groupBy("user_idx").agg(F.avg("rating").alias("b_u"))
    by_item = train.groupBy("item_idx").agg(F.avg("rating").alias("b_i"))
    mean = train.agg(F.avg("rating")).first()[0]

    def with_bias(rows: DataFrame) -> DataFrame:
        return rows.join(by_user, "user_idx", "left").join(by_item, "item_idx", "left").withColumn(
            "bias", F.coalesce("b_u", F.lit(mean)) + F.coalesce("b_i", F.lit(mean)) - F.lit(mean))

    residuals = materialise(
        with_bias(train).select("user_idx", "item_idx", (F.col("rating") - F.col("bias")).alias("residual")), "residuals")
    shift = residuals.agg(F.min("residual")).first()[0]
    model = ALS(rank=rank, maxIter=iterations, regParam=reg, nonnegative=True, seed=seed, coldStartStrategy="nan",
                userCol="user_idx", itemCol="item_idx", ratingCol="residual").fit(
        residuals.select("user_idx", "item_idx", (F.col("residual") - F.lit(shift)).alias("residual")))
    scored = with_bias(model.transform(test))
    uv = F.when(F.isnan("prediction"), F.lit(0.0)).otherwise(F.col("prediction") + F.lit(shift))
    return scored.select("user_idx", "item_idx", "rating", (F.col("bias") + uv).cast("double").alias("prediction"))


def factor_table(factors: DataFrame) -> DataFrame:
    """ALS factors as (vec_id, features)."""
    return factors.select(F.col("id").cast("long").alias("vec_id"), F.col("features").cast("array<double>").alias("features"))


def with_factors(customers: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (u_id, v_id, ...) with their factors ``u`` and ``v``; an unknown side zeroes both, as ``unknown``.

    The length of the zeros is that of the known factors.
    """
    zeros = F.array_repeat(F.lit(0.0), F.coalesce(users.agg(F.max(F.size("features"))).scalar(), F.lit(0)))
    rows = (
        customers
        .join(users.select(F.col("vec_id").alias("u_id"), F.col("features").alias("_u")), "u_id", "left")
        .join(items.select(F.col("vec_id").alias("v_id"), F.col("features").alias("_v")), "v_id", "left")
    )
    known = F.col("_u").isNotNull() & F.col("_v").isNotNull()
    return rows.withColumns({
        "u": F.when(known, F.col("_u")).otherwise(zeros),
        "v": F.when(known, F.col("_v")).otherwise(zeros),
        "unknown": ~known,
    }).drop("_u", "_v")


def products(rows: DataFrame) -> DataFrame:
    """Adds ``uv``, the pointwise product."""
    return rows.withColumn("uv", product("u", "v"))


def raw_score(uv="uv"):
    return F.aggregate(uv, F.lit(0.0), lambda s, x: s + x)


def super_features(rows: DataFrame) -> DataFrame:
    """u, v, their product and their dot product in one array."""
    return products(rows).withColumn("super", F.concat("u", "v", "uv", F.array(dot("u", "v"))))


def factor_columns(rows: DataFrame, dim: int = RANK) -> DataFrame:
    """MF0.. and ``score`` as columns."""
    return products(rows).withColumns({
        **{f"MF{i}": F.get("uv", F.lit(i)) for i in range(dim)},
        "score": raw_score(),
    }).drop("u", "v", "uv")


def clamped_scores(rows: DataFrame) -> DataFrame:
    return products(rows).select("id", clamp_score(raw_score()).alias("score"))
