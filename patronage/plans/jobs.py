"""End-to-end jobs: from the loyalty tables to features, encoded frames and cluster scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusters, encode, factors, features, joins, weighted
from ..operators.aggregates import sums_by_category
from ..operators.order_stats import join_on
from ..session import materialise
from ..sources.shop import CUTOFF, UNKNOWN_KEYS, Shop


def priced_features(shop: Shop, cutoff: str = CUTOFF) -> DataFrame:
    """Feature table joined to the statistics of the item on offer."""
    table = features.feature_table(shop.transactions, shop.history_train, shop.history_test, shop.offers)
    stats = features.price_ratios(features.items_with_categories(
        features.item_history(shop.transactions, cutoff),
        features.category_history(shop.transactions, cutoff)))
    return features.features_with_item_stats(table, stats)


def model_frames(shop: Shop) -> tuple[DataFrame, DataFrame]:
    sums = materialise(sums_by_category(shop.transactions), "sums")
    return (
        encode.model_frame(shop.history_train, shop.offers, sums),
        encode.model_frame(shop.history_test, shop.offers, sums),
    )


def factor_rows(shop: Shop, history: DataFrame) -> DataFrame:
    """History with the factors of the customer and of the item on offer."""
    numbered = joins.history_with_offers_outer(history, shop.offers.select("offer")).withColumns({
        "u_id": 2 * F.pmod("id", shop.half_vectors() + UNKNOWN_KEYS),
        "v_id": 2 * F.pmod("offer", shop.half_vectors() + UNKNOWN_KEYS) + 1,
    })
    return factors.with_factors(numbered, shop.user_factors, shop.item_factors)


def fitted_factor_rows(shop: Shop, history: DataFrame) -> DataFrame:
    """The same from an implicit factorization of the shop's own purchases.

    Purchases per pair are counted once; customers and items below the value cutoff have no factors.
    """
    counts = materialise(
        shop.transactions.groupBy("id", *factors.ITEM_KEYS).agg(F.count(F.lit(1)).alias("n")), "counts")
    users, items = factors.user_numbers(counts), factors.item_numbers(counts)
    pairs = factors.value_cutoff(
        join_on(join_on(counts, users, ["id"]), items, factors.ITEM_KEYS)
        .select("user_idx", "item_idx", factors.log_scale("n").alias("value")))
    user_factors, item_factors = weighted.weighted_factors(pairs)
    offered = joins.history_with_offers_outer(history, shop.offers)
    offered = join_on(offered, users.withColumnRenamed("user_idx", "u_id"), ["id"], "left")
    offered = join_on(offered, items.withColumnRenamed("item_idx", "v_id"), factors.ITEM_KEYS, "left")
    return factors.with_factors(offered, user_factors, item_factors)


def labelled_clusters(shop: Shop, history: DataFrame) -> DataFrame:
    """History with the given cluster of each customer: the label of their vector."""
    vectors = shop.user_factors.select(F.col("vec_id").alias("u_id"), F.col("label").alias("cluster"))
    return history.withColumn("u_id", 2 * F.pmod("id", shop.half_vectors())).join(vectors, "u_id").drop("u_id")


def cluster_job(shop: Shop, k: int = 75) -> DataFrame:
    """Factorize, cluster train and test by factor products, calibrate on train, and rate both."""
    rows = factors.products(fitted_factor_rows(shop, shop.history_base))
    assigned = clusters.fit_assign(rows, k)
    train = shop.saved_train.join(assigned, "id")
    return clusters.outputs(train, shop.history_test.join(assigned, "id"), clusters.calibrate(train))
