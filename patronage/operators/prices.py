"""Unit prices, diversity and discounts per customer and item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import item_family, item_sku, smoothed
from ..session import materialise
from .order_stats import distribution, median_of, trimmed_mean_of, value_runs

ALPHA_N, PRIOR_N = 10.0, 0.5
ALPHA_ID, PRIOR_ID = 100.0, 0.1


def price_filter(transactions: DataFrame) -> DataFrame:
    return transactions.where("purchasequantity > 1 AND purchaseamount > 0.01")


def priced(transactions: DataFrame) -> DataFrame:
    """Rows with a usable price, the unit price and the item keys."""
    return price_filter(transactions).withColumns({
        "price": unit_price(),
        "item": item_sku(transactions),
        "item_family": item_family(),
    })


def unit_price():
    return F.try_divide(F.col("purchaseamount").cast("double"), F.col("purchasequantity"))


def customer_diversity(prices: DataFrame) -> DataFrame:
    """Quantity, spend and distinct items per customer, with their smoothed ratio."""
    by_item = prices.groupBy("id", "item").agg(
        F.sum("purchasequantity").alias("q"), F.sum("purchaseamount").alias("a"))
    return by_item.groupBy("id").agg(
        F.sum("q").alias("n_tot_by_id"),
        F.sum("a").cast("double").alias("spend_tot_by_id"),
        F.count("item").alias("n_unique_by_id"),
    ).withColumn("diversity_by_id", smoothed("n_unique_by_id", "n_tot_by_id", ALPHA_N, PRIOR_N))


def item_stats(prices: DataFrame, trim: float = 0.05) -> DataFrame:
    """Per item: quantity, spend, buyers, rows, trimmed mean and median price, smoothed ratio."""
    # The rows are read once, as totals per price of a customer and item.
    runs = materialise(prices.groupBy("item", "id", "price").agg(
        F.sum("purchasequantity").alias("q"), F.sum("purchaseamount").alias("a"), F.count(F.lit(1)).alias("n")), "price-runs")
    buyers = runs.groupBy("item", "id").agg(F.sum("q").alias("q"), F.sum("a").alias("a"), F.sum("n").alias("n")).groupBy("item").agg(
        F.sum("q").alias("n_all_purchases_by_item"),
        F.sum("a").cast("double").alias("spend_all_by_item"),
        F.count("id").alias("n_unique_by_item"),
        F.sum("n").alias("n_tot_by_item"),
    )
    by_price = runs.where("price is not null").groupBy("item", "price").agg(F.sum("n").alias("n"))
    typical = distribution(by_price, ["item"], "price").groupBy("item").agg(
        trimmed_mean_of("price", trim).alias("mean_price_by_item"),
        median_of("price").alias("med_price_by_item"),
    )
    return buyers.join(typical, "item", "left").withColumn(
        "diversity_by_item", smoothed("n_unique_by_item", "n_tot_by_item", ALPHA_ID, PRIOR_ID))


def discounts(prices: DataFrame, trim: float = 0.05) -> DataFrame:
    """Per (id, item): mean price against the mean price of the item, absolute and percent."""
    keys = ["id", "item", "item_family"]
    own_runs = materialise(value_runs(prices, keys, "price"), "price-runs")
    # The prices of an item are those of its customers: counted again, not scanned again.
    item_runs = own_runs.groupBy("item", "price").agg(F.sum("n").alias("n"))
    own_mean = distribution(own_runs, keys, "price").groupBy(*keys).agg(
        trimmed_mean_of("price", trim).alias("mean_price_by_id_item"))
    item_mean = distribution(item_runs, ["item"], "price").groupBy("item").agg(
        trimmed_mean_of("price", trim).alias("mean_price_by_item"))
    gap = F.col("mean_price_by_item") - F.col("mean_price_by_id_item")
    return own_mean.join(item_mean, "item").select(
        "id", "item", "item_family", "mean_price_by_id_item", "mean_price_by_item",
        gap.alias("price_discount"),
        F.try_divide(100.0 * gap, F.col("mean_price_by_item")).alias("price_discount_percent"),
    )


def customer_discount(history: DataFrame, discount_rows: DataFrame) -> DataFrame:
    """Discount percent averaged to (id, family), then to id, on every history row."""
    by_family = discount_rows.groupBy("id", "item_family").agg(F.avg("price_discount_percent").alias("d"))
    by_id = by_family.groupBy("id").agg(F.avg("d").alias("mean_discount_percent"))
    return history.join(by_id, "id", "left")
