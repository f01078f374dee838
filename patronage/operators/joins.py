"""Lookups between history, offers, transactions and scores, and the row reductions.

No side is broadcast by hand: Catalyst and AQE broadcast what measures below
``spark.sql.autoBroadcastJoinThreshold`` and shuffle the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def history_with_offers(history: DataFrame, offers: DataFrame) -> DataFrame:
    """Inner join on offer; the label count and the offer quantity are dropped."""
    return history.join(offers, "offer").drop("repeattrips", "quantity")


def history_with_offers_outer(history: DataFrame, offers: DataFrame) -> DataFrame:
    """Every history row, with offer columns where the offer is known."""
    return history.join(offers, "offer", "left")


def customer_offers(history: DataFrame, offers: DataFrame) -> DataFrame:
    """One row per customer: id and the attributes of the offer they got, as ``offer_*``."""
    return history.join(offers, "offer").select(
        "id",
        "offer",
        F.col("chain").alias("offer_chain"),
        F.col("market").alias("offer_market"),
        F.col("offerdate").alias("offer_date"),
        F.col("category").alias("offer_category"),
        F.col("company").alias("offer_company"),
        F.col("brand").alias("offer_brand"),
        F.col("offervalue").alias("offer_value"),
        F.col("quantity").alias("offer_quantity"),
    )


def transactions_with_offer(transactions: DataFrame, history: DataFrame, offers: DataFrame) -> DataFrame:
    """Every transaction before the offer date, with the offer of its customer."""
    return transactions.join(customer_offers(history, offers), "id").where("date < offer_date")


def reduce_rows(transactions: DataFrame, offers: DataFrame, *keys: str) -> DataFrame:
    """Transactions whose value of any of ``keys`` is on offer."""
    if len(keys) == 1:
        return transactions.join(offers.select(keys[0]).distinct(), keys[0], "left_semi").select(
            transactions.columns)
    flagged = transactions
    for k in keys:
        on_offer = offers.select(k).distinct().withColumn(f"_on_{k}", F.lit(True))
        flagged = flagged.join(on_offer, k, "left")
    hit = reduce(lambda a, b: a | b, [F.col(f"_on_{k}").isNotNull() for k in keys])
    return flagged.where(hit).select(transactions.columns)


def left_join_aggregates(frame: DataFrame, aggregates: DataFrame, keys: list[str]) -> DataFrame:
    return frame.join(aggregates, keys, "left")


def scores_or_zero(test: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, repeatProbability) for every test id; a missing score is 0."""
    return test.select("id").join(scores.select("id", "score"), "id", "left").select(
        "id", F.coalesce("score", F.lit(0.0)).alias("repeatProbability"))


def ids_without(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct ids of ``left`` that do not occur in ``right``."""
    return left.select("id").distinct().join(right.select("id"), "id", "left_anti")


def cluster_lookup(rows: DataFrame, stats: DataFrame) -> DataFrame:
    return rows.join(stats, "cluster")


def stack(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train rows over test rows; a column only one side has is NULL on the other."""
    return train.unionByName(test, allowMissingColumns=True)


def union_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()
