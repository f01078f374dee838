"""Counts, sums, medians, visit statistics and match counters over transactions."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import RECENCY_NAMES, diff_days, recency_bin, smoothed
from ..session import materialise
from .joins import customer_offers
from .order_stats import combinations_of, grouped_medians, weighted_medians, whole_groups


def count_by(transactions: DataFrame, *keys: str, alias: str) -> DataFrame:
    return transactions.groupBy(*keys).agg(F.count(F.lit(1)).alias(alias))


def quantity_by(transactions: DataFrame, *keys: str) -> DataFrame:
    return transactions.groupBy(*keys).agg(F.sum("purchasequantity").alias("sum_pq"))


def not_this_brand(transactions: DataFrame) -> DataFrame:
    """Rows per (id, category, company, brand) and rows of the same line in other brands.

    The window runs over pre-aggregated rows: one per brand of a (customer, category, company).
    """
    counts = count_by(transactions, "id", "category", "company", "brand", alias="count_trans")
    line = Window.partitionBy("id", "category", "company")
    return counts.withColumn(
        "count_not_this_brand", F.sum("count_trans").over(line) - F.col("count_trans"))


def basket_size(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("id", "chain").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("date").alias("visits")
    ).select("id", "chain", (F.col("n") / (F.col("visits") + 1.0)).alias("avg_basket_size"), "visits")


def monthly_spend(transactions: DataFrame) -> DataFrame:
    months = F.datediff(F.max("date"), F.min("date")) / F.lit(30.0)
    return transactions.groupBy("id", "chain").agg(
        F.sum("purchaseamount").cast("double").alias("spend"), months.alias("max_min_months")
    ).select(
        "id", "chain",
        (F.col("spend") / (F.col("max_min_months") + 1)).alias("monthly_avg_pa"),
        "max_min_months",
    )


def sums_by_category(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("id", "category").agg(
        F.sum("productsize").cast("double").alias("productsize"),
        F.sum("purchasequantity").alias("purchasequantity"),
        F.sum("purchaseamount").cast("double").alias("purchaseamount"),
    )


def by_customer_item(transactions: DataFrame, item: Column) -> DataFrame:
    return transactions.withColumn("item", item).groupBy("id", "item").agg(
        F.count(F.lit(1)).alias("n_item_ids"),
        F.sum("purchasequantity").alias("n_purchases"),
        F.sum("purchaseamount").cast("double").alias("tot_amount"),
        F.min("purchaseamount").cast("double").alias("min_price"),
        F.max("purchaseamount").cast("double").alias("max_price"),
    )


def rollup_to_customer(by_item: DataFrame) -> DataFrame:
    """Re-aggregation of ``by_customer_item``; the rows are already one per (id, item)."""
    return by_item.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_unique"),
        F.sum("n_purchases").alias("n_purchases_all"),
        F.sum("tot_amount").alias("tot_amount_all"),
        F.min("min_price").alias("min_price_all"),
        F.max("max_price").alias("max_price_all"),
    )


def offer_item_diversity(
    history_offers: DataFrame, by_item: DataFrame, item: Column, alpha: float = 30.0, prior: float = 0.1
) -> DataFrame:
    """Smoothed ratio for the item on offer; NULL where the customer never bought it."""
    own = history_offers.select("id", item.alias("item"))
    return own.join(by_item.select("id", "item", "n_purchases"), ["id", "item"], "left").select(
        "id", "item", "n_purchases", smoothed("n_purchases", "n_purchases", alpha, prior).alias("diversity"))


# The four measures of a group and the prefix of their columns.
MEDIAN_PREFIXES = {"len": "n_rows", "ps_median": "med_productsize",
                   "pq_median": "med_purchasequantity", "pa_median": "med_purchaseamount"}
GROUP_ATTRIBUTES = ("category", "company", "brand")


def key_subsets() -> list[tuple[str, ...]]:
    return [c for size in range(4) for c in combinations(GROUP_ATTRIBUTES, size)]


def group_medians(transactions: DataFrame, history: DataFrame, offers: DataFrame) -> DataFrame:
    """Count and medians for {id} x subsets of (category, company, brand), all time and per bin.

    Only rows that match the customer's own offer on a subset can join to it, so a row counts once
    per subset it matches instead of once per grouping set.
    """
    subsets = key_subsets()
    own = customer_offers(history, offers)
    measures = list(_MEASURES)
    matched = transactions.join(own, "id").select(
        "id",
        _matches([F.col(k) == F.col(f"offer_{k}") for k in GROUP_ATTRIBUTES]).alias("on"),
        recency_bin(diff_days("offer_date", "date")).alias("bin"),
        *measures,
    )
    # Rows are collapsed and shuffled once, before they fan out to key sets and bins. Customers that lie in one partition fan out
    # in its task; the others, among them hot ones, are ordered over all partitions.
    runs = combinations_of(matched, ["id", "on", "bin"], measures)
    found = materialise(whole_groups(runs, "id", _whole_customers, _other_rows, _FOUND), "groups")
    fanned = found.where("subset < 0").withColumn("subset", F.explode(F.array_compact(F.array(*[
        F.when((-1 - F.col("subset")).bitwiseAND(_bits(s)) == _bits(s), F.lit(i)) for i, s in enumerate(subsets)
    ])))).withColumn("bin", F.explode(F.array_compact(F.array(F.lit(-1), F.col("bin")))))
    groups = found.where("subset >= 0").withColumnsRenamed({"n": "n_rows", **{m: f"med_{m}" for m in measures}}).unionByName(
        grouped_medians(fanned, ["id", "subset", "bin"], measures))
    # One short list per customer, not a row of all columns while it is being filled.
    cell = F.struct((F.col("subset") * (len(RECENCY_NAMES) + 1) + F.col("bin") + 1).alias("at"), F.struct(*MEDIAN_PREFIXES.values()).alias("cell"))
    cells = groups.groupBy("id").agg(F.map_from_entries(F.collect_list(cell)).alias("cells"))
    bins = [None, *RECENCY_NAMES]
    named = cells.select("id", *[
        F.try_element_at("cells", F.lit(i * len(bins) + b))[column].alias(f"{prefix}_{i}" if name is None else f"{prefix}_{name}_{i}")
        for i in range(len(subsets)) for b, name in enumerate(bins) for prefix, column in MEDIAN_PREFIXES.items()])
    return history.select("id").join(named, "id", "left")


def _bits(subset: tuple[str, ...]) -> int:
    return sum(1 << GROUP_ATTRIBUTES.index(k) for k in subset)


def _matches(on: list[Column]) -> Column:
    """One bit for each condition that holds."""
    out = F.lit(0)
    for i, c in enumerate(on):
        out = out + F.when(c, 1 << i).otherwise(0)
    return out.cast("int")


# Groups of whole customers, with ``subset``, ``n`` rows and medians; rows of other customers as they came, ``subset`` below 0 for their matches.
_FOUND = "id bigint, subset int, bin int, n bigint, productsize double, purchasequantity double, purchaseamount double"
_MEASURES = ("productsize", "purchasequantity", "purchaseamount")


def _other_rows(rows: pa.Table) -> pa.Table:
    subset = pa.array((-1 - rows["on"].to_numpy()).astype("i4"))
    return pa.table([rows["id"], subset, rows["bin"], rows["n"], *(rows[m] for m in _MEASURES)], names=["id", "subset", "bin", "n", *_MEASURES])


def _whole_customers(rows: pa.Table) -> pa.Table:
    """The groups of customers whose rows are all here, in order of their ids."""
    ids, on, n = (rows[c].to_numpy() for c in ("id", "on", "n"))
    first = np.concatenate(([True], ids[1:] != ids[:-1]))
    customer, slots = np.cumsum(first) - 1, len(RECENCY_NAMES) + 1
    slot = pc.fill_null(rows["bin"], -1).to_numpy() + 1
    subsets = key_subsets()
    row, group = [], []
    for i, s in enumerate(subsets):
        hit = np.flatnonzero((on & _bits(s)) == _bits(s))
        dated = hit[slot[hit] > 0]
        row += [hit, dated]
        group += [(customer[hit] * len(subsets) + i) * slots, (customer[dated] * len(subsets) + i) * slots + slot[dated]]
    row, group = np.concatenate(row), np.concatenate(group)
    groups, at = np.unique(group, return_inverse=True)
    columns = [ids[first][groups // (len(subsets) * slots)], (groups // slots % len(subsets)).astype("i4"), (groups % slots - 1).astype("i4"),
               np.bincount(at, n[row], len(groups)).astype("i8")]
    for m in _MEASURES:
        known = pc.is_valid(rows[m]).to_numpy()[row]
        median = np.zeros(len(groups))
        held, found = weighted_medians(at[known], pc.fill_null(rows[m], 0.0).to_numpy()[row[known]], n[row[known]])
        median[held] = found
        missing = np.ones(len(groups), bool)
        missing[held] = False
        columns.append(pa.array(median, mask=missing))
    return pa.table(columns, names=["id", "subset", "bin", "n", *_MEASURES])


def match_counts(transactions: DataFrame, history: DataFrame, offers: DataFrame) -> DataFrame:
    """Per customer, how many transactions share an attribute with their own offer."""
    own = customer_offers(history, offers)
    names = ("category", "chain", "brand", "company")
    hits = transactions.join(own, "id").where("date < offer_date").groupBy("id").agg(
        F.count(F.lit(1)).alias("n_tot"),
        *[F.count(F.when(F.col(k) == F.col(f"offer_{k}"), 1)).alias(f"n_{k}") for k in names],
    )
    columns = ["n_tot", *[f"n_{k}" for k in names]]
    return own.select("id").join(hits, "id", "left").select(
        "id", *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])


def match_audit(transactions: DataFrame, history: DataFrame) -> DataFrame:
    """Unique shoppers, and how many of them have no offer."""
    shoppers = transactions.select("id").distinct()
    flagged = shoppers.join(history.select("id").distinct().withColumn("_known", F.lit(True)), "id", "left")
    return flagged.agg(
        F.count(F.lit(1)).alias("unique_shoppers"),
        F.count(F.when(F.col("_known").isNull(), 1)).alias("without_offer"),
    )


def distinct_counts(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n_distinct) for each column, by one pass over the (feature, value) pairs."""
    texts = frame.select(*[F.col(c).cast("string").alias(c) for c in columns])
    pairs = texts.unpivot([], columns, "feature", "value").distinct()
    return pairs.groupBy("feature").agg(F.count("value").alias("n_distinct"))
