"""Per-customer purchase features against the customer's own offer."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import TEST_LABEL, joined, label_of
from ..session import materialise
from .joins import customer_offers, transactions_with_offer

WINDOWS = (30, 60, 90, 180)
ATTRIBUTES = ("company", "category", "brand")


def _bought(name: str, match: Column, windows: Iterable[int]) -> list[Column]:
    """Count, quantity and amount of matching rows, all time and per window; NULL without a match."""
    out = []
    for n in (None, *windows):
        hit = match if n is None else match & (F.col("_days") < n)
        suffix = "" if n is None else f"_{n}"
        out += [
            F.sum(F.when(hit, F.lit(1.0))).alias(f"has_bought_{name}{suffix}"),
            F.sum(F.when(hit, F.col("purchasequantity"))).alias(f"has_bought_{name}_q{suffix}"),
            F.sum(F.when(hit, F.col("purchaseamount"))).cast("double").alias(f"has_bought_{name}_a{suffix}"),
        ]
    return out


def _matched(transactions: DataFrame, history: DataFrame, offers: DataFrame) -> DataFrame:
    rows = transactions_with_offer(transactions, history, offers)
    return rows.withColumns({
        "_days": F.datediff("offer_date", "date"),
        **{f"_m_{k}": F.col(k) == F.col(f"offer_{k}") for k in (*ATTRIBUTES, "chain")},
    })


def _written(rows: DataFrame) -> DataFrame:
    """What both the first matches and the totals read, written once."""
    flags = [f"_m_{k}" for k in (*ATTRIBUTES, "chain")]
    return materialise(rows.select("id", "dept", "date", "txn_seq", "purchasequantity", "purchaseamount", "_days", *flags), "matched")


def _customer_totals(windows: Iterable[int]) -> list[Column]:
    return [
        F.sum("purchaseamount").cast("double").alias("total_spend"),
        F.max(F.when(F.col("_m_chain"), F.lit(1))).alias("has_bought_at_chain_before"),
        *[c for k in ATTRIBUTES for c in _bought(k, F.col(f"_m_{k}"), windows)],
    ]


def buy_history(
    transactions: DataFrame, history: DataFrame, offers: DataFrame, windows: Iterable[int] = WINDOWS
) -> DataFrame:
    """One join and one aggregation by customer for all windows and attributes."""
    return _matched(transactions, history, offers).groupBy("id").agg(*_customer_totals(windows))


def dept_first_match(rows: DataFrame) -> DataFrame:
    """Earliest (date, txn_seq) per (id, dept) that matches the offer on all three attributes."""
    full = F.col("_m_company") & F.col("_m_category") & F.col("_m_brand")
    return rows.where(full).groupBy("id", "dept").agg(F.min(F.struct("date", "txn_seq")).alias("first_match"))


def _after_first() -> Column:
    return F.struct("date", "txn_seq") > F.col("first_match")


def first_matches(transactions: DataFrame, history: DataFrame, offers: DataFrame) -> DataFrame:
    return dept_first_match(_matched(transactions, history, offers)).select(
        "id", "dept", F.col("first_match.date").alias("first_date"), F.col("first_match.txn_seq").alias("first_seq"))


def buy_history_dept(
    transactions: DataFrame, history: DataFrame, offers: DataFrame, windows: Iterable[int] = WINDOWS
) -> DataFrame:
    """Purchases in a department after the first full match there; customers without any are absent."""
    rows = _written(_matched(transactions, history, offers))
    later = rows.join(dept_first_match(rows), ["id", "dept"]).where(_after_first())
    return later.groupBy("id").agg(*_bought("dept", F.lit(True), windows))


def _present(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"has_bought_{n}").isNotNull()
    return out


def _flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1))


def never_bought() -> dict[str, Column]:
    return {
        f"never_bought_{k}": _flag(F.col(f"has_bought_{k}").isNull())
        for k in (*ATTRIBUTES, "dept")
    }


# The combinations of attributes that get a flag of their own.
CROSSES = ("brand_company_category", "brand_category", "brand_company", "brand_dept", "company_dept")


def cross_flags() -> dict[str, Column]:
    return {f"has_bought_{c}": _flag(_present(*c.split("_"))) for c in CROSSES}


def with_flags(features: DataFrame) -> DataFrame:
    return features.withColumns({**never_bought(), **cross_flags()})


def offer_context(history: DataFrame, offers: DataFrame) -> DataFrame:
    """The offer on the customer's row, with the key of the item on offer."""
    return customer_offers(history, offers).drop("offer").withColumn(
        "offer_item_id", joined("offer_category", "offer_company", "offer_brand"))


def labels(train: DataFrame, test: DataFrame) -> DataFrame:
    """(id, label): 1 / 0 for train, 0.5 for test."""
    return train.select("id", label_of("repeater").alias("label")).unionByName(
        test.select("id", F.lit(TEST_LABEL).alias("label")))


def feature_table(
    transactions: DataFrame,
    train: DataFrame,
    test: DataFrame,
    offers: DataFrame,
    windows: Iterable[int] = (30, 180),
) -> DataFrame:
    """One row per customer with transactions: label, purchase features, flags and offer context."""
    history = train.select(test.columns).unionByName(test)
    windows = list(windows)
    rows = _written(_matched(transactions, history, offers))
    # One aggregation by customer serves all attributes; rows of a department without a full match
    # have no first match and so count for nothing there.
    bought = rows.join(dept_first_match(rows), ["id", "dept"], "left").groupBy("id").agg(
        *_customer_totals(windows), *_bought("dept", _after_first(), windows))
    return (
        with_flags(bought)
        .join(offer_context(history, offers), "id")
        .join(labels(train, test), "id")
    )


# The exported columns, in file order.
FEATURE_FIELDS = [
    "label", "id", "has_bought_at_chain_before",
    "has_bought_brand", "has_bought_brand_180", "has_bought_brand_30",
    "has_bought_brand_a", "has_bought_brand_a_180", "has_bought_brand_a_30",
    "has_bought_brand_category", "has_bought_brand_company", "has_bought_brand_company_category",
    "has_bought_brand_dept", "has_bought_brand_q", "has_bought_brand_q_180", "has_bought_brand_q_30",
    "has_bought_category", "has_bought_category_180", "has_bought_category_30",
    "has_bought_category_a", "has_bought_category_a_180", "has_bought_category_a_30",
    "has_bought_category_q", "has_bought_category_q_180", "has_bought_category_q_30",
    "has_bought_company", "has_bought_company_180", "has_bought_company_30",
    "has_bought_company_a", "has_bought_company_a_180", "has_bought_company_a_30",
    "has_bought_company_dept", "has_bought_company_q", "has_bought_company_q_180", "has_bought_company_q_30",
    "has_bought_dept", "has_bought_dept_180", "has_bought_dept_30",
    "has_bought_dept_a", "has_bought_dept_a_180", "has_bought_dept_a_30",
    "has_bought_dept_q", "has_bought_dept_q_180", "has_bought_dept_q_30",
    "never_bought_brand", "never_bought_category", "never_bought_company", "never_bought_dept",
    "offer_brand", "offer_category", "offer_chain", "offer_company", "offer_date", "offer_market",
    "offer_quantity", "offer_value", "offer_item_id", "total_spend",
]


def item_window(transactions: DataFrame, cutoff: str, days: int = 180) -> DataFrame:
    age = F.datediff(F.lit(cutoff).cast("date"), F.col("date"))
    return transactions.where((age > 0) & (age < days))


def item_history(transactions: DataFrame, cutoff: str) -> DataFrame:
    """Count, amount and quantity per item in the window before the cutoff."""
    return item_window(transactions, cutoff).groupBy("category", "company", "brand").agg(
        F.count(F.lit(1)).alias("item_total"),
        F.sum("purchaseamount").cast("double").alias("item_amount"),
        F.sum("purchasequantity").alias("item_quantity"),
    ).select(
        joined("category", "company", "brand").alias("item_id"),
        *[F.col(k).cast("string").alias(f"item_{k}") for k in ("category", "company", "brand")],
        "item_total", "item_amount", "item_quantity")


def category_history(transactions: DataFrame, cutoff: str) -> DataFrame:
    return item_window(transactions, cutoff).groupBy(F.col("category").alias("category_id")).agg(
        F.count(F.lit(1)).alias("category_total"),
        F.sum("purchaseamount").cast("double").alias("category_amount"),
        F.sum("purchasequantity").alias("category_quantity"),
    )


def items_with_categories(items: DataFrame, categories: DataFrame) -> DataFrame:
    return items.join(categories, items["item_category"].eqNullSafe(categories["category_id"].cast("string")))


def price_ratios(items_categories: DataFrame) -> DataFrame:
    item_cost = F.try_divide(F.col("item_amount"), F.col("item_total"))
    category_cost = F.try_divide(F.col("category_amount"), F.col("category_total"))
    return items_categories.withColumns({
        "item_popularity": F.try_divide(F.col("item_total"), F.col("category_total")),
        "item_avg_cost": item_cost,
        "category_avg_cost": category_cost,
        "item_avg_cost_div_by_category_avg_cost": F.try_divide(item_cost, category_cost),
    })


def features_with_item_stats(features: DataFrame, stats: DataFrame) -> DataFrame:
    """Inner join on the item on offer: customers whose item has no stats drop out."""
    on = F.lit(True)
    for k in ("category", "company", "brand"):  # the parts, as a text key may join different parts to the same text
        on = on & features[f"offer_{k}"].cast("string").eqNullSafe(stats[f"item_{k}"])
    return features.join(stats, on)
