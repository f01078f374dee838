"""Smoothed repeat rates: hierarchical shrinkage and the item classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import item_ccb, smoothed

HIERARCHY = ("offer", "chain", "market", "offerdate")


def _leaves(history: DataFrame, hierarchy: Sequence[str]) -> DataFrame:
    good = history.na.drop(subset=list(hierarchy))
    return good.groupBy(*hierarchy).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("repeater") == "t", 1)).alias("pos"))


def rollup(history: DataFrame, hierarchy: Sequence[str] = HIERARCHY) -> DataFrame:
    """Counts and positives at every level; ``depth`` 0 is the root.

    The rollup expands the leaves, not the rows.
    """
    hierarchy = list(hierarchy)
    rolled = _leaves(history, hierarchy).rollup(*hierarchy).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.grouping_id().alias("_g"))
    # grouping_id has one trailing 1-bit per rolled-up level.
    depth = F.lit(len(hierarchy)) - F.bit_count("_g")
    return rolled.select(depth.cast("int").alias("depth"), *hierarchy, "n", "pos")


def bad_rows(history: DataFrame, hierarchy: Sequence[str] = HIERARCHY) -> DataFrame:
    bad = F.lit(False)
    for c in hierarchy:
        bad = bad | F.col(c).isNull()
    return history.agg(F.count(F.when(bad, 1)).alias("n_bad"))


def shrink(
    history: DataFrame, hierarchy: Sequence[str] = HIERARCHY, alpha: float = 10.0, prior: float = 0.3
) -> DataFrame:
    """p = (pos + alpha) / (n + alpha / p of the parent), from the root down.

    Each level is re-aggregated from the one below, and joined to its parents by path.
    """
    hierarchy = list(hierarchy)
    levels = [_leaves(history, hierarchy)]
    for depth in range(len(hierarchy) - 1, -1, -1):
        levels.append(levels[-1].groupBy(*hierarchy[:depth]).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")))
    levels.reverse()

    nodes = levels[0].withColumn("p", smoothed("pos", "n", alpha, prior))
    out = [nodes]
    for depth in range(1, len(levels)):
        path = hierarchy[: depth - 1]
        level = levels[depth]
        if path:
            level = level.join(nodes.select(*path, F.col("p").alias("p_parent")), path)
        else:
            level = level.withColumn("p_parent", nodes.select("p").scalar())
        nodes = level.withColumn(
            "p", (F.col("pos") + alpha) / (F.col("n") + alpha / F.col("p_parent"))).drop("p_parent")
        out.append(nodes)
    result = None
    for depth, nodes in enumerate(out):
        missing = {c: F.lit(None).cast(history.schema[c].dataType) for c in hierarchy[depth:]}
        rows = nodes.withColumns(missing) if missing else nodes
        rows = rows.select(
            F.lit(depth).alias("depth"), *hierarchy, "n", "pos",
            F.try_divide(F.col("pos"), F.col("n")).alias("p_raw"), "p")
        result = rows if result is None else result.unionByName(rows)
    return result


def item_probabilities(history_offers: DataFrame, alpha: float = 5.0, prior_ratio: float = 3.0) -> DataFrame:
    """Smoothed P(repeat | item) for every item in the train history."""
    counts = history_offers.withColumn("item", item_ccb()).groupBy("item").agg(
        F.count(F.when(F.col("repeater") == "t", 1)).alias("n_repeat"),
        F.count(F.when(F.col("repeater") != "t", 1)).alias("n_norepeat"),
    )
    return _posterior(counts, counts, alpha, prior_ratio)


def _posterior(rows: DataFrame, counts: DataFrame, alpha: float, prior_ratio: float) -> DataFrame:
    """``p_repeat`` for rows with n_repeat / n_norepeat, given the totals of ``counts``."""
    totals = counts.agg(
        F.struct(
            F.sum("n_repeat").alias("repeat"),
            F.sum("n_norepeat").alias("norepeat"),
            F.count(F.lit(1)).alias("items"),
        )
    ).scalar()
    rows = rows.withColumn("_t", totals)
    p_repeat = (F.col("n_repeat") + alpha) / (F.col("_t.repeat") + alpha * F.col("_t.items"))
    p_norepeat = (F.col("n_norepeat") + alpha) / (F.col("_t.norepeat") + alpha * F.col("_t.items"))
    return rows.withColumn("p_repeat", 1.0 / (1.0 + p_norepeat / p_repeat * prior_ratio)).drop("_t")


def score_items(
    customers: DataFrame, history_offers: DataFrame, alpha: float = 5.0, prior_ratio: float = 3.0
) -> DataFrame:
    """``p_repeat`` of the item on offer for each customer; an unseen item has the prior counts only."""
    counts = item_probabilities(history_offers, alpha, prior_ratio).drop("p_repeat")
    rows = customers.withColumn("item", item_ccb()).join(counts, "item", "left").na.fill(
        0, ["n_repeat", "n_norepeat"])
    return _posterior(rows, counts, alpha, prior_ratio).drop("n_repeat", "n_norepeat")
