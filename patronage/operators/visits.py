"""Gaps between shopping trips, ordered splits and balanced samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import parsed_date
from .order_stats import ranked

LONG_GAP = 33


def valid_dates(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose date text is a 10-character date, with it parsed."""
    return rows.withColumn(column, parsed_date(column)).where(F.col(column).isNotNull())


def date_audit(rows: DataFrame, column: str) -> DataFrame:
    """Rows with a good date, and the number of distinct bad texts."""
    good = parsed_date(column).isNotNull()
    # One row per distinct text first: the calendar bounds the good ones.
    texts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return texts.agg(
        F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0)).alias("n_valid"),
        F.count(F.when(~good, 1)).alias("n_bad_dates"),
    )


def trip_gaps(transactions: DataFrame, long_gap: int = LONG_GAP) -> DataFrame:
    """Gap statistics per customer over distinct dates; customers with fewer than two gaps drop out.

    The window sees one row per (customer, date), so the calendar bounds it.
    """
    trips = transactions.where(F.col("date").isNotNull()).select("id", "date").distinct()
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy("id").orderBy("date")))
    gaps = trips.withColumn("gap", gap)
    return gaps.groupBy("id").agg(
        F.avg("gap").alias("mean_gap"),
        F.stddev_pop("gap").alias("sd_gap"),
        F.min("gap").alias("min_gap"),
        F.max("gap").alias("max_gap"),
        F.count(F.lit(1)).alias("n_trips"),
        F.count(F.when(F.col("gap") > long_gap, 1)).alias("n_long_gaps"),
        F.count("gap").alias("_n_gaps"),
    ).where("_n_gaps > 1").drop("_n_gaps").withColumn("long_ratio", F.col("n_long_gaps") / F.col("n_trips"))


def time_ordered_split(frame: DataFrame, fraction: float = 0.67) -> DataFrame:
    """``part`` = train for the first floor(n * fraction) rows by (offerdate, id), else cv."""
    rows = ranked(frame, [F.col("offerdate"), F.col("id")])
    cut = F.floor(F.col("total") * F.lit(fraction))
    return rows.withColumn("part", F.when(F.col("rank0") < cut, "train").otherwise("cv")).drop("rank0", "total")


def balanced(frame: DataFrame, label: str = "repeater") -> DataFrame:
    """The same number of rows of each class, chosen and ordered by the md5 of the id.

    ``shuffle_key`` gives the shuffled order of the result.
    """
    key = F.md5(F.col("id").cast("string"))
    rows = ranked(frame.withColumn("shuffle_key", key), [F.col("shuffle_key"), F.col("id")], keys=[label])
    sizes = frame.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    smallest = sizes.agg(F.min("n")).scalar()
    return rows.where(F.col("rank0") < smallest).drop("rank0", "total")
