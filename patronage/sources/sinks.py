"""Writers for the files of the job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import hash_digits, is_early


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def with_shard(rows: DataFrame, ngroups: int = 100) -> DataFrame:
    """All rows of a customer get the same ``bucket``."""
    return rows.withColumn("bucket", F.pmod(hash_digits("id"), F.lit(ngroups)).cast("int"))


def write_shards(rows: DataFrame, path: str, ngroups: int = 100) -> None:
    """One folder per shard. Rebalancing splits a shard that a hot customer makes too large into files."""
    with_shard(rows, ngroups).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)


def feature_text(name: str, dtype: T.DataType) -> Column:
    """``name:value``, NULL for an absent value; text values lose the characters the format reserves."""
    column = F.col(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        value = F.format_string("%.6f", column.cast("double"))
    elif isinstance(dtype, T.StringType):
        value = F.regexp_replace(column, "[ :|]", "_")
    else:
        value = column.cast("string")
    return F.when(column.isNotNull(), F.concat(F.lit(f"{name}:"), value))


NOT_EXPORTED = ("item_id", "offer_item_id", "offer_date")


def sparse_lines(features: DataFrame, ignore: Sequence[str] = NOT_EXPORTED) -> DataFrame:
    """(id, line): ``label 'id |f name:value ...`` with features in name order."""
    skip = {"label", "id", *ignore}
    fields = sorted((f for f in features.schema if f.name not in skip), key=lambda f: f.name)
    label = F.when(F.col("label") == F.lit(0.5), "0.5").otherwise(F.col("label").cast("int").cast("string"))
    head = F.concat(label, F.lit(" '"), F.col("id").cast("string"), F.lit(" |f"))
    line = F.concat_ws(" ", head, *[feature_text(f.name, f.dataType) for f in fields])
    return features.select("id", line.alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.text(path)


def labels_of_lines(lines: DataFrame) -> DataFrame:
    """(id, label) out of exported lines; the id stands behind a quote."""
    parts = F.split("line", " ")
    return lines.select(
        F.substr(parts[1], F.lit(2)).cast("bigint").alias("id"), parts[0].cast("double").alias("label"))


def with_route(features: DataFrame, cutoff: str) -> DataFrame:
    """``split``: test, or early / late train by the offer date."""
    return features.withColumn(
        "split",
        F.when(F.col("label") == F.lit(0.5), "test")
        .when(is_early("offer_date", cutoff), "train_early")
        .otherwise("train_late"),
    )


def write_routed(features: DataFrame, path: str, cutoff: str) -> None:
    with_route(features, cutoff).write.partitionBy("split").parquet(path)


def submission(scores: DataFrame, column: str = "score") -> DataFrame:
    return scores.select("id", F.col(column).alias("repeatProbability"))


def save_factors(model: ALSModel, users: DataFrame, items: DataFrame, path: str) -> None:
    model.write().save(f"{path}/model")
    users.write.parquet(f"{path}/users")
    items.write.parquet(f"{path}/items")


def load_factors(spark, path: str) -> tuple[ALSModel, DataFrame, DataFrame]:
    return ALSModel.load(f"{path}/model"), spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/items")
