"""Readers for the delimited files of the job, and the catalog of their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas

# The file behind every catalog name.
CATALOG = {
    "offers": "offers.csv",
    "history": "trainHistory.csv",
    "history_test": "testHistory.csv",
    "sample_sub": "sampleSubmission.csv",
    "transactions": "transactions.csv",
    "leaderboard": "leaderboard_May12.csv",
    "reduced": "reduced.csv",
    "train_mf": "trainHistory_with_MF_features.csv",
    "frac": "reduced_MF_kmeans.csv",
}


def data_path(data_dir: str, name: str, split: int | None = None) -> str:
    file = CATALOG[name]
    if split is not None:
        file = file.replace(".csv", f"_{split}.csv")
    return f"{data_dir.rstrip('/')}/{file}"


def register(views: dict[str, DataFrame]) -> None:
    """Make every table of the catalog available to SQL under its name."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def row_counts(views: dict[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        for name, df in views.items()
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_parts(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """All numbered part files in one scan; header lines, where present, are skipped."""
    return spark.read.schema(schema).option("header", True).csv(pattern)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRIPLES).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PREDICTIONS).option("sep", " ").csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LABELS).csv(path)
