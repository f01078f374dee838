"""Clusters of factor features and their calibrated repeat rates."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import smoothed, unit_hash
from ..session import materialise
from .order_stats import ranked, trimmed_mean

ALPHA, MU = 10.0, 0.30


def fit_assign(rows: DataFrame, k: int = 75, seed: int = 42, iterations: int = 50) -> DataFrame:
    """(id, cluster): nearest of k centroids fitted on the ``uv`` arrays of all rows."""
    data = materialise(rows.select("id", array_to_vector("uv").alias("features")), "kmeans")
    model = KMeans(k=k, seed=seed, maxIter=iterations).fit(data)
    return model.transform(data).select("id", F.col("prediction").alias("cluster"))


def calibrate(assigned: DataFrame, cluster: str = "cluster", label="repeater") -> DataFrame:
    """Per cluster: rows, repeats and (r + 10) / (n + 10 / 0.3)."""
    repeat = (F.col(label) == "t") if isinstance(label, str) else label
    return assigned.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("num_train"), F.count(F.when(repeat, 1)).alias("num_train_repeat"),
    ).withColumn("frac_repeater", smoothed("num_train_repeat", "num_train", ALPHA, MU))


def permuted(assigned: DataFrame) -> DataFrame:
    """Adds ``random_cluster``: the same cluster sizes, handed out in md5 order of the ids."""
    key = F.md5(F.col("id").cast("string"))
    shuffled = ranked(assigned.withColumn("_md5", key), [F.col("_md5"), F.col("id")]).drop("_md5", "total")
    ordered = ranked(assigned.select("id", "cluster"), [F.col("cluster"), F.col("id")]).select(
        "rank0", F.col("cluster").alias("random_cluster"))
    return shuffled.join(ordered, "rank0").drop("rank0")


def random_control(assigned: DataFrame) -> DataFrame:
    """The calibration with random labels (p = 0.3), and with permuted clusters."""
    labels = calibrate(assigned, label=unit_hash("id") < MU).select(F.lit("random_label").alias("control"), "*")
    clusters = calibrate(permuted(assigned), "random_cluster").withColumnRenamed(
        "random_cluster", "cluster").select(F.lit("permuted_cluster").alias("control"), "*")
    return labels.unionByName(clusters)


def with_error(stats: DataFrame) -> DataFrame:
    """Adds the plain repeat fraction and 1 / sqrt(N * fraction)."""
    frac = F.col("num_train_repeat") / F.col("num_train")
    return stats.withColumn("frac_repeat", frac).withColumn(
        "frac_err", F.try_divide(F.lit(1.0), F.sqrt(F.col("num_train") * F.col("frac_repeat"))))


def ordered(stats: DataFrame) -> DataFrame:
    return stats.orderBy("frac_repeater", "cluster")


def cluster_scores(assigned: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, score, actual): the fraction of the cluster as score."""
    return assigned.join(stats.select("cluster", "frac_repeater"), "cluster").select(
        "id", F.col("frac_repeater").alias("score"), (F.col("repeater") == "t").cast("int").alias("actual"))


def outputs(train: DataFrame, test: DataFrame, stats: DataFrame) -> DataFrame:
    """(part, id, cluster, frac_repeater, repeatProbability); the probability, in percent, for test rows."""
    both = train.select(F.lit("train").alias("part"), "id", "cluster").unionByName(
        test.select(F.lit("test").alias("part"), "id", "cluster"))
    # A cluster without train rows has the prior.
    rated = both.join(stats.select("cluster", "frac_repeater"), "cluster", "left").withColumn("frac_repeater", F.coalesce("frac_repeater", F.lit(MU)))
    return rated.select(
        "part", "id", "cluster", "frac_repeater",
        F.when(F.col("part") == "test", F.col("frac_repeater") * 100.0).alias("repeatProbability"))


def repeat_score_stats(scored: DataFrame, trim: float = 0.01, min_rows: int = 10) -> DataFrame:
    """By repeat trips: rows, trimmed mean score, scaled trips and the error sd / sqrt(N)."""
    plain = scored.groupBy("repeattrips").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("score").alias("score_sd")).where(F.col("n") > min_rows)
    mean = trimmed_mean(scored, ["repeattrips"], "score", trim, "score_mean")
    return plain.join(mean, "repeattrips").select(
        "repeattrips", "n", "score_mean",
        (F.log(2.0 + F.col("repeattrips")) / F.log(F.lit(2.0))).alias("scaled_trips"),
        (F.col("score_sd") / F.sqrt("n")).alias("score_mean_err"),
    )
