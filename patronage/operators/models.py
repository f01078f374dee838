"""Repeat-buyer models: fit and score as Spark ML jobs."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .encode import encoder, feature_names
from .evaluate import binary_auc
from .order_stats import ranked
from .visits import time_ordered_split

# Regularisation strengths, 15 points from 2^-4 to 2^4, evenly spaced in the exponent.
C_GRID = tuple(2.0 ** (-4 + 8 * i / 14) for i in range(15))
FITS = 8  # at a time: a fit is many short jobs


def classifiers() -> dict[str, Estimator]:
    return {
        "logistic": LogisticRegression(maxIter=50),
        "gaussian_nb": NaiveBayes(modelType="gaussian"),
    }


def logistic(c: float, n: int, max_iter: int = 50) -> LogisticRegression:
    """A strength ``c`` weighs the summed loss of ``n`` rows; regParam weighs the penalty against the mean loss."""
    return LogisticRegression(maxIter=max_iter, standardization=False, regParam=1.0 / (c * max(1, n)))


def encoded(train: DataFrame, *others: DataFrame) -> tuple[list[DataFrame], list[str]]:
    """Frames with a ``features`` vector from one encoder fitted on train, written once for the fits."""
    train = materialise(train, "frame")
    model = encoder().fit(train)
    # Without the names of all slots, which would travel with every task of a fit.
    keep = {"id": "id", "offerdate": "offerdate", "label": "label", "features": F.col("features").alias("features", metadata={})}
    frames = []
    for frame in (train, *others):
        out = model.transform(frame)
        frames.append(materialise(out.select(*[c for name, c in keep.items() if name in out.columns]), "encoded"))
    return frames, feature_names(model)


def scores(model: Model, frame: DataFrame, *keep: str) -> DataFrame:
    """(id, score) and the columns to keep: probability of a repeat, or the margin for models without one."""
    out = model.transform(frame)
    column = "probability" if "probability" in out.columns else "rawPrediction"
    return out.select("id", vector_to_array(column)[1].alias("score"), *keep)


def fit_and_score(estimator: Estimator, train: DataFrame, test: DataFrame) -> DataFrame:
    return scores(estimator.fit(train), test)


def coefficients(model: Model, names: Sequence[str], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(n, float(v)) for n, v in zip(names, model.coefficients.toArray())], "feature string, weight double")


def extreme_weights(weights: DataFrame, n: int = 100) -> DataFrame:
    """The n largest and n smallest weights (a top-k report)."""
    top = weights.orderBy(F.desc("weight"), "feature").limit(n).withColumn("side", F.lit("top"))
    bottom = weights.orderBy(F.asc("weight"), "feature").limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def cross_validate(
    estimator: Estimator, frame: DataFrame, loops: int = 5, fraction: float = 0.67, spread: float = 0.25, seed: int = 42, parallelism: int = FITS
) -> tuple[float, float]:
    """Mean and population deviation of the AUC of binary predictions over time-ordered splits, some of them fitted at a time."""
    rng = np.random.default_rng(seed)
    ordered = materialise(ranked(frame, [F.col("offerdate"), F.col("id")]).select("label", "features", "rank0", "total"), "split")
    parts = [fraction + (rng.random() * spread if loops > 1 else 0.0) for _ in range(loops)]

    def one(part: float) -> float | None:
        in_train = F.col("rank0") < F.floor(F.col("total") * F.lit(part))
        model = estimator.fit(ordered.where(in_train).select("label", "features"))
        predicted = model.transform(ordered.where(~in_train).select("label", "features"))
        return binary_auc(predicted.select("prediction", F.col("label").alias("actual"))).first()["auc"]

    with ThreadPool(max(1, min(parallelism, loops))) as pool:
        aucs = pool.map(inheritable_thread_target(frame.sparkSession)(one), parts)
    aucs = [0.5 if a is None else a for a in aucs]
    return float(np.mean(aucs)), float(np.std(aucs))


def cv_auc(estimator: Estimator, frame: DataFrame, loops: int = 5, seed: int = 42) -> DataFrame:
    mean, sd = cross_validate(estimator, frame, loops, seed=seed)
    return frame.sparkSession.createDataFrame([(loops, mean, sd)], "loops int, mean_auc double, sd_auc double")


def grid_search_c(
    frame: DataFrame, grid: Sequence[float] = C_GRID, fraction: float = 0.67, max_iter: int = 50, parallelism: int = FITS
) -> DataFrame:
    """(c, mean_auc, best): AUC per strength on one time-ordered split; ties go to the larger C."""
    split = materialise(time_ordered_split(frame, fraction).select("label", "features", "part"), "split")
    train, cv = split.where("part = 'train'"), split.where("part = 'cv'")
    n = train.count()
    estimator = LogisticRegression(maxIter=max_iter, standardization=False)
    params = [{estimator.regParam: logistic(c, n).getRegParam()} for c in grid]
    models = estimator.fitMultiple(train, params)

    def one(_) -> tuple[float, float]:
        index, model = next(models)
        auc = binary_auc(model.transform(cv).select("prediction", F.col("label").alias("actual"))).first()["auc"]
        return (0.5 if auc is None else auc), grid[index]

    with ThreadPool(min(parallelism, len(params))) as pool:
        found = sorted(pool.map(inheritable_thread_target(frame.sparkSession)(one), params), key=lambda f: f[1])
    best = max(found)
    return frame.sparkSession.createDataFrame(
        [(c, auc, (auc, c) == best) for auc, c in found], "c double, mean_auc double, best boolean")


def _pinball_pass(frame: DataFrame, weights: np.ndarray, tau: float) -> tuple[float, np.ndarray]:
    """Mean pinball loss and subgradient at ``weights``: one distributed sum for each sign of the residual."""
    fitted = F.aggregate(F.zip_with("x", F.lit([float(w) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    rows = frame.select((F.col("label") - fitted).alias("residual"), "v")
    sums = rows.groupBy((F.col("residual") > 0).alias("above")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("residual").alias("residual"), Summarizer.sum(F.col("v")).alias("v")).collect()  # two rows
    n = sum(r["n"] for r in sums)
    slope = {True: -tau, False: 1 - tau}
    return (sum(-slope[r["above"]] * r["residual"] for r in sums) / n,
            sum(slope[r["above"]] * r["v"].toArray() for r in sums) / n)


def quantile_linear(
    train: DataFrame, test: DataFrame, columns: Sequence[str], tau: float = 0.6, passes: int = 45, rate: float = 0.85
) -> tuple[DataFrame, dict[str, float]]:
    """Linear model under quantile loss, by full-batch subgradient passes; (id, score) and losses.

    Starts at the best constant and keeps the best pass, so it never ends above the constant model.
    """
    columns = list(columns)
    limits = train.agg(*[F.max(F.abs(F.coalesce(c, F.lit(0)))).cast("double").alias(c) for c in columns]).first()
    x = F.array(F.lit(1.0), *[
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / F.lit(float(limits[c] or 1.0)) for c in columns])
    data = materialise(train.select("id", "label", x.alias("x"), array_to_vector(x).alias("v")), "quantile-train")
    start = data.agg(F.percentile("label", tau)).first()[0]
    weights = np.zeros(len(columns) + 1)
    weights[0] = start
    best_loss, best = np.inf, weights
    constant = None
    for t in range(1, passes + 1):
        loss, gradient = _pinball_pass(data, weights, tau)
        constant = loss if constant is None else constant
        if loss < best_loss:
            best_loss, best = loss, weights
        weights = weights - rate / np.sqrt(t) * gradient
    fitted = F.aggregate(
        F.zip_with(x, F.array(*[F.lit(float(w)) for w in best]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return test.select("id", fitted.alias("score")), {"loss": float(best_loss), "constant_loss": float(constant)}
