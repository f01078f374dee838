"""Feature importance and independence tests on the history columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The columns tested against the repeater label.
CHI_FEATURES = ("offer", "chain", "market", "repeattrips", "offerdate", "category", "company", "offervalue", "brand")
ENTROPY_FEATURES = ("chain", "company", "brand", "category", "repeattrips", "offervalue", "offerdate")
DEPENDENCE_COLUMNS = ("category", "brand", "company", "repeater", "market", "offervalue", "chain", "item")


def value_counts(frame: DataFrame, features: Sequence[str], positive: Column) -> DataFrame:
    """(feature, value, n, pos): rows and positives per value of each feature, in one pass.

    Rows are collapsed to distinct feature combinations before they are unpivoted.
    """
    features = list(features)
    combos = frame.groupBy(*features).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(positive, 1)).alias("pos"))
    texts = combos.select(*[F.col(c).cast("string").alias(c) for c in features], "n", "pos")
    return texts.unpivot(["n", "pos"], features, "feature", "value").groupBy("feature", "value").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def entropy_importance(frame: DataFrame, features: Sequence[str] = ENTROPY_FEATURES) -> DataFrame:
    """-sum P ln P with P = positives of the value / all rows, and the same per distinct value."""
    counts = value_counts(frame, features, F.col("repeater") == "t")
    total = frame.agg(F.count(F.lit(1))).scalar()
    p = counts.withColumn("p", F.col("pos") / total)
    term = F.when(F.col("p") > 0, -F.col("p") * F.log("p")).otherwise(0.0)
    return p.groupBy("feature").agg(
        F.sum(term).alias("entropy"), F.count(F.lit(1)).alias("n_values")
    ).withColumn("normalized", F.col("entropy") / F.col("n_values"))


def _expected(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows and positives per value with the expected positives and negatives."""
    positive = F.col("repeater") == "t"
    totals = frame.agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.count(F.when(positive, 1)).alias("pos"))).scalar()
    rate = F.col("_all.pos") / F.col("_all.n")
    return value_counts(frame, features, positive).withColumn("_all", totals).withColumns({
        "e_pos": F.col("n") * rate,
        "e_neg": F.col("n") * (1 - rate),
    }).drop("_all")


def chi_square(frame: DataFrame, features: Sequence[str] = CHI_FEATURES) -> DataFrame:
    rows = _expected(frame, features)
    part = (
        F.try_divide((F.col("pos") - F.col("e_pos")) ** 2, F.col("e_pos"))
        + F.try_divide((F.col("n") - F.col("pos") - F.col("e_neg")) ** 2, F.col("e_neg"))
    )
    return rows.groupBy("feature").agg(
        F.sum(part).alias("statistic"), (F.count(F.lit(1)) - 1).alias("df"))


def chi_residuals(frame: DataFrame, features: Sequence[str] = CHI_FEATURES) -> DataFrame:
    """Pearson residual of the positives of every value."""
    return _expected(frame, features).select(
        "feature", "value",
        F.try_divide(F.col("pos") - F.col("e_pos"), F.sqrt("e_pos")).alias("residual"))


def chi_asymptotic(frame: DataFrame, features: Sequence[str] = CHI_FEATURES) -> DataFrame:
    """(feature, p_value) of the asymptotic test: one row per feature, whatever the number of its values."""

    def tail(batches):
        for pdf in batches:
            pdf["p_value"] = [chi_tail(s, d) for s, d in zip(pdf["statistic"], pdf["df"])]
            yield pdf[["feature", "p_value"]]

    return chi_square(frame, features).mapInPandas(tail, "feature string, p_value double")


def chi_tail(statistic: float, df: int) -> float:
    """P(chi-square with ``df`` degrees > ``statistic``): the regularised upper incomplete gamma Q(df / 2, statistic / 2)."""
    if df <= 0 or not statistic > 0:
        return 1.0
    a, x = df / 2, statistic / 2
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # series of the lower part
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - scale * total)
    tiny = 1e-300  # continued fraction of the upper part
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h, step, i = d, 0.0, 0
    while abs(step - 1) > 1e-15:
        i += 1
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = d * c
        h *= step
    return scale * h


def _statistic(n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Chi-square of 2-column tables with row totals ``n`` and positives ``pos`` (tables x rows)."""
    total, positives = n.sum(), pos.sum(axis=1, keepdims=True)
    e_pos = n * positives / total
    e_neg = n - e_pos
    return ((pos - e_pos) ** 2 / e_pos + (pos - e_pos) ** 2 / e_neg).sum(axis=1)


def chi_simulated(
    frame: DataFrame, features: Sequence[str] = CHI_FEATURES, replicates: int = 2000, chunk: int = 250, seed: int = 7
) -> DataFrame:
    """(feature, p_simulated): tables with the observed margins, drawn without touching the rows.

    A label permutation gives a 2-column table with fixed margins, so it is enough to draw such
    tables from the contingency counts: one cell per offer, chain, date or other catalogue value.
    Chunks of replicates are independent tasks.
    """
    counts = value_counts(frame, features, F.col("repeater") == "t")
    tables = counts.groupBy("feature").agg(
        F.sort_array(F.collect_list(F.struct("value", "n", "pos"))).alias("cells")
    ).select("feature", F.col("cells.n").alias("n"), F.col("cells.pos").alias("pos"))
    chunks = -(-replicates // chunk)
    work = tables.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(
        "feature", "chunk")

    def draw(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                n, pos = np.asarray(row.n, dtype=np.int64), np.asarray(row.pos, dtype=np.int64)
                size = min(chunk, replicates - row.chunk * chunk)
                rng = np.random.default_rng([seed, row.chunk, sum(row.feature.encode())])
                if 0 < pos.sum() < n.sum():
                    drawn = rng.multivariate_hypergeometric(n, pos.sum(), size=size, method="marginals")
                    hits = int((_statistic(n, drawn) >= _statistic(n, pos[None, :])[0] * (1 - 1e-12)).sum())
                else:
                    hits = size
                out.append((row.feature, hits, size))
            yield pd.DataFrame(out, columns=["feature", "hits", "size"])

    return work.mapInPandas(draw, "feature string, hits long, size long").groupBy("feature").agg(
        ((F.sum("hits") + 1) / (F.sum("size") + 1)).alias("p_simulated"))


def chi_pvalue(frame: DataFrame, features: Sequence[str] = CHI_FEATURES, replicates: int = 2000) -> DataFrame:
    return chi_asymptotic(frame, features).join(chi_simulated(frame, features, replicates), "feature")


def dependence_pairs(frame: DataFrame, columns: Sequence[str] = DEPENDENCE_COLUMNS) -> DataFrame:
    """Mutual information of every pair of columns, from one table of distinct combinations."""
    columns = list(columns)
    combos = frame.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    pairs = [
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                 F.col(a).cast("string").alias("val_a"), F.col(b).cast("string").alias("val_b"))
        for a, b in combinations(columns, 2)
    ]
    cells = combos.select("n", F.explode(F.array(*pairs)).alias("p")).groupBy(
        "p.col_a", "p.col_b", "p.val_a", "p.val_b").agg(F.sum("n").alias("n"))
    pair = ["col_a", "col_b"]
    margins = cells.withColumns({
        "n_a": F.sum("n").over(Window.partitionBy(*pair, "val_a")),
        "n_b": F.sum("n").over(Window.partitionBy(*pair, "val_b")),
        "n_all": combos.agg(F.sum("n")).scalar(),
    })
    information = (F.col("n") / F.col("n_all")) * F.log(
        F.col("n").cast("double") * F.col("n_all") / (F.col("n_a").cast("double") * F.col("n_b")))
    return margins.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum(information).alias("mutual_information"))
