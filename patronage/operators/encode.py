"""Model frames and feature encoding."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import MinMaxScaler, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_number, hash_digits, joined, label_of
from .joins import history_with_offers

# The six categorical and the continuous columns of the model frame.
CATEGORICAL = ("chain", "offer", "market", "category", "company", "brand")
CONTINUOUS = ("productsize", "purchasequantity", "purchaseamount", "offervalue")
CODED = len(CATEGORICAL) + len(CONTINUOUS)  # columns of a coded row, see ``trees.coded``


def model_frame(history: DataFrame, offers: DataFrame, sums: DataFrame) -> DataFrame:
    """History with offers and the customer's sums in the offered category, cleaned.

    ``offervalue`` moves last; the label is 1 / 0 where the history has one. Ordering by offer date
    is left to ``time_ordered_split``: a global sort before a join or a fit has no effect.
    """
    rows = history_with_offers(history, offers).join(sums, ["id", "category"], "left")
    rows = rows.withColumns({c: clean_number(c) for c in CONTINUOUS})
    label = [label_of("repeater").alias("label")] if "repeater" in history.columns else []
    return rows.select("id", "offerdate", *label, *CATEGORICAL, *CONTINUOUS)


def sorted_frame(frame: DataFrame, drop: Sequence[str] = ("offerdate",)) -> DataFrame:
    """Columns reordered (offervalue last), rows in order of offer date, ``drop`` removed."""
    keep = [c for c in frame.columns if c not in (*drop, "offervalue")]
    return frame.orderBy("offerdate", "id").select(*keep, "offervalue")


def minmax_scale(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns scaled to [0, 1]; a constant column becomes 0."""
    limits = frame.agg(F.struct(*[
        f(c).cast("double").alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))
    ])).scalar()
    out = frame.withColumn("_limits", limits)
    return out.withColumns({
        c: F.coalesce(
            F.try_divide(F.col(c) - F.col(f"_limits.lo_{c}"), F.col(f"_limits.hi_{c}") - F.col(f"_limits.lo_{c}")),
            F.when(F.col(c).isNotNull(), 0.0))
        for c in columns
    }).drop("_limits")


def one_hot(columns: Sequence[str]) -> list:
    """Indexer and encoder stages; a value unseen in the fit gets the dropped slot, i.e. all zeros."""
    return [
        StringIndexer(inputCols=list(columns), outputCols=[f"{c}_idx" for c in columns], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"{c}_idx" for c in columns], outputCols=[f"{c}_hot" for c in columns],
                      dropLast=True),
    ]


_VECTOR = "v struct<size int, indices array<int>, values array<double>>"


def vector_entries(vector: str) -> Column:
    """``size, entries`` of a vector, the (index, value) pairs in order that are not 0: what is off takes no room, however many slots there are."""
    v = F.from_json(F.to_json(F.struct(F.col(vector).alias("v"))), _VECTOR)["v"]
    pair = lambda i, x: F.struct(i.cast("int").alias("index"), x.alias("value"))
    pairs = F.when(v["indices"].isNull(), F.transform(v["values"], lambda x, i: pair(i, x))).otherwise(F.zip_with(v["indices"], v["values"], pair))
    return F.struct(F.coalesce(v["size"], F.size(v["values"])).alias("size"), F.filter(pairs, lambda e: e["value"] != 0).alias("entries"))


def interactions(frame: DataFrame, columns: Sequence[str] = CATEGORICAL, degree: int = 2) -> DataFrame:
    """One hash per combination of ``degree`` categorical columns, as ``a_x_b``."""
    return frame.withColumns({
        "_x_".join(c): hash_digits(joined(*c)) for c in combinations(columns, degree)
    })


def interaction_columns(columns: Sequence[str] = CATEGORICAL, degree: int = 2) -> list[str]:
    return ["_x_".join(c) for c in combinations(columns, degree)]


def encoder(categorical: Sequence[str] = CATEGORICAL, continuous: Sequence[str] = CONTINUOUS) -> Pipeline:
    """One-hot categories next to scaled continuous columns, as ``features``."""
    return Pipeline(stages=[
        *one_hot(categorical),
        VectorAssembler(inputCols=list(continuous), outputCol="_continuous"),
        MinMaxScaler(inputCol="_continuous", outputCol="_scaled"),
        VectorAssembler(inputCols=[*[f"{c}_hot" for c in categorical], "_scaled"], outputCol="features"),
    ])


def feature_names(model: PipelineModel, categorical: Sequence[str] = CATEGORICAL,
                  continuous: Sequence[str] = CONTINUOUS) -> list[str]:
    """Names of the slots of ``features``, in order."""
    indexer = model.stages[0]
    names = [f"{c}={v}" for c, values in zip(categorical, indexer.labelsArray) for v in values]
    return [*names, *continuous]
