"""Ranks, running totals and order statistics that never put a whole group in one task.

Rows are first collapsed to (group, value) counts where that is possible. They are then dealt into range
partitions by group and value and written once with the number of their partition. A group that holds a
third of all rows is spread over many partitions; only its totals, one per partition, are ordered in one
place, and the running totals inside a partition start from them. Only the first and last group of a partition can go on in
another one, so totals are made for those alone. NULL is a key and a value like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of ``keys`` on both sides."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def join_on(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe join that keeps the keys of ``a``; ``b`` gives its other columns."""
    right = b.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    return a.join(right, on, how).drop(*[f"_same_{k}" for k in keys])


def spread(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` with ``_bucket``, the number of its range partition by ``order``.

    The ranges come from a sample, so they are fixed by writing the rows once: what reads them twice, or again after
    an executor is lost, sees the same ranges.
    """
    return materialise(df.repartitionByRange(*order).withColumn("_bucket", F.spark_partition_id()), "ordered")


def running_totals(runs: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """Add ``before_<c>`` (total of earlier rows) and ``all_<c>`` (group total) for each c in sums.

    ``runs`` comes from ``spread`` by keys and ``order``.
    """
    few = runs if not keys else join_on(runs, materialise(_edges(runs, keys), "edges"), keys, "left_semi")
    totals = few.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(totals.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in sums],
        *[F.sum(f"_t_{c}").over(group).alias(f"_all_{c}") for c in sums],
    ), "offsets")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys, "_bucket")
    out = join_on(runs, offsets, [*keys, "_bucket"], "left")
    for c in sums:
        out = out.withColumns({
            f"before_{c}": F.coalesce(F.col(f"_off_{c}"), F.lit(0)) + F.coalesce(F.sum(c).over(inside), F.lit(0)),
            f"all_{c}": F.coalesce(F.col(f"_all_{c}"), F.sum(c).over(whole)) if keys else F.col(f"_all_{c}"),
        })
    return out.drop("_bucket", *[f"_{kind}_{c}" for c in sums for kind in ("off", "all")])


def _edges(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first and the last group of each range partition: no other group can reach into a second one."""
    ends = runs.groupBy("_bucket").agg(F.min(F.struct(*keys)).alias("first"), F.max(F.struct(*keys)).alias("last"))
    return ends.select(F.explode(F.array("first", "last")).alias("e")).select("e.*").distinct()


def ranked(
    df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), rank: str = "rank0", total: str = "total",
) -> DataFrame:
    """0-based rank of every row in its group, and the group size."""
    rows = spread(df.withColumn("_one", F.lit(1).cast("bigint")), [*keys, *order])
    out = running_totals(rows, keys, order, ["_one"])
    return out.withColumnsRenamed({"before__one": rank, "all__one": total}).drop("_one")


def value_runs(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group with ``n`` rows."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def distribution(runs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``value_runs`` rows with ``before_n`` smaller rows and ``all_n`` rows of the group."""
    return running_totals(spread(runs, [*keys, value]), keys, [F.col(value)], ["n"])


def _holds(rank: Column) -> Column:
    return ((F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n"))).cast("int")


def median_of(value: str) -> Column:
    """Aggregate over ``distribution`` rows: the mean of the two middle values."""
    low = F.floor((F.col("all_n") - 1) / 2)
    high = F.ceil((F.col("all_n") - 1) / 2)
    middle = _holds(low) + _holds(high)
    return F.sum(F.when(middle > 0, F.col(value).cast("double") * middle)) / 2


def trimmed_mean_of(value: str, trim: float) -> Column:
    """Aggregate over ``distribution`` rows: mean after dropping floor(n * trim) rows at each end."""
    cut = F.floor(F.col("all_n") * F.lit(trim))
    end = F.col("before_n") + F.col("n")
    kept = F.greatest(
        F.lit(0).cast("bigint"), F.least(end, F.col("all_n") - cut) - F.greatest(F.col("before_n"), cut))
    return F.sum(F.when(kept > 0, F.col(value).cast("double") * kept)) / F.sum(kept)


def trimmed_mean(df: DataFrame, keys: Sequence[str], value: str, trim: float, alias: str) -> DataFrame:
    return distribution(value_runs(df, keys, value), keys, value).groupBy(*keys).agg(
        trimmed_mean_of(value, trim).alias(alias))


def combinations_of(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Distinct combinations of keys and values with ``n`` rows."""
    return df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).groupBy(*keys, *values).agg(
        F.count(F.lit(1)).alias("n"))


def grouped_medians(runs: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Row count ``n_rows`` and exact medians ``med_<value>`` per group of rows weighted by ``n``.

    One row per (group, measure, value) is ordered; the row counts go along as one more measure that has a single value.
    """
    keys, values = list(keys), list(values)
    counted = runs.withColumn("_rows", F.lit(0.0))
    cells = (
        counted.unpivot([*keys, "n"], [*values, "_rows"], "_measure", "_value").where(F.col("_value").isNotNull())
        .groupBy(*keys, "_measure", "_value").agg(F.sum("n").alias("n"))
    )
    medians = distribution(cells, [*keys, "_measure"], "_value").groupBy(*keys, "_measure").agg(
        median_of("_value").alias("m"), F.max("all_n").alias("all_n"))
    return medians.groupBy(*keys).agg(
        F.max(F.when(F.col("_measure") == "_rows", F.col("all_n"))).alias("n_rows"),
        *[F.max(F.when(F.col("_measure") == v, F.col("m"))).alias(f"med_{v}") for v in values])


def whole_groups(
    rows: DataFrame, key: str, work: Callable[[pa.Table], pa.Table], rest: Callable[[pa.Table], pa.Table], schema: str, chunk: int = 200_000
) -> DataFrame:
    """``rows`` in range partitions by all columns, ``key`` first: ``work`` of the groups that lie inside a partition, ``rest`` of all other rows.

    Only the first and the last group of a partition can go on in another one, so a group that ``work`` gets, always with
    others and in order of ``key``, is whole and no larger than a partition; hot groups span partitions and are among the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, n = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            first = ids[0] if first is None else first
            start = int(np.searchsorted(ids, first, "right"))
            if start:
                yield from rest(pa.Table.from_batches([batch.slice(0, start)])).to_batches()
            if start < len(ids):
                held.append(batch.slice(start))
                n += len(ids) - start
            if n >= chunk and held[0].column(0)[0].as_py() != ids[-1]:
                table = pa.Table.from_batches(held)
                end = int(np.searchsorted(table.column(0).to_numpy(), ids[-1]))
                yield from work(table.slice(0, end)).to_batches()
                held, n = table.slice(end).to_batches(), table.num_rows - end
        if held:
            table = pa.Table.from_batches(held)
            ids = table.column(0).to_numpy()
            end = int(np.searchsorted(ids, ids[-1]))
            if end:
                yield from work(table.slice(0, end)).to_batches()
            yield from rest(table.slice(end)).to_batches()

    rows = rows.select(key, *[c for c in rows.columns if c != key])
    return rows.repartitionByRange(*rows.columns).sortWithinPartitions(key).mapInArrow(run, schema)


def weighted_medians(group: np.ndarray, value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups and the mean of the two middle values of each, every value ``n`` times."""
    order = np.lexsort((value, group))
    group, value, upto = group[order], value[order] + 0.0, np.cumsum(n[order])
    first = np.flatnonzero(np.diff(group, prepend=-1))
    before = upto[first] - n[order][first]
    total = np.append(before[1:], upto[-1:]) - before
    low, high = (value[np.searchsorted(upto, before + rank, "right")] for rank in ((total - 1) // 2, total // 2))
    return group[first], np.where(low == high, low, (low + high) / 2)
