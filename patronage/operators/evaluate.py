"""ROC, AUROC and thresholded comparison of observed and modelled pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dot
from ..session import materialise
from .order_stats import ranked, running_totals, spread

EPSILON = 1e-11
GROUP_BLOCKS = 8  # so many blocks of either side are sent to a task together
CELL_IDS = 2048  # ids of a side in a cell of observed pairs
PLANES, PLANE_SEED = 30, 5  # most planes whose sides tell the vectors of a block from others


def score_counts(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score: tied scores become one point."""
    return scored.groupBy(*keys, "score").agg(
        F.sum("actual").cast("bigint").alias("pos"),
        F.sum(1 - F.col("actual")).cast("bigint").alias("neg"),
    )


def cumulative(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct score, highest first: tp and fp up to and including it, and the class totals."""
    return _cumulated(score_counts(scored, keys), keys)


def _cumulated(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    order = [F.col("score").desc()]
    out = running_totals(spread(counts, [*keys, *order]), keys, order, ["pos", "neg"])
    return out.withColumns({
        "tp": F.col("before_pos") + F.col("pos"),
        "fp": F.col("before_neg") + F.col("neg"),
    })


def roc_curve(scored: DataFrame) -> DataFrame:
    """One point per distinct score of (score, actual 0/1)."""
    tp, fp = F.col("tp"), F.col("fp")
    precision = tp / (tp + fp)
    recall = F.try_divide(tp, F.col("all_pos"))
    return cumulative(scored).select(
        "score", "tp", "fp",
        recall.alias("tpr"),
        F.try_divide(fp, F.col("all_neg")).alias("fpr"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.try_divide(2 * precision * recall, precision + recall).alias("f_score"),
    )


def auroc(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area from (0,0) to (1,1); each distinct score adds neg * (tp before + pos / 2)."""
    points = cumulative(scored, keys)
    area = F.sum(F.col("neg") * (F.col("before_pos") + F.col("pos") / 2.0))
    return points.groupBy(*keys).agg(
        F.try_divide(area, F.max("all_pos").cast("double") * F.max("all_neg")).alias("auroc"))


def auc_bootstrap(scored: DataFrame, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(replicate, auc): mean(score of a positive > score of a negative) in resamples with replacement.

    Resamples are drawn as counts per score, not as rows: each count becomes a Poisson count of the same mean. A range
    partition of the scores sums its wins, positives and negatives for all replicates; one row per partition leaves it.
    """
    counts = spread(score_counts(scored), [F.col("score").desc()])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, rng, sums = None, None, None
        for pdf in batches:
            for number, rows in pdf.groupby("_bucket", sort=False):
                if number != bucket:
                    if bucket is not None:
                        yield _drawn(bucket, sums)
                    bucket, rng, sums = number, np.random.default_rng([seed, int(number)]), np.zeros((3, replicates))
                for low in range(0, len(rows), 512):
                    part = rows.iloc[low:low + 512]
                    pos = rng.poisson(part["pos"].to_numpy()[:, None], (len(part), replicates))
                    neg = rng.poisson(part["neg"].to_numpy()[:, None], (len(part), replicates))
                    before = sums[0] + np.cumsum(pos, axis=0) - pos
                    sums += [pos.sum(axis=0), neg.sum(axis=0), (neg * before).sum(axis=0)]
        if bucket is not None:
            yield _drawn(bucket, sums)

    ordered = counts.repartition("_bucket").sortWithinPartitions("_bucket", F.col("score").desc())
    drawn = ordered.mapInPandas(draw, "bucket int, pos array<double>, neg array<double>, wins array<double>")
    rows = drawn.select("bucket", F.posexplode(F.arrays_zip("pos", "neg", "wins")).alias("replicate", "s")).select("bucket", "replicate", "s.*")
    earlier = Window.partitionBy("replicate").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("wins", F.col("wins") + F.col("neg") * F.coalesce(F.sum("pos").over(earlier), F.lit(0.0)))
    return rows.groupBy("replicate").agg(F.try_divide(F.sum("wins"), F.sum("pos") * F.sum("neg")).alias("auc"))


def _drawn(bucket: int, sums: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"bucket": [bucket], "pos": [sums[0]], "neg": [sums[1]], "wins": [sums[2]]})


def win_rate(scored: DataFrame) -> DataFrame:
    """``win_rate``: share of (positive, negative) pairs with the higher score on the positive; ties are no wins."""
    points = cumulative(scored)
    return points.agg(F.try_divide(
        F.sum(F.col("neg") * F.col("before_pos").cast("double")), F.max("all_pos").cast("double") * F.max("all_neg")).alias("win_rate"))


def binary_auc(predicted: DataFrame) -> DataFrame:
    """AUC of 0/1 predictions: (TPR + TNR) / 2, from (prediction, actual)."""
    hit = lambda p, a: F.count(F.when((F.col("prediction") == p) & (F.col("actual") == a), 1))
    return predicted.agg(hit(1, 1).alias("tp"), hit(0, 0).alias("tn"),
                         hit(1, 0).alias("fp"), hit(0, 1).alias("fn")).select(
        ((F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
          + F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))) / 2).alias("auc"))


def _blocks(factors: DataFrame, block_rows: int) -> DataFrame:
    """Vectors packed into bounded blocks of near ones: ``block, values, n, centre, radius, norm``, written once.

    Vectors that lie on the same sides of random planes, about as many as halve the table into blocks, are packed in order of their norm,
    so a cluster is in blocks of its own. A ball around the centre holds all vectors of a block; ``norm`` is the largest length.
    """
    dim = _dimension(factors)
    cells = max(1.0, factors.count() / block_rows)
    planes = np.random.default_rng(PLANE_SEED).normal(size=(min(PLANES, int(np.ceil(np.log2(cells))) + 2), dim))
    side = [F.when(dot("features", F.array(*[F.lit(float(x)) for x in plane])) > 0, "1").otherwise("0") for plane in planes]
    rows = factors.select("vec_id", "features", F.concat(*side).alias("sides"), dot("features", "features").alias("norm"))
    rows = ranked(rows, [F.col("norm").desc(), F.col("vec_id")], ["sides"]).withColumn("part", F.floor(F.col("rank0") / block_rows))
    packed = materialise(rows.groupBy("sides", "part").agg(F.flatten(F.collect_list("features")).alias("values")), "packed")
    packed = ranked(packed, [F.col("sides"), F.col("part")], rank="block").select("block", "values")

    def balls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for block, values in zip(pdf["block"], pdf["values"]):
                x = np.asarray(values, "f8").reshape(-1, dim)
                centre = x.mean(axis=0)
                radius = np.sqrt(((x - centre) ** 2).sum(axis=1).max())
                out.append((block, values, len(x), centre, float(radius), float(np.sqrt((x ** 2).sum(axis=1).max()))))
            yield pd.DataFrame(out, columns=["block", "values", "n", "centre", "radius", "norm"])

    return materialise(packed.mapInPandas(balls, "block bigint, values array<double>, n bigint, centre array<double>, radius double, norm double"), "blocks")


def block_pairs(u: DataFrame, v: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """``u_block, v_block, n, low, high, multiply`` of every two blocks: between which values all their products lie.

    Within balls (c, r) and (d, s) a product differs from c.d by |c| s + |d| r + r s at most. Two blocks are multiplied only if a threshold lies
    between the bounds; otherwise all their pairs are above it or none is. Only centres meet here, a row for each two blocks.
    """
    ball = ["block", "n", "centre", "radius", "norm"]
    left = u.select(*[F.col(c).alias(f"u_{c}") for c in ball])
    right = v.select(*[F.col(c).alias(f"v_{c}") for c in ball])
    last = v.agg(F.max("block")).scalar()
    met = left.withColumn("v_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).join(right, "v_block")
    length = {side: F.sqrt(dot(f"{side}_centre", f"{side}_centre")) for side in "uv"}
    middle = dot("u_centre", "v_centre")
    slack = length["u"] * F.col("v_radius") + length["v"] * F.col("u_radius") + F.col("u_radius") * F.col("v_radius")
    most = F.col("u_norm") * F.col("v_norm")
    margin = 1e-9 * (1 + most)  # what rounding can move a product by
    low, high = F.greatest(middle - slack, -most) - margin, F.least(middle + slack, most) + margin
    met = met.select("u_block", "v_block", (F.col("u_n") * F.col("v_n")).alias("n"), low.alias("low"), high.alias("high"))
    between = [(F.col("low") <= t) & (F.lit(t) <= F.col("high")) for t in thresholds]
    return met.withColumn("multiply", reduce(lambda x, y: x | y, between))


def pairs_above(
    users: DataFrame, items: DataFrame, thresholds: Sequence[float], block_rows: int = 1024
) -> DataFrame:
    """(threshold, n_above): pairs of user and item with u.v above each threshold.

    Both factor tables are packed into blocks of ``block_rows`` vectors; a task multiplies two blocks and emits only
    counts, so no pair is ever a row. Block pairs whose bounds decide all thresholds are counted without their vectors.
    """
    thresholds = sorted(float(t) for t in thresholds)
    u, v = _blocks(users, block_rows), _blocks(items, block_rows)
    plan = materialise(block_pairs(u, v, thresholds), "block-pairs")
    levels = np.asarray(thresholds)
    dim = _dimension(users)

    def count(blocks: pa.Table, todo: pa.Table) -> pa.Table:
        total = np.zeros(len(levels) + 1, dtype=np.int64)
        sides, numbers, values = (blocks.column(c) for c in ("side", "block", "values"))
        held = {(s, b): np.asarray(v.values).reshape(-1, dim) for s, b, v in zip(sides.to_pylist(), numbers.to_pylist(), values)}
        for a, b in zip(todo.column("u_block").to_pylist(), todo.column("v_block").to_pylist()):
            # Position i: the score is above exactly i thresholds.
            above = np.searchsorted(levels, (held["u", a] @ held["v", b].T).ravel(), side="left")
            total += np.bincount(above, minlength=len(levels) + 1)
        return pa.table({"threshold": levels, "n_above": total[::-1].cumsum()[::-1][1:]})

    cell = [F.floor(F.col(f"{side}_block") / GROUP_BLOCKS).alias(f"{side}_group") for side in "uv"]
    work, groups = plan.where("multiply").select("u_block", "v_block", *cell), ["u_group", "v_group"]
    # A block goes once to each group of blocks it meets, not once to each block.
    sent = [work.select(*groups, F.col(f"{side}_block").alias("block")).distinct().join(table.select("block", "values"), "block").withColumn("side", F.lit(side))
            for side, table in (("u", u), ("v", v))]
    found = sent[0].unionByName(sent[1]).groupBy(*groups).cogroup(work.toDF(*work.columns).groupBy(*groups)).applyInArrow(count, "threshold double, n_above long")
    asked = users.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    decided = plan.where("not multiply").select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.when(F.col("low") > t, F.col("n")).otherwise(0).alias("n_above")) for t in thresholds])).alias("s")).select("s.*")
    found = found.unionByName(decided).groupBy("threshold").agg(F.sum("n_above").alias("n_above"))
    return asked.join(found, "threshold", "left").select("threshold", F.coalesce("n_above", F.lit(0)).alias("n_above"))


def multiplied_share(users: DataFrame, items: DataFrame, thresholds: Sequence[float], block_rows: int = 1024) -> float:
    """Share of the pairs whose blocks ``pairs_above`` multiplies."""
    plan = block_pairs(_blocks(users, block_rows), _blocks(items, block_rows), [float(t) for t in thresholds])
    return plan.agg(F.try_divide(F.sum(F.when(F.col("multiply"), F.col("n")).otherwise(0)), F.sum("n"))).first()[0]


def _observed_sums(pairs: DataFrame, users: DataFrame, items: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, n_data, sum_dm, n_cross) of the model values of the observed pairs (u_id, v_id).

    Pairs are dealt into cells of ``CELL_IDS`` by ``CELL_IDS`` ids, by hash. A vector goes once to each cell it has a pair in, not along with
    each pair, and a task emits sums only.
    """
    tables = {"u": users, "v": items}
    n_groups = {side: max(1, -(-t.count() // CELL_IDS)) for side, t in tables.items()}
    cell = ["u_cell", "v_cell"]
    dealt = materialise(pairs.where("u_id is not null and v_id is not null").select("u_id", "v_id", *[
        F.pmod(F.xxhash64(f"{side}_id"), F.lit(n)).cast("int").alias(f"{side}_cell") for side, n in n_groups.items()]), "observed")
    sent = [
        dealt.select(*cell, F.col(f"{side}_id").alias("id")).distinct()
        .join(t.select(F.col("vec_id").alias("id"), F.col("features").alias("x")), "id").select(*cell, "id", "x", F.lit(side).alias("side"))
        for side, t in tables.items()]
    levels, dim = np.asarray([float(t) for t in thresholds]), _dimension(users)

    def sums(vectors: pa.Table, met: pa.Table) -> pa.Table:
        data = {}
        for side in "uv":
            part = vectors.filter(pc.equal(vectors.column("side"), side))
            data[side] = pd.DataFrame({f"{side}_id": part.column("id").to_numpy(), side: np.arange(part.num_rows)}), part.column("x").to_pylist()
        at = met.select(["u_id", "v_id"]).to_pandas().merge(data["u"][0], on="u_id").merge(data["v"][0], on="v_id")
        x, y = (np.array([np.full(dim, np.nan) if v is None else v for v in data[side][1]], "f8").reshape(-1, dim) for side in "uv")
        n, total, above = len(at), 0.0, np.zeros(len(levels), "i8")
        for low in range(0, n, 65_536):
            m = np.zeros(min(65_536, n - low))
            for a, b in zip(x.T, y.T):
                m = m + a[at["u"].to_numpy()[low:low + 65_536]] * b[at["v"].to_numpy()[low:low + 65_536]]
            total += float(np.nansum(m))  # a value of a missing vector is missing
            above += (m[:, None] > levels).sum(axis=0)
        return pa.table({"n": pa.array([n], pa.int64()), "dm": pa.array([total]), "above": pa.array([above.tolist()], pa.list_(pa.int64()))})

    found = sent[0].unionByName(sent[1]).groupBy(*cell).cogroup(dealt.toDF(*dealt.columns).groupBy(*cell)).applyInArrow(sums, "n long, dm double, above array<long>")
    whole = found.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_data"), F.coalesce(F.sum("dm"), F.lit(0.0)).alias("sum_dm"),
        F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(F.sum(F.col("above")[i]), F.lit(0)).alias("n_cross"))
                  for i, t in enumerate(thresholds)]).alias("cross"))
    return whole.select("n_data", "sum_dm", F.inline("cross"))


def sparse_threshold_stats(
    pairs: DataFrame, users: DataFrame, items: DataFrame, thresholds: Sequence[float] = (0.5,)
) -> DataFrame:
    """mean_data, mean_sim, mean_cross per threshold over the full matrix, from its ones and the factors."""
    n_users = users.agg(F.count(F.lit(1))).scalar()
    n_items = items.agg(F.count(F.lit(1))).scalar()
    total = (n_users * n_items).cast("double")
    sums = _observed_sums(pairs, users, items, thresholds)
    return sums.join(pairs_above(users, items, thresholds), "threshold").select(
        "threshold",
        (F.col("n_data") / total).alias("mean_data"),
        (F.col("n_above") / total).alias("mean_sim"),
        (F.col("n_cross") / total).alias("mean_cross"),
        (F.col("sum_dm") / total).alias("mean_dm"),
    )


def _dimension(factors: DataFrame) -> int:
    return factors.select(F.size("features")).first()[0]


def _moments(factors: DataFrame, dim: int) -> DataFrame:
    """Row count, column sums and Gram matrix of a factor table, as one struct."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, gram = 0, np.zeros(dim), np.zeros((dim, dim))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["features"].to_numpy())
                n, sums, gram = n + len(x), sums + x.sum(axis=0), gram + x.T @ x
        values = np.concatenate(([float(n)], sums, gram.ravel()))
        yield pd.DataFrame({"pos": np.arange(len(values)), "value": values})

    sums = factors.select("features").mapInPandas(partial, "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value"))
    # dim * dim + dim + 1 numbers, in order.
    found = sums.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("m"))
    return found.select(F.struct(
        F.element_at("m", 1).cast("bigint").alias("n"), F.slice("m", 2, dim).alias("sums"), F.slice("m", dim + 2, dim * dim).alias("gram")))


def confusion(
    pairs: DataFrame, users: DataFrame, items: DataFrame, thresholds: Sequence[float] = (0.5,)
) -> DataFrame:
    """Confusion fractions, precision, recall, fallout, f-score, rms and mean ratio per threshold.

    Means of u.v and (u.v)^2 over all pairs come from column sums and Gram matrices, so only the
    count above the threshold looks at pairs.
    """
    dim = _dimension(users)
    stats = sparse_threshold_stats(pairs, users, items, thresholds).withColumns({
        "u": _moments(users, dim).scalar(),
        "v": _moments(items, dim).scalar(),
    })
    total = F.col("u.n") * F.col("v.n").cast("double")
    data, sim, cross = F.col("mean_data"), F.col("mean_sim"), F.col("mean_cross")
    out = stats.withColumns({
        "mean_model": dot("u.sums", "v.sums") / total,
        "rms": F.sqrt(data - 2 * F.col("mean_dm") + dot("u.gram", "v.gram") / total),
        "tp": cross,
        "tn": 1 - data - sim + cross,
        "fp": sim - cross,
        "fn": data - cross,
    })
    out = out.withColumns({
        "mean_ratio": F.try_divide(F.col("mean_model"), data),
        "precision": F.col("tp") / (F.col("tp") + F.col("fp") + EPSILON),
        "recall": F.col("tp") / (F.col("tp") + F.col("fn") + EPSILON),
        "fallout": F.col("fp") / (F.col("fp") + F.col("tn") + EPSILON),
    })
    return out.withColumn(
        "fscore",
        F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
    ).drop("u", "v", "mean_dm")
