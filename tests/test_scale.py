"""Hot groups, plans, and brute-force checks of the distributed order statistics."""

import datetime
import random
import statistics
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from check import SF_DIR
from pyspark import TaskContext
from pyspark.sql import functions as F

from patronage.functions import columns as C
from patronage.operators import aggregates, evaluate, factors, features, order_stats, visits
from patronage.plans import registry
from patronage.sources import sinks

random.seed(3)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group; repeats, zeros and negatives among the values."""
    rows = [(0 if i % 3 == 0 else 1 + i % 40, round(random.choice([-1, 1, 1]) * random.expovariate(0.1), 1))
            for i in range(6000)] + [(0, 0.0)] * 5
    return rows, spark.createDataFrame(rows, "k int, x double").repartition(8)


def groups(rows):
    out = {}
    for k, x in rows:
        out.setdefault(k, []).append(x)
    return out


def test_medians_of_hot_and_light_groups(skewed):
    rows, df = skewed
    want = {k: (len(v), statistics.median(v)) for k, v in groups(rows).items()}
    runs = order_stats.combinations_of(df, ["k"], ["x"])
    got = {r["k"]: (r["n_rows"], r["med_x"]) for r in order_stats.grouped_medians(runs, ["k"], ["x"]).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0]
        assert got[k][1] == pytest.approx(want[k][1])


def test_trimmed_mean_of_a_hot_group(skewed):
    rows, df = skewed
    got = {r["k"]: r["m"] for r in order_stats.trimmed_mean(df, ["k"], "x", 0.05, "m").collect()}
    for k, v in groups(rows).items():
        cut = len(v) // 20
        assert got[k] == pytest.approx(np.mean(sorted(v)[cut: len(v) - cut]))


@pytest.mark.parametrize("first", [0, 10 ** 12])
def test_ranks_are_dense_ordered_and_spread(spark, first):
    """Also for a narrow band of large ids: no range partition holds more than a bounded share."""
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    ids = [first + i for i in random.sample(range(20_000), 8000)]
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(8)
    rows = sorted((r["rank0"], r["id"], r["total"]) for r in order_stats.ranked(df, [F.col("id")]).collect())
    assert [r[1] for r in rows] == sorted(ids)
    assert [r[0] for r in rows] == list(range(8000))
    assert {r[2] for r in rows} == {8000}
    sizes = [r["count"] for r in order_stats.spread(df, ["id"]).groupBy("_bucket").count().collect()]
    spark.conf.unset(merging)
    assert len(sizes) > 4 and max(sizes) <= 8000 / 3


def test_nulls_and_special_values_are_ranked(spark):
    values = [None, float("-inf"), -1.0, 0.0, 2.0, float("inf"), float("nan")]
    df = spark.createDataFrame([(k, v) for k in ("a", None) for v in values], "k string, x double")
    got = {}
    for r in order_stats.ranked(df, [F.col("x")], keys=["k"]).collect():
        got.setdefault(r["k"], []).append((r["rank0"], r["total"], str(r["x"])))
    for k in ("a", None):
        assert sorted(got[k]) == [(i, 7, str(v)) for i, v in enumerate(values)]


def test_split_and_pairs_keep_null_rows(spark):
    rows = spark.createDataFrame([(1, "2000-01-01"), (2, None), (None, "2000-01-02")], "id long, offerdate string")
    assert visits.time_ordered_split(rows, 0.67).count() == 3
    bought = spark.createDataFrame([(1, "c", 5, "b"), (1, "c", None, "b"), (2, None, 5, None), (None, "c", 5, "b")], "id long, category string, company int, brand string")
    assert factors.pair_counts(bought).count() == 4


def test_median_of_infinite_values(spark):
    df = spark.createDataFrame([("k", x) for x in (float("-inf"), 1.0, 2.0, 3.0, float("inf"))], "k string, x double")
    runs = order_stats.combinations_of(df, ["k"], ["x"])
    assert order_stats.grouped_medians(runs, ["k"], ["x"]).first()["med_x"] == 2.0
    assert order_stats.trimmed_mean(df, ["k"], "x", 0.2, "m").first()["m"] == 2.0


def test_blocks_that_bounds_decide_are_not_multiplied(spark):
    rows = [(i, [float(i)] * 2) for i in range(64)]
    frame = spark.createDataFrame(rows, "vec_id long, features array<double>")
    blocks = evaluate._blocks(frame, 8)
    plan = evaluate.block_pairs(blocks, blocks, [6000.0])
    assert plan.agg({"n": "sum"}).first()[0] == 64 * 64 and plan.where("multiply").count() < plan.count() / 3
    for t in (-1.0, 0.0, 6000.0, 1e9):
        want = sum(2 * i * j > t for i in range(64) for j in range(64))
        assert evaluate.pairs_above(frame, frame, [t], block_rows=8).first()["n_above"] == want


def test_clustered_vectors_are_mostly_counted_by_their_balls(spark):
    import numpy as np

    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(8, 16)) * 3

    def frame(n):
        x = centres[rnd.integers(0, 8, n)] + rnd.normal(size=(n, 16)) * 0.05
        return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, features array<double>")

    (x, u), (y, v) = frame(700), frame(500)
    thresholds = [-20.0, -3.0, 0.0, 5.0, 40.0, 200.0]
    found = {r["threshold"]: r["n_above"] for r in evaluate.pairs_above(u, v, thresholds, block_rows=16).collect()}
    assert found == {t: int((x @ y.T > t).sum()) for t in thresholds}
    assert evaluate.multiplied_share(u, v, thresholds, block_rows=16) < 0.5


def test_item_keys_with_null_and_underscore(spark):
    rows = [(1, "c", None, "b", 2, 3.0), (1, None, "c", "b", 1, 1.0), (2, "c", "x_y", "b", 1, 5.0), (2, "c", "x", "y_b", 4, 7.0)]
    df = spark.createDataFrame(rows, "id long, category string, company string, brand string, purchasequantity int, purchaseamount double")
    df = df.withColumn("date", F.lit("2000-01-15").cast("date"))
    items = features.item_history(df, "2000-02-01")
    assert items.count() == 4
    joined = features.items_with_categories(items, features.category_history(df, "2000-02-01")).collect()
    assert sorted((r["item_category"] or "", r["item_total"], r["category_total"]) for r in joined) == [("", 1, 1), ("c", 1, 3), ("c", 1, 3), ("c", 1, 3)]


def test_pairs_above_by_brute_force(spark):
    rng = np.random.default_rng(5)
    u, v = rng.normal(size=(37, 4)), rng.normal(size=(23, 4))
    frame = lambda m: spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)],
                                            "vec_id long, features array<double>")
    for levels in ([-0.5, 0.0, 1.0], [0.5, 2.0, 50.0]):
        got = {r["threshold"]: r["n_above"]
               for r in evaluate.pairs_above(frame(u), frame(v), levels, block_rows=8).collect()}
        assert got == {t: int((u @ v.T > t).sum()) for t in levels}


def test_auroc_of_random_labels_is_a_half(spark):
    df = spark.range(4000).select(C.unit_hash("id").alias("score"), (C.unit_hash(F.col("id") + 9999) < 0.4).cast("int").alias("actual"))
    assert evaluate.auroc(df).first()["auroc"] == pytest.approx(0.5, abs=0.04)


def test_hot_customer_is_split_in_the_join(spark, shop):
    """With shuffled joins and small limits, AQE splits the customer that holds most rows."""
    copies = shop.transactions.limit(1).withColumn("txn_seq", F.explode(F.expr("sequence(1L, 60000L)")))
    hot = copies.unionByName(shop.transactions).repartition(16)
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "32",
    }
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, x in keys.items():
            spark.conf.set(k, x)
        df = features.buy_history(hot, shop.history_base, shop.offers)
        n = len(df.collect())
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, x in old.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)
    assert n == shop.transactions.select("id").distinct().count()
    assert "SortMergeJoin(skew=true)" in plan


ONE_SCAN = ["buy_history_dept", "never_bought", "agg_item_stats", "pair_counts"]


@pytest.mark.parametrize("name", ONE_SCAN)
def test_reads_the_lines_once(spark, name):
    """What the query writes on the way is read instead: its own plan has no second scan of the lines."""
    plan = registry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem") <= 1


def test_shards_partition_the_rows(shop):
    sharded = sinks.with_shard(shop.transactions, 10)
    assert sharded.groupBy("id").agg(F.countDistinct("bucket").alias("b")).where("b > 1").count() == 0
    assert sharded.where("bucket < 0 OR bucket >= 10").count() == 0
    assert sinks.with_shard(shop.transactions, 1000).select("bucket").distinct().count() > 100


def test_window_counts_are_nested(shop):
    wide = features.buy_history(shop.transactions, shop.history_base, shop.offers).na.fill(0)
    for k in features.ATTRIBUTES:
        names = [f"has_bought_{k}_30", f"has_bought_{k}_60", f"has_bought_{k}_90", f"has_bought_{k}_180", f"has_bought_{k}"]
        for a, b in zip(names, names[1:]):
            assert wide.where(F.col(a) > F.col(b)).count() == 0


def test_wide_medians_hold_no_wide_rows_while_they_are_filled(spark):
    plan = registry.queries()["med_groups"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "pivotfirst" not in plan


def test_wide_medians_of_hot_and_light_customers(spark):
    """Customers inside a partition, at its edges and over many, with nulls, returns, repeated rows and no known date."""
    rnd, names = random.Random(5), aggregates.GROUP_ATTRIBUTES
    key = lambda: rnd.choice([None, "a", "a", "b"])
    history = [(i, 0, "m", i, datetime.date(2000, 1, 1)) for i in range(300)] + [(7, 0, "m", 8, datetime.date(2000, 1, 20))]
    offers = [(i, key(), key(), key(), 1.0, 1) for i in range(300)]
    bought = [(150 if i % 3 == 0 else rnd.randrange(290), key(), key(), key(), rnd.choice([None, datetime.date(2000, 1, 10) - datetime.timedelta(rnd.randrange(300))]),
               rnd.choice([None, rnd.randrange(9)]), rnd.randrange(5), rnd.choice([None, -0.0, float("inf"), float(rnd.randrange(-9, 99))])) for i in range(6000)]
    frames = (
        spark.createDataFrame(bought, "id long, category string, company string, brand string, date date, productsize int, purchasequantity int, purchaseamount double"),
        spark.createDataFrame(history, "id long, chain int, market string, offer long, offerdate date"),
        spark.createDataFrame(offers, "offer long, category string, company string, brand string, offervalue double, quantity int"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = defaultdict(list)
        for r in aggregates.group_medians(*(f.repartition(3) for f in frames)).collect():
            got[r["id"]].append(r.asDict())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups = defaultdict(list)
    for i, *keys, date, size, quantity, amount in bought:
        for h in history:
            if h[0] == i:
                on = {k for k, x, y in zip(names, keys, offers[h[3]][1:4]) if x is not None and x == y}
                age = (h[4] - date).days if date else None
                for s, subset in enumerate(aggregates.key_subsets()):
                    if set(subset) <= on:
                        groups[i, s, None].append((size, quantity, amount))
                        if age is None or age >= 0:
                            groups[i, s, bin_of(age)].append((size, quantity, amount))
    assert set(got) == {h[0] for h in history} and len(got[7]) == 2 and all(got[i][0]["len_0"] is None for i in range(290, 300))
    for i in range(290):
        for s in range(8):
            for name in (None, *C.RECENCY_NAMES):
                rows, end = groups[i, s, name], f"_{s}" if name is None else f"_{name}_{s}"
                for row in got[i]:
                    assert row[f"len{end}"] == (len(rows) or None)
                    for j, prefix in enumerate(("ps", "pq", "pa")):
                        values = [r[j] for r in rows if r[j] is not None]
                        assert row[f"{prefix}_median{end}"] == (statistics.median(values) if values else None)


def bin_of(age):
    return C.RECENCY_NAMES[-1 if age is None else sum(age >= e for e in C.RECENCY_EDGES)]


def test_groups_inside_a_partition_are_whole(spark):
    sizes = {k: 2000 if k in (0, 40) else 1 + k % 7 for k in range(100)}
    df = spark.createDataFrame([(k, i) for k, n in sizes.items() for i in range(n)], "k long, x long").repartition(5)
    named = lambda kind: lambda t: pa.table([t["k"], pa.array([kind] * len(t)), pa.array([TaskContext.get().partitionId()] * len(t), pa.int32())], names=["k", "kind", "part"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = order_stats.whole_groups(df, "k", named("whole"), named("rest"), "k long, kind string, part int", chunk=20).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {k: sum(r["k"] == k for r in rows) for k in sizes} == sizes
    whole = {r["k"] for r in rows if r["kind"] == "whole"}
    rest = {(r["k"], r["part"]) for r in rows if r["kind"] == "rest"}
    parts = {r["part"] for r in rows}
    assert not whole & {k for k, _ in rest} and len(parts) > 3 and len(whole) > 60
    assert {0, 40} & {k for k, _ in rest} and all(sum(p == q for _, q in rest) <= 2 for p in parts)


def test_only_groups_at_the_edges_are_totalled(spark):
    rows = [(None if k == 0 else k, i) for k, n in ((0, 300), (1, 2), (2, 400), (3, 1), (4, 1), (5, 250)) for i in range(n)] + [(100 + i, 0) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, x int").withColumn("n", F.lit(1).cast("bigint")).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = order_stats.spread(df, ["k", "x"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    buckets = runs.select("_bucket").distinct().count()
    assert buckets > 3 and order_stats._edges(runs, ["k"]).count() <= 2 * buckets
    sizes = {}
    for k, _ in rows:
        sizes[k] = sizes.get(k, 0) + 1
    for r in order_stats.running_totals(runs, ["k"], [F.col("x")], ["n"]).collect():
        assert (r["before_n"], r["all_n"]) == (r["x"], sizes[r["k"]])


def test_observed_pairs_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "CELL_IDS", 5)
    rng = np.random.default_rng(8)
    u, v = [(int(i), rng.normal(size=3).tolist()) for i in [*range(20), 4]], [(i, rng.normal(size=3).tolist()) for i in range(13)]
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 22, (90, 2))] + [(None, 1), (1, None)]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, features array<double>")
    found = evaluate._observed_sums(spark.createDataFrame(pairs, "u_id long, v_id long"), frame(u), frame(v), [-0.5, 0.5]).collect()
    m = [float(np.dot(x, y)) for a, b in pairs for i, x in u if i == a for j, y in v if j == b]
    assert [(r["threshold"], r["n_data"], r["n_cross"]) for r in found] == [(t, len(m), sum(z > t for z in m)) for t in (-0.5, 0.5)]
    assert found[0]["sum_dm"] == pytest.approx(sum(m))
