"""Bounds for the operators that have no SQL form."""

import pytest
from pyspark.sql import functions as F

from patronage.operators import encode, evaluate, factors, joins, models, stats
from patronage.plans import jobs, registry
from patronage.plans.registry import _scored
from patronage.session import materialise


@pytest.fixture(scope="module")
def encoded(shop):
    return models.encoded(*jobs.model_frames(shop))


def test_quantile_model_is_no_worse_than_the_constant(shop):
    table = materialise(jobs.priced_features(shop), "features").where("label <> 0.5")
    scored, losses = models.quantile_linear(table, table, ["total_spend", "offer_value", "item_popularity"], passes=10)
    assert losses["loss"] <= losses["constant_loss"]
    assert scored.count() == table.count()


def test_probabilities_and_slots(encoded, shop):
    (train, test), names = encoded
    assert train.first()["features"].size == len(names)
    rows = models.fit_and_score(models.classifiers()["logistic"], train, test).collect()
    assert len(rows) == shop.history_test.count()
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_frames_of_a_fit_carry_no_slot_names(encoded):
    """A plan holds the schema and goes with every task, so names of all slots would be sent again and again."""
    (train, test), _ = encoded
    assert train.schema["features"].metadata == test.schema["features"].metadata == {}


def test_sums_are_written_once_for_both_frames(shop):
    _, test = jobs.model_frames(shop)
    assert "lineitem" not in test._jdf.queryExecution().optimizedPlan().toString()


def test_unseen_category_is_all_zeros(spark):
    from pyspark.ml import Pipeline

    fitted = Pipeline(stages=encode.one_hot(["a"])).fit(spark.createDataFrame([("x",), ("y",)], "a string"))
    rows = fitted.transform(spark.createDataFrame([("x",), ("new",)], "a string")).select("a_hot").collect()
    assert rows[0][0].size == 2 and rows[0][0].numNonzeros() == 1
    assert rows[1][0].numNonzeros() == 0


def test_grid_has_one_best(encoded):
    (train, _), _ = encoded
    rows = models.grid_search_c(train, grid=(0.25, 1.0, 4.0), max_iter=5).collect()
    best = [r for r in rows if r["best"]]
    assert len(best) == 1
    top = max(r["mean_auc"] for r in rows)
    assert best[0]["mean_auc"] == top
    assert best[0]["c"] == max(r["c"] for r in rows if r["mean_auc"] == top)


def test_grid_spacing():
    assert len(models.C_GRID) == 15
    assert models.C_GRID[0] == 2.0 ** -4 and models.C_GRID[7] == 1.0 and models.C_GRID[14] == 2.0 ** 4


def test_p_values_agree(shop):
    history = shop.saved_train.join(shop.offers, "offer")
    for r in stats.chi_pvalue(history, ["market", "company"], 2000).collect():
        assert 0 < r["p_simulated"] <= 1
        assert r["p_simulated"] == pytest.approx(r["p_value"], abs=0.08)


def test_bootstrap_is_near_the_area(shop):
    scored = materialise(_scored(shop), "scored")
    area = evaluate.auroc(scored).first()["auroc"]
    mean = evaluate.auc_bootstrap(scored).agg(F.avg("auc")).first()[0]
    assert mean == pytest.approx(area, abs=0.15)


def test_p_values_with_their_facts(spark, shop):
    rows = {r["feature"]: r for r in registry.queries()["chi_pvalue"](spark, shop.sf_dir).collect()}
    assert set(rows) == set(stats.CHI_FEATURES)
    assert all(0 <= r["p_value"] <= 1 and 0 < r["p_simulated"] <= 1 and r["in_range"] and r["trips_decide"] for r in rows.values())


@pytest.mark.parametrize("name", ["ml_logistic", "ml_gaussian_nb"])
def test_scores_with_their_facts(spark, shop, name):
    rows = registry.queries()[name](spark, shop.sf_dir).collect()
    assert sorted(r["id"] for r in rows) == sorted(r["id"] for r in shop.history_test.join(shop.offers, "offer").collect())
    assert all(0 <= r["score"] <= 1 and r["in_range"] and r["learned"] for r in rows)


def test_a_fit_that_ranks_backwards_has_not_learned(spark, shop, monkeypatch):
    right = models.scores
    monkeypatch.setattr(models, "scores", lambda model, frame, *keep: right(model, frame, *keep).withColumn("score", 1 - F.col("score")))
    assert not registry.queries()["ml_logistic"](spark, shop.sf_dir).first()["learned"]


def test_extreme_weights_with_their_facts(spark, shop, encoded):
    rows = registry.queries()["topk_features"](spark, shop.sf_dir).collect()
    n = min(100, len(encoded[1]))
    assert sorted(r["side"] for r in rows) == ["bottom"] * n + ["top"] * n
    assert all(r["n"] == r["n_features"] == n and r["below_the_top"] for r in rows)


def test_submission_with_its_facts(spark, shop):
    rows = registry.queries()["fit_predict_submit"](spark, shop.sf_dir).collect()
    assert sorted(r["id"] for r in rows) == sorted(r["id"] for r in shop.history_test.collect())
    assert all(0 <= r["repeatProbability"] <= 1 and r["in_range"] for r in rows)


def test_factors_reach_every_user(shop):
    pairs = materialise(factors.pair_counts(shop.transactions), "pairs")
    model = factors.als_implicit(pairs)
    assert model.rank == factors.RANK
    assert model.userFactors.count() == pairs.select("user_idx").distinct().count()


def test_unknown_side_zeroes_the_product(spark, shop):
    customers = spark.createDataFrame([(1, 0, 1), (2, 0, 999), (3, None, 1)], "id long, u_id long, v_id long")
    rows = {r["id"]: r for r in factors.products(
        factors.with_factors(customers, shop.user_factors, shop.item_factors)).collect()}
    assert not rows[1]["unknown"] and rows[2]["unknown"] and rows[3]["unknown"]
    assert set(rows[2]["uv"]) == {0.0}


def test_files_keep_every_row(spark, shop):
    q = registry.queries()
    assert q["src_partfiles"](spark, shop.sf_dir).count() == shop.transactions.count()
    assert q["src_triples"](spark, shop.sf_dir).count() == factors.pair_counts(shop.transactions).count()
    assert q["src_predictions"](spark, shop.sf_dir).where("score IS NULL OR id IS NULL").count() == 0


def test_reductions_are_nested(shop):
    one = joins.reduce_rows(shop.transactions, shop.offers, "category")
    three = joins.reduce_rows(shop.transactions, shop.offers, "category", "company", "brand")
    assert one.select("txn_seq").subtract(three.select("txn_seq")).count() == 0


def test_clusters_cover_train_and_test(shop):
    rows = jobs.cluster_job(shop, k=5)
    assert rows.count() == shop.history_base.count()
    assert rows.where("part = 'test' AND repeatProbability IS NULL").count() == 0
    assert rows.select("cluster").distinct().count() <= 5


def test_partitions_follow_the_input_size(spark):
    from patronage.session import configure

    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        configure(spark, 10 * 1024 ** 3)
        assert spark.conf.get(key) == "160"
        configure(spark, 100 * 1024 ** 4)
        assert spark.conf.get(key) == "1638400"
        configure(spark, 1)
        assert spark.conf.get(key) == str(3 * spark.sparkContext.defaultParallelism)
    finally:
        spark.conf.unset(key)


def test_entries_of_sparse_and_dense_vectors(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(1, Vectors.sparse(9, [2, 7], [1.0, 0.25])), (2, Vectors.dense(0.0, 1.0, -2.5)), (3, Vectors.sparse(4, [], []))]
    found = spark.createDataFrame(rows, ["id", "x"]).select("id", encode.vector_entries("x").alias("e")).select("id", "e.*").collect()
    assert {r["id"]: (r["size"], [tuple(e) for e in r["entries"]]) for r in found} == {
        1: (9, [(2, 1.0), (7, 0.25)]), 2: (3, [(1, 1.0), (2, -2.5)]), 3: (4, [])}
