"""Every query against its SQL; queries without SQL return rows."""

import pytest
from check import SF_DIR, compare, duck_rows, spark_rows

import __spark_entry__ as entry
from patronage.plans import oracles, registry

SQL = oracles.oracle_sql()
QUERIES = registry.queries()


# Plans of queries that are not written or fitted on the way.
LAZY = [n for n in QUERIES if not n.startswith(("ml_", "sink_", "src_", "als_", "kmeans_fit")) and n not in (
    "cv_auc", "grid_search_c", "feature_importances", "topk_features", "fit_predict_submit", "assemble", "factor_job")]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    got = spark_rows(df)
    assert compare(got, duck_rows(con, SQL[name])) is None
    if name in LAZY:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# SQL cannot repeat a fit or a draw; their numbers are held against plain versions in test_models.py and test_learners.py.
FITTED = {
    "ml_logistic", "ml_gaussian_nb", "ml_svc", "ml_extra_trees", "ml_boosting", "ml_quantile_linear", "quantile_submission", "cv_auc", "grid_search_c",
    "feature_importances", "topk_features", "fit_predict_submit", "als_implicit", "als_explicit", "kmeans_fit_assign", "factor_job", "sink_model",
    "chi_pvalue", "auc_bootstrap"}


def test_every_other_query_has_sql():
    assert set(QUERIES) - FITTED == set(SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
