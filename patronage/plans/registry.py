"""One query per operator, over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.columns import rounded
from ..operators import (
    aggregates as A,
    bayes as B,
    clusters as K,
    encode as N,
    evaluate as V,
    factors as M,
    features as X,
    joins as J,
    kernel as KC,
    models as L,
    online as Q,
    order_stats as O,
    prices as P,
    stats as S,
    trees as T_,
    visits as W,
    weighted as G,
)
from ..session import materialise, scratch_path
from ..sources import files, schemas, sinks, sparse_lines
from ..sources.shop import CUTOFF, Shop
from . import jobs

_QUERIES: dict[str, Callable[[Shop], DataFrame]] = {}

THRESHOLDS = tuple(0.1 + 0.15 * i for i in range(7))
_TEXT_KEYS = {"category": T.StringType(), "brand": T.StringType(), "market": T.StringType()}


def query(fn: Callable[[Shop], DataFrame]) -> Callable[[Shop], DataFrame]:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, fn=fn: fn(Shop(spark, sf_dir))) for name, fn in _QUERIES.items()}


def _offered(s: Shop) -> DataFrame:
    return s.saved_train.join(s.offers, "offer")


# ---- sources

@query
def src_catalog(s):
    """Rows behind every catalog name; the transactions are two files with a split number."""
    folder, found = scratch_path(s.spark, "data"), {}
    tables = {"offers": s.offers, "history": s.history_train, "history_test": s.history_test, "reduced": s.reduced}
    for name, df in tables.items():
        sinks.write_csv(df, files.data_path(folder, name))
        found[name] = s.spark.read.option("header", True).csv(files.data_path(folder, name))
    parts = [files.data_path(folder, "transactions", i) for i in range(2)]
    for i, path in enumerate(parts):
        sinks.write_csv(s.transactions.where(F.pmod("id", F.lit(2)) == i), path)
    found["transactions"] = s.spark.read.option("header", True).csv(parts)
    return files.row_counts(found)


@query
def src_transactions(s):
    return _through_csv(s, s.transactions, schemas.TRANSACTIONS, "transactions")


def _through_csv(s, df, schema, name):
    path = scratch_path(s.spark, name)
    schema = schemas.retyped(schema, **_TEXT_KEYS)
    sinks.write_csv(df.select(schema.fieldNames()), path)
    return files.read_csv(s.spark, path, schema)


@query
def src_offers(s):
    return _through_csv(s, s.offers, schemas.OFFERS, "offers")


@query
def src_history_train(s):
    return _through_csv(s, s.history_train, schemas.HISTORY_TRAIN, "trainHistory")


@query
def src_history_test(s):
    return _through_csv(s, s.history_test, schemas.HISTORY_TEST, "testHistory")


@query
def src_inferred(s):
    path = scratch_path(s.spark, "inferred")
    sinks.write_csv(s.history_test, path)
    return files.read_inferred(s.spark, path).select(
        F.col("id").cast("long"), F.col("chain").cast("int"), F.col("offer").cast("long"), "market", "offerdate")


@query
def src_partfiles(s):
    path = scratch_path(s.spark, "parts")
    schema = schemas.retyped(schemas.TRANSACTIONS, **_TEXT_KEYS)
    sinks.write_csv(s.transactions.select(schema.fieldNames()), path)
    return files.read_parts(s.spark, f"{path}/part-*", schema)


@query
def src_triples(s):
    path = scratch_path(s.spark, "row_col_num")
    M.pair_counts(s.transactions).select("user_idx", "item_idx", "value").write.csv(path)
    return rounded(files.read_triples(s.spark, path), ["value"], 6)


@query
def src_predictions(s):
    path = scratch_path(s.spark, "preds")
    scored = B.score_items(s.history_test.join(s.offers, "offer"), _offered(s))
    scored.select(C.fixed6("p_repeat"), F.col("id")).write.option("sep", " ").csv(path)
    return files.read_predictions(s.spark, path)


# ---- sinks

@query
def sink_csv(s):
    path = scratch_path(s.spark, "count_trans")
    sinks.write_csv(A.count_by(s.transactions, "id", "category", "company", "brand", alias="count_trans"), path)
    return files.read_csv(
        s.spark, path, T.StructType.fromDDL("id long, category string, company int, brand string, count_trans long"))


@query
def sink_shard_by_customer(s):
    path = scratch_path(s.spark, "shards")
    sinks.write_shards(s.transactions, path, 100)
    return s.spark.read.parquet(path).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_customers"))


@query
def sink_sparse_text(s):
    path = scratch_path(s.spark, "lines")
    lines = sinks.sparse_lines(jobs.priced_features(s))
    sinks.write_lines(lines, path)
    return s.spark.read.text(path).withColumnRenamed("value", "line")


@query
def sink_routed(s):
    path = scratch_path(s.spark, "routed")
    table = X.feature_table(s.transactions, s.history_train, s.history_test, s.offers)
    sinks.write_routed(table.select(X.FEATURE_FIELDS), path, CUTOFF)
    return s.spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def sink_items_categories(s):
    path = scratch_path(s.spark, "items")
    items = X.item_history(s.transactions, CUTOFF).select(
        "item_id", "item_total", "item_amount", "item_quantity", "item_category", "item_company", "item_brand")
    sinks.write_csv(items, f"{path}/items.csv")
    sinks.write_csv(X.category_history(s.transactions, CUTOFF), f"{path}/categories.csv")
    items = files.read_csv(s.spark, f"{path}/items.csv", T.StructType.fromDDL(
        "id string, total long, amount double, quantity long, category string, company string, brand string"))
    categories = files.read_csv(s.spark, f"{path}/categories.csv", T.StructType.fromDDL(
        "id string, total long, amount double, quantity long"))
    return J.stack(items.withColumn("kind", F.lit("item")), categories.withColumn("kind", F.lit("category")))


@query
def sink_submission(s):
    path = scratch_path(s.spark, "submission")
    scored = B.score_items(s.history_test.join(s.offers, "offer"), _offered(s))
    sinks.write_csv(sinks.submission(scored, "p_repeat"), path)
    back = files.read_csv(s.spark, path, T.StructType.fromDDL("id long, repeatProbability double"))
    return rounded(back, ["repeatProbability"], 6)


@query
def sink_labels(s):
    path = scratch_path(s.spark, "lines")
    sinks.write_lines(sinks.sparse_lines(jobs.priced_features(s)), path)
    return sinks.labels_of_lines(s.spark.read.text(path).withColumnRenamed("value", "line"))


@query
def sink_model(s):
    """The factors of every customer, from a saved and loaded model."""
    path = scratch_path(s.spark, "factors")
    counts = materialise(s.transactions.groupBy("id", *M.ITEM_KEYS).agg(F.count(F.lit(1)).alias("n")), "counts")
    users, items = M.user_numbers(counts), M.item_numbers(counts)
    pairs = O.join_on(O.join_on(counts, users, ["id"]), items, M.ITEM_KEYS).select("user_idx", "item_idx", M.log_scale("n").alias("value"))
    sinks.save_factors(M.als_implicit(M.value_cutoff(pairs)), users, items, path)
    model, users, _ = sinks.load_factors(s.spark, path)
    found = users.join(M.factor_table(model.userFactors), F.col("user_idx") == F.col("vec_id"))
    return found.select("id", "user_idx", "features")


# ---- scalar functions

@query
def item_cat_brand(s):
    return s.offers.select("offer", C.item_cat_brand().alias("item"))


@query
def item_ccb(s):
    return s.offers.select("offer", C.item_ccb().alias("item"))


@query
def id_item(s):
    return s.transactions.select("txn_seq", C.with_id(C.item_cat_brand()).alias("id_item"))


@query
def item_family(s):
    return s.transactions.select(
        "txn_seq", C.item_family().alias("item_family"), C.with_id(C.item_family()).alias("id_item_family"))


@query
def item_sku(s):
    sku = C.item_sku(s.transactions)
    return s.transactions.select("txn_seq", sku.alias("item"), C.with_id(sku).alias("id_item"))


@query
def hash_sample(s):
    return s.transactions.where(C.in_sample("id", 0.25)).select("id", "txn_seq")


@query
def id_mod_sample(s):
    return s.transactions.where("pmod(id, 10) = 2").select("id", "txn_seq")


@query
def id_mod_group(s):
    return s.history_train.select("id", F.pmod("id", F.lit(100)).alias("group_no"))


@query
def price_filter(s):
    return P.price_filter(s.transactions).select(
        "txn_seq", "purchasequantity", F.col("purchaseamount").cast("double").alias("purchaseamount"))


@query
def unit_price(s):
    return rounded(s.transactions.select("txn_seq", P.unit_price().alias("price")), ["price"], 6)


@query
def value_cutoff(s):
    return rounded(M.value_cutoff(M.pair_counts(s.transactions)), ["value"], 6)


@query
def log_scale(s):
    counts = A.count_by(s.transactions, "id", alias="n")
    return rounded(counts.select("id", C.log_scale("n").alias("scaled")), ["scaled"], 6)


@query
def log_scale_capped(s):
    counts = A.count_by(s.transactions, "id", "category", alias="n")
    return rounded(counts.select("id", "category", C.log_scale_capped("n").alias("scaled")), ["scaled"], 6)


@query
def diff_days(s):
    rows = J.transactions_with_offer(s.transactions, s.history_base, s.offers)
    return rows.select("txn_seq", C.diff_days("offer_date", "date").alias("before_offer"),
                       C.diff_days("date", "offer_date").alias("after_offer"))


@query
def diff_months(s):
    return rounded(s.transactions.select("txn_seq", C.diff_months("date").alias("months")), ["months"], 6)


@query
def valid_date(s):
    return W.date_audit(s.transactions.select(F.col("date").cast("string").alias("date")), "date")


@query
def recency_bins(s):
    dates = s.history_base.select("id", "offerdate")
    rows = s.transactions.join(dates, "id").withColumn("_bin", C.recency_bin(C.diff_days("offerdate", "date")))
    flags = [F.coalesce((F.col("_bin") == i).cast("int"), F.lit(0)).alias(name)
             for i, name in enumerate(C.RECENCY_NAMES)]
    return rows.select("id", "txn_seq", *flags)


@query
def repeater_flag(s):
    return s.history_train.select("id", (F.col("repeattrips") > 0).alias("is_repeater"))


@query
def label_encode(s):
    return X.labels(s.history_train, s.history_test)


@query
def cap_repeats(s):
    return s.history_train.select("id", F.least("repeattrips", F.lit(5)).cast("bigint").alias("repeat_trips"))


@query
def early_late_split(s):
    return s.history_train.select(
        "id", F.when(C.is_early("offerdate", CUTOFF), "early").otherwise("late").alias("part"))


@query
def clean_numeric(s):
    sums = A.sums_by_category(s.transactions)
    rows = J.history_with_offers(s.history_train, s.offers).join(sums, ["id", "category"], "left")
    rows = rows.withColumn("per_unit", F.try_divide(F.col("purchaseamount"), F.col("purchasequantity")))
    return rounded(rows.select("id", C.clean_number("productsize").alias("productsize"),
                               C.clean_number("per_unit").alias("per_unit")), ["productsize", "per_unit"])


@query
def drop_reorder(s):
    return N.sorted_frame(J.history_with_offers(s.history_train, s.offers))


@query
def score_clamp(s):
    rows = M.products(jobs.factor_rows(s, s.history_base))
    return rounded(rows.select("id", C.clamp_score(M.raw_score()).alias("score")), ["score"], 6)


@query
def format_fixed(s):
    return s.offers.select("offer", C.fixed6("offervalue").alias("value_text"))


# ---- joins

@query
def join_history_offers(s):
    return J.history_with_offers(s.history_train, s.offers)


@query
def join_history_offers_outer(s):
    return J.history_with_offers_outer(s.history_train, s.offers)


@query
def reduce_category(s):
    return J.reduce_rows(s.transactions, s.offers, "category").select("id", "txn_seq", "category")


@query
def reduce_cat_or_company(s):
    return J.reduce_rows(s.transactions, s.offers, "category", "company").select(
        "id", "txn_seq", "category", "company")


@query
def reduce_any(s):
    return J.reduce_rows(s.transactions, s.offers, "category", "company", "brand").select(
        "id", "txn_seq", "category", "company", "brand")


@query
def join_txn_offer(s):
    return J.transactions_with_offer(s.transactions, s.history_base, s.offers).select(
        "id", "txn_seq", "date", "offer", "offer_date", "offer_chain", "offer_market", "offer_category",
        "offer_company", "offer_brand", "offer_value")


@query
def left_join_aggs(s):
    rows = J.history_with_offers(s.history_train, s.offers).select("id", "category")
    return J.left_join_aggregates(rows, A.sums_by_category(s.transactions), ["id", "category"])


@query
def join_item_category_stats(s):
    return X.items_with_categories(X.item_history(s.transactions, CUTOFF), X.category_history(s.transactions, CUTOFF))


@query
def join_features_item_stats(s):
    return rounded(
        jobs.priced_features(s).select(
            "id", "label", "total_spend", "offer_item_id", "item_total", "category_total", "item_popularity"),
        ["item_popularity"], 6)


@query
def join_scores_default(s):
    test = s.history_test
    seen = test.join(s.offers, "offer").join(s.reduced.select("id"), "id", "left_semi")
    scored = B.score_items(seen, _offered(s)).withColumnRenamed("p_repeat", "score")
    return rounded(J.scores_or_zero(test, scored), ["repeatProbability"], 6)


@query
def anti_missing_ids(s):
    missing = J.ids_without(s.history_test, s.reduced).select("id", F.lit("test_without_transactions").alias("kind"))
    unknown = J.ids_without(s.transactions, s.history_train).select("id", F.lit("transactions_without_offer").alias("kind"))
    return missing.unionByName(unknown)


@query
def cluster_lookup(s):
    rows = jobs.labelled_clusters(s, s.saved_train)
    stats = K.calibrate(rows)
    return rounded(J.cluster_lookup(rows.select("id", "cluster"), stats), ["frac_repeater"], 6)


# ---- aggregations

for _k in ("dept", "category", "company", "brand"):
    _QUERIES[f"cnt_id_{_k}"] = lambda s, k=_k: A.count_by(s.transactions, "id", k, alias=f"sum_{k}")


@query
def cnt_id_ccb(s):
    return A.count_by(s.transactions, "id", "category", "company", "brand", alias="count_trans")


@query
def cnt_id_cc(s):
    return A.count_by(s.transactions, "id", "category", "company", alias="count_trans")


@query
def cnt_not_this_brand(s):
    return A.not_this_brand(s.transactions)


@query
def sum_qty_ccb(s):
    return A.quantity_by(s.transactions, "id", "category", "company", "brand")


@query
def basket_size(s):
    return rounded(A.basket_size(s.transactions), ["avg_basket_size"])


@query
def monthly_spend(s):
    return rounded(A.monthly_spend(s.transactions), ["monthly_avg_pa", "max_min_months"])


@query
def sums_id_category(s):
    return A.sums_by_category(s.transactions)


@query
def med_groups(s):
    wide = A.group_medians(s.transactions, s.history_base, s.offers)
    return rounded(wide, [c for c in wide.columns if "_median_" in c])


@query
def cust_count(s):
    return A.count_by(s.transactions, "id", alias="n")


@query
def agg_id_item(s):
    return A.by_customer_item(s.transactions, C.item_cat_brand())


@query
def agg_rollup_id(s):
    return rounded(A.rollup_to_customer(A.by_customer_item(s.transactions, C.item_cat_brand())), ["tot_amount_all"])


@query
def diversity_item(s):
    own = J.history_with_offers(s.history_train, s.offers)
    by_item = A.by_customer_item(s.transactions, C.item_cat_brand())
    return rounded(A.offer_item_diversity(own, by_item, C.item_cat_brand()), ["diversity"], 6)


@query
def agg_id_diversity(s):
    return rounded(P.customer_diversity(P.priced(s.transactions)), ["diversity_by_id"], 6)


@query
def agg_item_stats(s):
    return rounded(P.item_stats(P.priced(s.transactions)),
                   ["mean_price_by_item", "med_price_by_item", "diversity_by_item"])


@query
def discount_pct(s):
    return rounded(
        P.discounts(P.priced(s.transactions)).drop("item_family"),
        ["mean_price_by_id_item", "mean_price_by_item", "price_discount", "price_discount_percent"])


@query
def discount_by_customer(s):
    rows = P.customer_discount(s.history_train, P.discounts(P.priced(s.transactions)))
    return rounded(rows.select("id", "repeater", "mean_discount_percent"), ["mean_discount_percent"])


@query
def item_stats_window(s):
    items = X.item_history(s.transactions, CUTOFF).select("item_id", "item_total", "item_amount", "item_quantity").toDF("key", "total", "amount", "quantity")
    categories = X.category_history(s.transactions, CUTOFF).toDF("key", "total", "amount", "quantity")
    return items.select(F.lit("item").alias("kind"), "*").unionByName(
        categories.select(F.lit("category").alias("kind"), "*"))


@query
def item_price_ratios(s):
    rows = X.price_ratios(X.items_with_categories(
        X.item_history(s.transactions, CUTOFF), X.category_history(s.transactions, CUTOFF)))
    ratios = ["item_popularity", "item_avg_cost", "category_avg_cost", "item_avg_cost_div_by_category_avg_cost"]
    return rounded(rows.select("item_id", *ratios), ratios)


@query
def match_counts(s):
    return A.match_counts(s.transactions, s.history_base, s.offers)


@query
def match_audit(s):
    return A.match_audit(s.transactions, s.history_train)


@query
def buy_history(s):
    return X.buy_history(s.transactions, s.history_base, s.offers)


@query
def buy_history_dept(s):
    return X.buy_history_dept(s.transactions, s.history_base, s.offers)


def _features(s):
    return X.feature_table(s.transactions, s.history_train, s.history_test, s.offers)


@query
def never_bought(s):
    return _features(s).select("id", *X.never_bought())


@query
def cross_flags(s):
    return _features(s).select("id", *X.cross_flags())


@query
def offer_context(s):
    return X.offer_context(s.history_base, s.offers)


@query
def distinct_counts(s):
    rows = J.history_with_offers(s.history_train, s.offers)
    return A.distinct_counts(rows, ["chain", "offer", "market", "category", "company", "offervalue", "brand"])


@query
def repeat_score_stats(s):
    rows = M.factor_columns(jobs.factor_rows(s, s.saved_train)).select("repeattrips", "score")
    return rounded(K.repeat_score_stats(rows), ["score_mean", "scaled_trips", "score_mean_err"], 6)


@query
def pair_counts(s):
    return rounded(M.pair_counts(s.transactions), ["value"], 6)


# ---- windows, sorts, limits

@query
def trip_gaps(s):
    return rounded(W.trip_gaps(s.transactions), ["mean_gap", "sd_gap", "long_ratio"])


@query
def first_per_group(s):
    return s.transactions.withColumn("id_item", C.with_id(C.item_cat_brand())).groupBy("id_item").agg(
        F.min("id").alias("id"), F.min(C.item_cat_brand()).alias("item"))


@query
def trimmed_mean(s):
    return rounded(O.trimmed_mean(P.priced(s.transactions), ["item_family"], "price", 0.05, "mean_price"), ["mean_price"])


@query
def dept_first_match(s):
    return X.first_matches(s.transactions, s.history_base, s.offers)


def _scored(s):
    """(score, actual) of the train customers under the factor score."""
    rows = M.factor_columns(jobs.factor_rows(s, s.saved_train))
    return rounded(rows.select("score", (F.col("repeater") == "t").cast("int").alias("actual")), ["score"], 6)


@query
def cumulative_tp_fp(s):
    return V.cumulative(_scored(s)).select("score", "tp", "fp")


@query
def sorted_lists(s):
    return rounded(K.ordered(K.calibrate(jobs.labelled_clusters(s, s.saved_train))), ["frac_repeater"], 6)


@query
def time_ordered_split(s):
    return W.time_ordered_split(s.history_train).select("id", "offerdate", "part")


# ---- set operations

@query
def union_train_test(s):
    return J.stack(s.history_train, s.history_test)


@query
def union_classes(s):
    rows = s.saved_train.select("id", "offer", "repeater")
    return rows.where("repeater = 't'").unionByName(rows.where("repeater = 'f'"))


@query
def union_keys(s):
    items = _offered(s).select(C.item_ccb().alias("item"), "repeater")
    return J.union_keys(items.where("repeater = 't'").select("item"), items.where("repeater = 'f'").select("item"))


@query
def except_ids(s):
    return J.ids_without(s.history_test, s.reduced)


# ---- statistics

@query
def entropy_importance(s):
    return rounded(S.entropy_importance(_offered(s)), ["entropy", "normalized"])


@query
def chi_square(s):
    return rounded(S.chi_square(_offered(s)), ["statistic"])


@query
def chi_pvalue(s):
    """Both p-values, and beside them that they are probabilities and that the trips, which decide the label, leave nothing to chance."""
    p, q = F.col("p_value"), F.col("p_simulated")
    return S.chi_pvalue(_offered(s)).withColumns({
        "in_range": p.between(0, 1) & q.between(0, 1),
        "trips_decide": (F.col("feature") != "repeattrips") | (F.greatest(p, q) < 0.001)})


@query
def chi_residuals(s):
    return rounded(S.chi_residuals(_offered(s)), ["residual"])


@query
def bayes_rollup(s):
    return B.rollup(s.history_train)


@query
def bayes_shrink(s):
    return rounded(B.shrink(s.saved_train), ["p_raw", "p"], 6)


@query
def nb_item(s):
    return rounded(B.item_probabilities(_offered(s)), ["p_repeat"], 6)


@query
def nb_score(s):
    customers = J.stack(s.saved_train.select(F.lit("train").alias("part"), "id", "offer"),
                        s.history_test.select(F.lit("test").alias("part"), "id", "offer"))
    scored = B.score_items(customers.join(s.offers, "offer"), _offered(s))
    return rounded(scored.select("part", "id", "p_repeat"), ["p_repeat"], 6)


@query
def dependence_pairs(s):
    rows = _offered(s).withColumn("item", C.item_cat_brand())
    return rounded(S.dependence_pairs(rows), ["mutual_information"], 6)


# ---- evaluation

@query
def roc_curve(s):
    return rounded(V.roc_curve(_scored(s)), ["tpr", "fpr", "precision", "recall", "f_score"])


@query
def auroc(s):
    scored = B.score_items(_offered(s), _offered(s))
    item_scores = scored.select(F.lit("item").alias("model"), F.round("p_repeat", 6).alias("score"),
                                (F.col("repeater") == "t").cast("int").alias("actual"))
    both = _scored(s).select(F.lit("factors").alias("model"), "*").unionByName(item_scores)
    return rounded(V.auroc(both, ["model"]), ["auroc"], 6)


@query
def auc_bootstrap(s):
    """The area of every resample, and that of the rows themselves."""
    scored = materialise(_scored(s), "scored")
    return V.auc_bootstrap(scored).withColumn("win_rate", V.win_rate(scored).scalar())


def _pairs(s):
    """Observed (u_id, v_id): the customer's vector and a vector drawn from the key of an item they bought."""
    h = s.half_vectors()
    return s.transactions.select(
        (2 * F.pmod("id", h)).alias("u_id"), (2 * F.pmod(C.hash_digits(C.item_ccb()), h) + 1).alias("v_id")).distinct()


_STATS = ["mean_data", "mean_sim", "mean_cross", "mean_model", "mean_ratio", "rms", "tp", "tn", "fp", "fn",
          "precision", "recall", "fallout", "fscore"]


@query
def confusion_at_threshold(s):
    return rounded(V.confusion(_pairs(s), s.user_factors, s.item_factors, [0.1]), ["threshold", *_STATS], 6)


@query
def threshold_sweep(s):
    return rounded(V.confusion(_pairs(s), s.user_factors, s.item_factors, THRESHOLDS), ["threshold", *_STATS], 6)


@query
def sparse_threshold_stats(s):
    columns = ["threshold", "mean_data", "mean_sim", "mean_cross"]
    stats = V.sparse_threshold_stats(_pairs(s), s.user_factors, s.item_factors, [0.1])
    return rounded(stats.select(columns), columns, 6)


# ---- encoding

@query
def minmax_scale(s):
    train, test = jobs.model_frames(s)
    scaled = N.minmax_scale(J.stack(train.drop("label"), test), N.CONTINUOUS)
    return rounded(scaled.select("id", *N.CONTINUOUS), N.CONTINUOUS, 6)


@query
def one_hot(s):
    """The slot of each value that is on, -1 for a value the train rows don't have."""
    train, test = jobs.model_frames(s)
    fitted = Pipeline(stages=N.one_hot(N.CATEGORICAL)).fit(train)
    rows = fitted.transform(J.stack(train.drop("label"), test))
    on = lambda c: F.try_element_at(N.vector_entries(f"{c}_hot")["entries"], F.lit(1))["index"]
    return rows.select("id", *[F.coalesce(on(c), F.lit(-1)).cast("bigint").alias(f"{c}_slot") for c in N.CATEGORICAL])


@query
def interact_hash(s):
    train, test = jobs.model_frames(s)
    rows = N.interactions(J.stack(train.drop("label"), test))
    return rows.select("id", *N.interaction_columns())


@query
def assemble(s):
    """The feature vector as text: the slots that are on, and the scaled values."""
    train, test = jobs.model_frames(s)
    (train_x, test_x), _ = L.encoded(train, test)
    rows = J.stack(train_x, test_x).select("id", "label", N.vector_entries("features").alias("x")).select("id", "label", "x.*")
    n = len(N.CONTINUOUS)
    slots = F.transform(F.filter("entries", lambda e: (e["value"] == 1.0) & (e["index"] < F.col("size") - n)), lambda e: e["index"])
    value = lambda i: F.try_element_at(F.filter("entries", lambda e: e["index"] == F.col("size") - n + i), F.lit(1))["value"]
    scaled = [F.coalesce(value(i), F.lit(0.0)).alias(c) for i, c in enumerate(N.CONTINUOUS)]
    return rounded(rows.select("id", "label", F.array_join(slots.cast("array<string>"), ",").alias("slots"), F.col("size").alias("n_features"), *scaled), N.CONTINUOUS, 6)


@query
def model_frame(s):
    train, _ = jobs.model_frames(s)
    return N.sorted_frame(train)


@query
def balance_classes(s):
    return W.balanced(s.saved_train).select("id", "repeater", "shuffle_key")


# ---- models

def _encoded(s):
    return L.encoded(*jobs.model_frames(s))


def _model_query(name):
    def run(s):
        """Scored test customers, and whether the fit ranks its own rows at least as well as chance."""
        (train, test), _ = _encoded(s)
        model = L.classifiers()[name].fit(train)
        own = L.scores(model, train, "label").select("score", F.col("label").cast("int").alias("actual"))
        learned = (V.auroc(materialise(own, "own-scores")).first()["auroc"] or 0.0) >= 0.5
        return L.scores(model, test).withColumns({"in_range": F.col("score").between(0, 1), "learned": F.lit(learned)})

    return run


for _name in ("logistic", "gaussian_nb"):
    _QUERIES[f"ml_{_name}"] = _model_query(_name)


@query
def ml_svc(s):
    """Margins of the kernel classifier."""
    train, test = jobs.model_frames(s)
    rows, others = (KC.sparse_rows(f) for f in KC.scaled(train, test))
    model, gamma = KC.fit(rows)
    return KC.margins(model, others, gamma=gamma)


@query
def ml_extra_trees(s):
    train, test = (T_.coded(f) for f in jobs.model_frames(s))
    return T_.forest_scores(T_.extra_trees(train, N.CODED), test, N.CODED)


@query
def ml_boosting(s):
    train, test = (T_.coded(f) for f in jobs.model_frames(s))
    return T_.boosted_scores(T_.boost(train, N.CODED), test)


@query
def grid_search_c(s):
    (train, _), _ = _encoded(s)
    return L.grid_search_c(train)


@query
def cv_auc(s):
    """Eight loops with the strength that the grid found best."""
    (train, _), _ = _encoded(s)
    best = L.grid_search_c(train).where("best").first()["c"]
    return L.cv_auc(L.logistic(best, train.count()), train, loops=8).withColumn("c", F.lit(best))


def _examples(s):
    """Hashed vectors of the exported lines, with the offer date."""
    table = materialise(jobs.priced_features(s), "features")
    path = scratch_path(s.spark, "lines")
    sinks.write_lines(sinks.sparse_lines(table), path)
    vectors = sparse_lines.lines_as_vectors(sparse_lines.read_lines(s.spark, path))
    return materialise(vectors.join(table.select("id", "offer_date"), "id"), "examples")


@query
def src_sparse_lines(s):
    """Exported lines read back as typed columns."""
    table = materialise(jobs.priced_features(s), "features")
    path = scratch_path(s.spark, "lines")
    sinks.write_lines(sinks.sparse_lines(table), path)
    fields = [f for f in table.schema if f.name not in ("id", "label", *sinks.NOT_EXPORTED)]
    back = sparse_lines.lines_as_table(sparse_lines.read_lines(s.spark, path), T.StructType(fields))
    return back.select("id", "label", *[f.name for f in fields])


@query
def ml_quantile_linear(s):
    """The online learner on early offers, scored on the late ones."""
    rows = _examples(s).where("label <> 0.5")
    early = C.is_early("offer_date", CUTOFF)
    model, _ = Q.fit(rows.where(early))
    late = rows.where(~early)
    return Q.predict(model, late).join(late.select("id", "label"), "id")


@query
def quantile_submission(s):
    """The online learner on all train rows, scored on the test rows and read back from the submission."""
    rows = _examples(s)
    model, _ = Q.fit(rows.where("label <> 0.5"))
    path = scratch_path(s.spark, "submission")
    sinks.write_csv(sinks.submission(Q.predict(model, rows.where("label = 0.5"))), path)
    return files.read_csv(s.spark, path, T.StructType.fromDDL("id long, repeatProbability double"))


@query
def feature_importances(s):
    train, _ = jobs.model_frames(s)
    part = T_.coded(W.time_ordered_split(train).where("part = 'train'"))
    found = T_.column_importances(T_.extra_trees(part, N.CODED), [*N.CATEGORICAL, *N.CONTINUOUS])
    return s.spark.createDataFrame(list(found.items()), "feature string, importance double").orderBy(F.desc("importance"), "feature")


@query
def topk_features(s):
    (train, _), names = _encoded(s)
    rows = materialise(L.extreme_weights(L.coefficients(L.classifiers()["logistic"].fit(train), names, s.spark)), "weights")
    lowest = rows.where("side = 'top'").agg(F.max("weight")).scalar()
    facts = rows.groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("feature").alias("n_features"), F.max(F.col("weight") <= lowest).alias("below_the_top"))
    return rows.join(facts, "side")


@query
def fit_predict_submit(s):
    (train, test), _ = _encoded(s)
    scored = L.fit_and_score(L.classifiers()["logistic"], train, test)
    path = scratch_path(s.spark, "submission")
    sinks.write_csv(J.scores_or_zero(s.history_test, scored).orderBy("id"), path)
    back = files.read_csv(s.spark, path, T.StructType.fromDDL("id long, repeatProbability double"))
    return back.withColumn("in_range", F.col("repeatProbability").between(0, 1))


# ---- factorization and clusters

@query
def als_implicit(s):
    """Factors of customers and items under one ridge for all."""
    users, items = G.weighted_factors(M.value_cutoff(M.pair_counts(s.transactions)))
    return users.select(F.lit("user").alias("side"), "*").unionByName(items.select(F.lit("item").alias("side"), "*"))


@query
def als_explicit(s):
    """Held-out ratings next to their predictions."""
    quantities = s.reduced.groupBy("id", "brand").agg(F.avg("purchasequantity").alias("rating"))
    ratings = M.numbered(quantities, ["brand"]).select("user_idx", "item_idx", "rating")
    return M.als_explicit(ratings)


def _mf(s):
    return [f"MF{i}" for i in range(s.dim)]


@query
def mf_features(s):
    rows = M.factor_columns(jobs.factor_rows(s, s.history_base), s.dim)
    return rounded(rows.select("id", "unknown", *_mf(s)), _mf(s), 6)


@query
def mf_super_features(s):
    rows = M.super_features(jobs.factor_rows(s, s.history_base))
    return rows.select("id", F.concat_ws(",", F.transform("super", C.fixed6)).alias("super_features"))


@query
def mf_add_columns(s):
    rows = M.factor_columns(jobs.factor_rows(s, s.history_base), s.dim)
    return rows.select("id", "offer", *[C.fixed6(c).alias(c) for c in (*_mf(s), "score")])


@query
def mf_score_train(s):
    return rounded(M.clamped_scores(jobs.factor_rows(s, s.history_train)), ["score"], 6)


@query
def kmeans_fit_assign(s):
    return K.fit_assign(M.products(jobs.fitted_factor_rows(s, s.history_base)))


@query
def factor_job(s):
    """The whole job: factorize, cluster, calibrate, rate; one row per customer, a probability for test rows only."""
    return jobs.cluster_job(s)


@query
def kmeans_calibrate(s):
    return rounded(K.calibrate(jobs.labelled_clusters(s, s.history_train)), ["frac_repeater"], 6)


@query
def kmeans_random_control(s):
    rows = jobs.labelled_clusters(s, s.saved_train).select("id", "cluster", "repeater")
    return rounded(K.random_control(rows), ["frac_repeater"], 6)


@query
def cluster_error(s):
    rows = K.with_error(K.calibrate(jobs.labelled_clusters(s, s.history_train)))
    return rounded(rows.select("cluster", "frac_repeat", "frac_err"), ["frac_repeat", "frac_err"], 6)


@query
def cluster_score_roc(s):
    rows = jobs.labelled_clusters(s, s.saved_train)
    scored = rounded(K.cluster_scores(rows, K.calibrate(rows)), ["score"], 6)
    return rounded(V.roc_curve(scored), ["tpr", "fpr", "precision", "recall", "f_score"])


@query
def cluster_outputs(s):
    train = jobs.labelled_clusters(s, s.saved_train)
    rows = K.outputs(train, jobs.labelled_clusters(s, s.history_test), K.calibrate(train))
    return rounded(rows, ["frac_repeater", "repeatProbability"])
