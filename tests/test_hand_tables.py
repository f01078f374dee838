"""Small tables with results worked out by hand."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from patronage.functions import columns as C
from patronage.operators import bayes, evaluate, features, order_stats, stats, visits
from patronage.sources import files, sinks


def day(text):
    return datetime.date.fromisoformat(text)


def test_recency_bins(spark):
    dates = ["2013-04-01", "2013-03-03", "2013-03-02", "2012-10-03", "2011-01-01", "2013-04-05"]
    df = spark.createDataFrame([(day("2013-04-01"), day(d)) for d in dates], "offer date, d date")
    got = [r[0] for r in df.select(C.recency_bin(C.diff_days("offer", "d"))).collect()]
    assert got == [0, 0, 1, 4, 4, None]


TXN = ("id long, chain int, dept int, category int, company int, brand int, date date, "
       "purchasequantity int, purchaseamount double, txn_seq long")


def one_customer(spark, rows):
    txns = spark.createDataFrame(
        [(1, 7, dept, cat, comp, brand, day(d), q, a, i)
         for i, (dept, cat, comp, brand, d, q, a) in enumerate(rows)], TXN)
    history = spark.createDataFrame([(1, 7, 100, 3, day("2013-04-01"))], "id long, chain int, offer long, market int, offerdate date")
    offers = spark.createDataFrame([(100, 10, 1, 20, 1.5, 30)], "offer long, category int, quantity int, company int, offervalue double, brand int")
    return txns, history, offers


def test_dept_counts_only_rows_after_the_first_full_match(spark):
    d = "2013-03-20"
    txns, history, offers = one_customer(spark, [
        (5, 1, 1, 1, d, 1, 1.0), (5, 10, 20, 30, d, 1, 2.0), (5, 1, 1, 1, d, 2, 4.0), (6, 1, 1, 1, d, 1, 8.0)])
    row = features.buy_history_dept(txns, history, offers).first()
    assert row["has_bought_dept"] == 1.0
    assert row["has_bought_dept_q"] == 2
    assert row["has_bought_dept_a_30"] == 4.0


def test_returns_count_with_their_sign(spark):
    txns, history, offers = one_customer(spark, [
        (5, 10, 9, 9, "2013-03-20", 2, 5.0), (5, 10, 9, 9, "2012-03-20", -1, -3.0)])
    row = features.buy_history(txns, history, offers).first()
    assert (row["has_bought_category"], row["has_bought_category_q"], row["has_bought_category_a"]) == (2.0, 1, 2.0)
    assert (row["has_bought_category_30"], row["has_bought_category_q_30"]) == (1.0, 2)
    assert row["has_bought_brand"] is None
    flags = features.with_flags(features.buy_history(txns, history, offers).withColumn(
        "has_bought_dept", F.lit(None).cast("double"))).first()
    assert flags["never_bought_brand"] == 1 and flags["never_bought_category"] is None


def test_trip_gaps(spark):
    rows = [(1, "2013-01-01"), (1, "2013-01-01"), (1, "2013-01-11"), (1, "2013-02-20"), (1, "2013-2-1"),
            (2, "2013-01-01"), (2, "2013-01-05")]
    df = spark.createDataFrame(rows, "id long, date string")
    got = visits.trip_gaps(visits.valid_dates(df, "date")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["id"], r["mean_gap"], r["sd_gap"], r["min_gap"], r["max_gap"], r["n_trips"], r["n_long_gaps"]) == (
        1, 25.0, 15.0, 10, 40, 3, 1)
    assert r["long_ratio"] == pytest.approx(1 / 3)
    audit = visits.date_audit(df, "date").first()
    assert (audit["n_valid"], audit["n_bad_dates"]) == (6, 1)


def test_entropy(spark):
    df = spark.createDataFrame([("a", "t"), ("a", "f"), ("b", "f"), ("c", "t")], "x string, repeater string")
    r = stats.entropy_importance(df, ["x"]).first()
    assert r["entropy"] == pytest.approx(0.693147, abs=1e-6)
    assert r["normalized"] == pytest.approx(0.231049, abs=1e-6)


def test_roc_and_auroc_with_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "score double, actual int")
    points = [(r["fpr"], r["tpr"]) for r in evaluate.roc_curve(df).orderBy(F.desc("score")).collect()]
    assert points == [(0.0, 0.5), (0.5, 1.0), (1.0, 1.0)]
    assert evaluate.auroc(df).first()["auroc"] == pytest.approx(0.875)


def test_shrinkage(spark):
    rows = [("x", "t")] * 8 + [("x", "f")] * 2 + [("y", "t")] * 32 + [("y", "f")] * 58
    df = spark.createDataFrame(rows, "offer string, repeater string")
    p = {(r["depth"], r["offer"]): r["p"] for r in bayes.shrink(df, ["offer"]).collect()}
    assert p[(0, None)] == pytest.approx(0.375)
    assert p[(1, "x")] == pytest.approx(0.490909, abs=1e-6)


def test_rows_with_a_missing_level_are_bad(spark):
    df = spark.createDataFrame([("x", "t"), (None, "t")], "offer string, repeater string")
    assert bayes.bad_rows(df, ["offer"]).first()["n_bad"] == 1
    assert bayes.rollup(df, ["offer"]).where("depth = 0").first()["n"] == 1


def test_item_classifier(spark):
    rows = [(1, "t")] * 6 + [(1, "f")] * 2 + [(2, "t")] * 4 + [(2, "f")] * 8
    df = spark.createDataFrame([(c, 0, 0, r) for c, r in rows], "category int, company int, brand int, repeater string")
    p = {r["item"]: r["p_repeat"] for r in bayes.item_probabilities(df).collect()}
    assert p["1_0_0"] == pytest.approx(0.34375)
    new = spark.createDataFrame([(9, 0, 0)], "category int, company int, brand int")
    assert bayes.score_items(new, df).first()["p_repeat"] == pytest.approx(0.25)


def test_trimmed_mean(spark):
    df = spark.createDataFrame([(1, float(x)) for x in [*range(1, 20), 1000]], "k int, x double")
    assert order_stats.trimmed_mean(df, ["k"], "x", 0.05, "m").first()["m"] == pytest.approx(10.5)


def test_chi_square_of_the_label_against_itself_is_n(spark):
    df = spark.createDataFrame([(0, "f")] * 7 + [(1, "t")] * 3 + [(2, "t")] * 2, "repeattrips int, repeater string")
    r = stats.chi_square(df, ["repeattrips"]).first()
    assert r["statistic"] == pytest.approx(12.0)
    assert r["df"] == 2


def test_scaling(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (7.0,), (100.0,), (-5.0,)], "x double")
    got = [tuple(r) for r in df.select(C.log_scale("x"), C.log_scale_capped("x")).collect()]
    assert got[0] == (0.0, 0.0)
    assert got[1] == (pytest.approx(1.0), 1.0)
    assert got[2] == (pytest.approx(3.0), 3.0)
    assert got[3] == (pytest.approx(math.log2(101)), 3.0)
    assert got[4] == (0.0, 0.0)


def test_clean_number(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (2.5,)], "x double")
    assert [r[0] for r in df.select(C.clean_number("x")).collect()] == [0.0, 0.0, 0.0, 0.0, 2.5]


def test_item_sku_needs_both_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "category int, brand int, company int, chain int")
    assert C.item_sku(df) is None


def test_catalog_paths():
    assert files.data_path("/data/", "history") == "/data/trainHistory.csv"
    assert files.data_path("/data", "transactions", 7) == "/data/transactions_7.csv"


def test_exported_lines_and_labels(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1.0, 11, 2.5, None, "a b", 3), (0.5, 12, None, 4, "c", 5)],
        "label double, id long, z double, a int, m string, item_id int")
    lines = sinks.sparse_lines(rows)
    assert {r["id"]: r["line"] for r in lines.collect()} == {
        11: "1 '11 |f m:a_b z:2.500000", 12: "0.5 '12 |f a:4 m:c"}
    sinks.labels_of_lines(lines).write.csv(str(tmp_path / "labels"))
    got = {r["id"]: r["label"] for r in files.read_labels(spark, str(tmp_path / "labels")).collect()}
    assert got == {11: 1.0, 12: 0.5}
