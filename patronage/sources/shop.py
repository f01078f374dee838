"""The loyalty tables, derived from the star-schema Parquet files of a data folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure, materialise

_BASE = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "embeddings": "vec_id long, embedding array<float>, label int",
}

FIRST_OFFER_DATE = "2000-01-01"
CUTOFF = "2000-02-01"
# A customer's offer is part OFFER_STEP * (id mod number of parts / PARTS_PER_OFFER).
PARTS_PER_OFFER, OFFER_STEP = 20, 19
# So many customer and item keys have no vector.
UNKNOWN_KEYS = 10


class Shop:
    """Lazy views over one data folder; every attribute is a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str, input_bytes: int | None = None):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        configure(spark, self._bytes("lineitem") + self._bytes("orders") if input_bytes is None else input_bytes)

    def _bytes(self, name: str) -> int:
        """Size of a table as the optimizer knows it from the files."""
        return int(str(self.base(name)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def base(self, name: str) -> DataFrame:
        return self.spark.read.schema(_BASE[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def history_base(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.base("customer").select(
            key.alias("id"),
            F.col("c_nationkey").alias("chain"),
            (F.pmod(key, self._offered_parts()) * OFFER_STEP).alias("offer"),
            F.col("c_mktsegment").alias("market"),
            F.date_add(F.lit(FIRST_OFFER_DATE).cast("date"), F.pmod(key, F.lit(60)).cast("int")).alias("offerdate"),
        )

    def _offered_parts(self):
        """One part in twenty is given to customers, as a scalar subquery: the offers in use grow with the table."""
        return self.base("part").agg(F.floor(F.count(F.lit(1)) / PARTS_PER_OFFER)).scalar()

    @cached_property
    def offers(self) -> DataFrame:
        """Every part is an offer. Some categories and brands are new, so nobody has bought them yet."""
        category, brand = F.col("p_type"), F.col("p_brand")
        return self.base("part").select(
            F.col("p_partkey").alias("offer"),
            F.when(category.startswith("S"), F.concat(F.lit("NEW "), category)).otherwise(category).alias("category"),
            F.lit(1).alias("quantity"),
            F.pmod("p_partkey", F.lit(6)).cast("int").alias("company"),
            (F.col("p_size") / F.lit(25.0)).cast("double").alias("offervalue"),
            F.when(brand.like("Brand#2_"), F.concat(F.lit("NEW "), brand)).otherwise(brand).alias("brand"),
        )

    def _baskets(self, orders: DataFrame) -> DataFrame:
        """Lines of ``orders`` (o_orderkey, o_custkey, date) in the transaction layout."""
        return (
            self.base("lineitem")
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.base("part"), F.col("l_partkey") == F.col("p_partkey"))
            .join(self.base("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                F.col("o_custkey").alias("id"),
                F.col("s_nationkey").alias("chain"),
                F.floor((F.col("p_size") - 1) / 10).cast("int").alias("dept"),
                F.col("p_type").alias("category"),
                F.pmod("l_suppkey", F.lit(8)).cast("int").alias("company"),
                F.col("p_brand").alias("brand"),
                "date",
                F.col("p_size").alias("productsize"),
                F.col("l_linestatus").alias("productmeasure"),
                F.col("l_quantity").cast("int").alias("purchasequantity"),
                (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast(T.DecimalType(18, 4)).alias("purchaseamount"),
                (F.col("l_orderkey") * 10000000 + F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("txn_seq"),
            )
        )

    @cached_property
    def _orders(self) -> DataFrame:
        return self.base("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("date"))

    @cached_property
    def transactions_all(self) -> DataFrame:
        return self._baskets(self._orders)

    @cached_property
    def transactions(self) -> DataFrame:
        """Rows before the customer's offer; the orders are cut before they meet the lines."""
        before = self._orders.join(
            self.history_base.select("id", "offerdate"),
            (F.col("o_custkey") == F.col("id")) & (F.col("date") < F.col("offerdate")),
        ).select("o_orderkey", "o_custkey", "date")
        return self._baskets(before)

    @cached_property
    def history(self) -> DataFrame:
        redeemed = self.history_base.join(self.offers.select("offer", "category"), "offer").select(
            F.col("id").alias("h_id"), "offerdate", F.col("category").alias("h_category"))
        # Orders and offers first: only lines of customers with an offer, from the offer date on.
        after = self._orders.join(
            redeemed, (F.col("o_custkey") == F.col("h_id")) & (F.col("date") >= F.col("offerdate")))
        lines = (
            self.base("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
            .join(after, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.base("part").select("p_partkey", "p_type"),
                  (F.col("l_partkey") == F.col("p_partkey")) & (F.col("p_type") == F.col("h_category")))
            .join(self.base("supplier").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
        )
        trips = lines.groupBy("h_id").agg(F.countDistinct("date").alias("n")).withColumnRenamed("h_id", "id")
        return self.history_base.join(trips, "id", "left").select(
            "id", "chain", "offer", "market",
            F.coalesce("n", F.lit(0)).alias("repeattrips"),
            F.when(F.coalesce("n", F.lit(0)) > 0, "t").otherwise("f").alias("repeater"),
            "offerdate",
        )

    @cached_property
    def history_train(self) -> DataFrame:
        return self.history.where("pmod(id, 3) <> 0")

    @cached_property
    def saved_train(self) -> DataFrame:
        """``history_train`` written once, for jobs that read it more than once."""
        return materialise(self.history_train, "history_train")

    @cached_property
    def history_test(self) -> DataFrame:
        return self.history_base.where("pmod(id, 3) = 0").select("id", "chain", "offer", "market", "offerdate")

    @cached_property
    def reduced(self) -> DataFrame:
        return self.transactions.join(self.offers.select("category").distinct(), "category", "left_semi").select(
            self.transactions.columns)

    @cached_property
    def vectors(self) -> DataFrame:
        """(vec_id, features, label): every embedding, whole."""
        return self.base("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")

    @cached_property
    def dim(self) -> int:
        """Length of the vectors, for queries with a column per value."""
        row = self.vectors.select(F.size("features")).first()
        return row[0] if row else 0

    @cached_property
    def user_factors(self) -> DataFrame:
        return self.vectors.where("vec_id % 2 = 0")

    @cached_property
    def item_factors(self) -> DataFrame:
        return self.vectors.where("vec_id % 2 = 1")

    def half_vectors(self):
        """n / 2 of the embeddings, as a scalar subquery."""
        return self.base("embeddings").agg(F.floor(F.count(F.lit(1)) / 2).alias("h")).scalar()
