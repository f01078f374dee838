"""Read schemas of the input tables, by column position."""

from pyspark.sql import types as T

TRANSACTIONS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("chain", T.IntegerType()),
    T.StructField("dept", T.IntegerType()),
    T.StructField("category", T.IntegerType()),
    T.StructField("company", T.LongType()),
    T.StructField("brand", T.IntegerType()),
    T.StructField("date", T.DateType()),
    T.StructField("productsize", T.DoubleType()),
    T.StructField("productmeasure", T.StringType()),
    T.StructField("purchasequantity", T.IntegerType()),
    T.StructField("purchaseamount", T.DoubleType()),
])

OFFERS = T.StructType([
    T.StructField("offer", T.LongType()),
    T.StructField("category", T.IntegerType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("company", T.LongType()),
    T.StructField("offervalue", T.DoubleType()),
    T.StructField("brand", T.IntegerType()),
])

HISTORY_TRAIN = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("chain", T.IntegerType()),
    T.StructField("offer", T.LongType()),
    T.StructField("market", T.IntegerType()),
    T.StructField("repeattrips", T.IntegerType()),
    T.StructField("repeater", T.StringType()),
    T.StructField("offerdate", T.DateType()),
])

HISTORY_TEST = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("chain", T.IntegerType()),
    T.StructField("offer", T.LongType()),
    T.StructField("market", T.IntegerType()),
    T.StructField("offerdate", T.DateType()),
])

TRIPLES = T.StructType([
    T.StructField("user_idx", T.IntegerType()),
    T.StructField("item_idx", T.IntegerType()),
    T.StructField("value", T.DoubleType()),
])

PREDICTIONS = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("id", T.LongType()),
])

LABELS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("label", T.DoubleType()),
])


def retyped(schema: T.StructType, **types: T.DataType) -> T.StructType:
    """``schema`` with the type of some columns replaced (coded columns may be text)."""
    return T.StructType([
        T.StructField(f.name, types.get(f.name, f.dataType), f.nullable) for f in schema
    ])
