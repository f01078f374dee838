"""Reader of exported sparse lines, ``label 'id |f name:value name:value``.

The lines are read with Spark's text source, so files are split and any file system Spark knows will do, and parsed with built-in
functions. ``lines_as_table`` gives typed columns again, ``lines_as_vectors`` hashed sparse vectors for the learner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``id, label, features``: the id behind the quote, the number in front, and (name, value) pairs of text in the order of the line.

    A feature without a value has the value 1, as the format says. A bar at the end and repeated spaces are ignored, an empty
    label is NULL, and an empty line is no row.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    head, rest = F.split("value", r"\|", 2)[0], F.regexp_replace(F.try_element_at(F.split("value", r"\|", 2), F.lit(2)), r"\|\s*$", "")
    # The name space is the word that touches the bar.
    words = F.filter(F.split(F.regexp_replace(F.coalesce(rest, F.lit("")), r"^\S*", ""), r"\s+"), lambda w: w != "")
    pairs = F.transform(words, lambda w: F.struct(
        F.substring_index(w, ":", 1).alias("name"),
        F.when(F.instr(w, ":") > 0, F.substring(w, F.instr(w, ":") + 1, F.length(w))).otherwise("1").alias("value")))
    return lines.select(
        F.regexp_extract(head, r"'(\S*)", 1).try_cast("bigint").alias("id"),
        F.regexp_extract(head, r"^\s*([^\s']+)", 1).try_cast("double").alias("label"), pairs.alias("features"))


def lines_as_table(rows: DataFrame, fields: T.StructType) -> DataFrame:
    """``id, label`` and a typed column per field; a feature that the line lacks is NULL, the first of repeated ones counts."""
    def column(f: T.StructField) -> Column:
        of_name = F.filter("features", lambda x: x["name"] == f.name)
        return F.try_element_at(of_name, F.lit(1))["value"].try_cast(f.dataType).alias(f.name)

    return rows.select("id", "label", *[column(f) for f in fields])


def lines_as_vectors(rows: DataFrame, bits: int = 18) -> DataFrame:
    """``id, label, slots, values``: features hashed into 2^bits slots, in order of the slot, with a constant 1.

    A number is the value of its name's slot. Any other text is a category: the slot of ``name=value`` has 1. Features that fall
    into one slot add up, zeros are left out.
    """
    def slot(text: Column) -> Column:
        return F.pmod(F.xxhash64(text), F.lit(1 << bits)).cast("int")

    def entry(x: Column) -> Column:
        number = x["value"].try_cast("double")
        usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
        return F.struct(F.when(usable, slot(x["name"])).otherwise(slot(F.concat(x["name"], F.lit("="), x["value"]))).alias("slot"),
                        F.when(usable, number).otherwise(1.0).alias("value"))

    constant = F.struct(slot(F.lit("Constant")).alias("slot"), F.lit(1.0).alias("value"))
    entries = F.filter(F.concat(F.transform("features", entry), F.array(constant)), lambda e: e["value"] != 0)
    slots = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["slot"])))

    def total(s: Column) -> Column:
        return F.aggregate(F.filter("entries", lambda e: e["slot"] == s), F.lit(0.0), lambda sum_, e: sum_ + e["value"])

    # Where no two features share a slot there is nothing to add up.
    apart = F.transform(F.array_sort("entries"), lambda e: e["value"])
    values = F.when(F.size("slots") == F.size("entries"), apart).otherwise(F.transform("slots", total))
    return rows.select("id", "label", entries.alias("entries"), slots.alias("slots")).select("id", "label", "slots", values.alias("values"))
