"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

quality rules -> near copies -> repeated strings -> source mix -> packing. All but the last stage return the columns of
``documents``; every stage works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patronage.llm import mixing, near_copies, packing, quality, repeats
from patronage.llm.common import materialise, table
from patronage.llm.tokens import public_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go, and documents that fail the base rules or lost too much text; null and empty texts have too few words."""
    return quality.keep_clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the least id; of repeated rows one, and all with a null text."""
    return near_copies.keep_one(docs)


def string_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 256 bytes, about 45 words, that also start elsewhere are cut out; all documents stay.

    Null, empty and short texts stay as they are; ``n_chars`` follows a text that was cut.
    """
    return repeats.cut_repeats(docs, length=256)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole copies, and one shorter copy where a quota ends inside a document."""
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens; a null or empty text is one end token."""
    return packing.pack(docs, public_file(), window=1024)


STAGES = [
    ("quality rules", quality_rules),
    ("near copies", near_dedup),
    ("repeated strings", string_dedup),
    ("source mix", source_mix),
    ("packing", pack),
]

# Edit-similarity classes, byte strings across documents and tokenization are not for SQL; tests hold a brute-force version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
