"""Mix sources to target weights: equal blocks of words by highest Sainte-Laguë quotients, then a seeded choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved, text_or_empty

BLOCK_WORDS = 64
SHARD_WORDS = 1 << 16
SHARDS = 1 << 16


def word_count(column) -> F.Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("bigint")


def _dealt(seed: int, id_col: str, text_col: str, source_col: str) -> F.Column:
    return F.xxhash64(F.lit(seed), F.col(id_col).cast("bigint"), F.col(text_col).cast("string"), F.col(source_col).cast("string"))


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """``target`` of each source of (source, source_size).

    Sources take the weights in turn, in code point order with null last. The targets share ``share`` times all words by
    weight; a target stops at ``most`` times its source and the excess is shared again. Sorted by stop over weight,
    a source stops if its stop is at most what the weights of it and all later ones would give it.
    One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    out = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    out = out.withColumn("stop", F.col("source_size") * F.lit(float(most)))
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    out = out.withColumn("level", left / weight_left).withColumn("stops", F.col("stop") <= F.col("level") * F.col("weight"))
    # The first source that does not stop sets the level of all that follow.
    level = F.min(F.when(~F.col("stops"), F.struct(F.col("stop") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(everything)
    target = F.when(F.col("stops"), F.col("stop")).otherwise(level["level"] * F.col("weight"))
    return out.withColumn("target", F.least(target, F.col("stop"))).select("source", "source_size", "target")


def apportion(parts: DataFrame, group: list[str], seats: str, weight: str, most: str, name: str, tie: list[F.Column]) -> DataFrame:
    """Sainte-Laguë: in each group, ``seats`` go one by one to the highest quotient weight / (2 seats held + 1).

    Quotients are offered only near a part's fair share: the last seat given has a quotient within n/2 seats of it (n parts),
    so a part can move by its share of n/2 seats and one. That makes about two quotients a part. A part takes at
    most ``most`` seats; what it cannot take goes to the next quotients.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy()
    total = F.sum(weight).over(whole)
    free = parts.withColumn("_all", total).withColumn("_n", F.count(F.lit(1)).over(whole))
    fair = F.when(F.col("_all") > 0, F.col(seats) * F.col(weight) / F.col("_all")).otherwise(F.lit(0.0))
    free = free.withColumn("_fair", fair)
    slack = F.col("_fair") * F.col("_n") / (2 * F.greatest(F.col(seats), F.lit(1))) + 2
    free = free.withColumn("_low", F.least(F.greatest(F.floor(F.col("_fair") - slack), F.lit(0)), F.col(most)).cast("bigint"))
    free = free.withColumn("_high", F.least(F.ceil(F.col("_fair") + 2 * slack + 2), F.col(most)).cast("bigint"))
    free = free.withColumn("_left", F.col(seats) - F.sum("_low").over(whole))
    offers = free.where((F.col("_high") > F.col("_low")) & (F.col(weight) > 0)).withColumn("_seat", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))))
    order = Window.partitionBy(*group) if group else Window.partitionBy()
    offers = offers.withColumn("_rank", F.row_number().over(order.orderBy((F.col(weight) / (2 * F.col("_seat") - 1)).desc(), *tie, "_seat")))
    keys = [c for c in parts.columns]
    won = offers.where(F.col("_rank") <= F.col("_left")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    same = F.lit(True)
    a, b = free.alias("a"), won.alias("b")
    for c in keys:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same, "left").select(*[F.col(f"a.{c}") for c in keys], (F.col("a._low") + F.coalesce(F.col("b._won"), F.lit(0))).alias(name))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17,
        block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, passes, from_word, to_word`` of every document.

    The words of a source are dealt into shards by a seeded hash and, in a shard, put in a seeded order of documents
    and cut into blocks of ``block_words``. Sources get blocks by highest quotients, shards get their source's blocks in the
    same way. A shard gives all of its blocks as often as its quota allows (``passes``) and then its first
    blocks, so that few documents are cut; of a document, the words [from_word, to_word) are taken once more. No document gives more
    than ``most`` times its words, and where that is no whole number the last pass takes that fraction of each.

    Only ids, sources and sizes are shuffled. There are at most ``SHARDS`` shards and one for each source more. Null and empty
    texts have no words and are never taken; null sources are one source, the last. Repeated rows count each
    by itself. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"), _dealt(seed, id_col, text_col, source_col).alias("dealt"))
    rows = saved(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    sizes = saved(sizes, "sources")
    goals = targets(sizes.select("source", "source_size"), weights, share, most)
    total, count = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("source_docs"), F.lit(0))).first()
    words, most_docs = max(SHARD_WORDS, total // SHARDS), max(SHARD_WORDS // 256, count // SHARDS)
    goals = goals.alias("g").join(sizes.alias("s"), F.col("g.source").eqNullSafe(F.col("s.source"))).select("g.*", "s.source_docs")
    goals = goals.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / words), F.ceil(F.col("source_docs") / most_docs)).cast("bigint"))
    goals = goals.withColumn("seats", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("bigint"))
    goals = goals.withColumn("offered", F.ceil(F.col("source_size") * most / block_words).cast("bigint"))
    goals = saved(apportion(goals, [], "seats", "target", "offered", "blocks", [F.col("source").asc_nulls_last()]), "quotas")

    dealt = rows.alias("r").join(goals.select("source", "shards").alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
    dealt = dealt.select("r.*", F.pmod(F.xxhash64("dealt", F.lit(seed)), F.col("shards")).alias("shard"))
    order = Window.partitionBy("source", "shard").orderBy("dealt", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = saved(dealt.withColumn("start", F.sum("size").over(order) - F.col("size")), "dealt")

    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    shards = shards.alias("s").join(goals.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.*", "g.source_size", "g.target", "g.blocks")
    # A shard offers its whole passes, and of one more the fraction that ``most`` leaves.
    whole_passes, fraction = int(most // 1), float(most % 1)
    shards = shards.withColumn("offered", (whole_passes * F.ceil(F.col("shard_size") / block_words) + F.ceil(F.col("shard_size") * fraction / block_words)).cast("bigint"))
    shards = apportion(shards, ["source"], "blocks", "shard_size", "offered", "quota", [F.col("shard")])
    whole = F.greatest(F.ceil(F.col("shard_size") / block_words), F.lit(1))
    shards = shards.select(
        "source", "shard", "source_size", "target", F.floor(F.col("quota") / whole).cast("bigint").alias("passes"),
        (F.pmod(F.col("quota"), whole) * block_words).cast("bigint").alias("until"))

    out = dealt.alias("d").join(shards.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.shard") == F.col("s.shard")))
    last = F.when(F.col("passes") >= whole_passes, F.lit(fraction)).otherwise(F.lit(1.0))  # of a document's words in its last pass
    more = F.greatest(F.lit(0), F.least(F.floor(F.col("size") * last), F.col("until") - F.floor(F.col("start") * last))).cast("bigint")
    out = out.select("d.doc_id", "d.source", "d.size", "s.source_size", "s.target", "s.passes", "s.until", "d.start", "d.dealt")
    return out.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + more).alias("taken"),
        "passes", F.lit(0).cast("bigint").alias("from_word"), more.alias("to_word"), "dealt")


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id",
                    text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars") -> DataFrame:
    """Rows of ``docs`` as the mix takes them, with all columns: a document once for each pass, and its first words for the rest.

    The words taken of a document are those of its rows. A document that the mix does not take has no row. The text of a shorter
    copy ends behind its last word; ``chars_col`` follows it. Repeated rows are matched one to one with what the mix says of them.
    """
    names = docs.columns
    plan = mix(docs, weights, share, most, seed, id_col=id_col, text_col=text_col, source_col=source_col).where("taken > 0")
    null_id = F.lit(-1 << 63)
    copy = Window.partitionBy("doc", "dealt")
    plan = plan.select(F.coalesce("doc_id", null_id).alias("doc"), "dealt", "passes", "to_word").withColumn("nth", F.row_number().over(copy.orderBy("passes", "to_word")))
    # The columns of the input go along as one, so their names meet none of these.
    keyed = docs.select(F.struct(*names).alias("row"), F.coalesce(F.col(id_col).cast("bigint"), null_id).alias("doc"), _dealt(seed, id_col, text_col, source_col).alias("dealt"))
    keyed = keyed.withColumn("nth", F.row_number().over(copy.orderBy("dealt")))
    copies = F.array_repeat(F.lit(None).cast("bigint"), F.col("passes").cast("int"))
    shorter = F.when(F.col("to_word") > 0, F.array("to_word")).otherwise(F.array().cast("array<bigint>"))
    taken = keyed.join(plan, ["doc", "dealt", "nth"]).select("row", F.explode(F.concat(copies, shorter)).alias("until"))
    # Split at each word's end, the first parts are the first words with what stands between them.
    text = F.col("row")[text_col]
    parts = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    part = F.array_join(F.slice(parts, 1, F.greatest(F.col("until"), F.lit(1)).cast("int")), "")
    taken = taken.withColumn("cut", F.when(F.col("until").isNull(), text).otherwise(part))
    changed = {text_col: F.col("cut")}
    if chars_col in names:
        changed[chars_col] = F.when(F.col("until").isNull(), F.col("row")[chars_col]).otherwise(F.length("cut"))
    return taken.select(*[changed.get(f.name, F.col("row")[f.name]).cast(f.dataType).alias(f.name) for f in docs.schema])
