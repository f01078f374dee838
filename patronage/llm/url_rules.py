"""URL rules by a sort-merge range join: prefixes become intervals of reversed-host keys, swept in key order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# No byte of UTF-8: the first ends a host in a key, the second lies behind all keys with a given prefix.
HOST_END, BEHIND = b"\xfe", b"\xff"
START, PAGE, END = 0, 1, 2


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    host = F.encode(F.array_join(F.reverse(labels), "."), "UTF-8")
    return F.concat(host, F.lit(HOST_END), F.encode(path, "UTF-8"))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """``verdict, host, path`` rows."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    if not rows:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("verdict", "host", "path")])
    return spark.range(1).select(F.inline(F.array(*rows)))


def apply_rules(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``: the longest rule that fits, else null and ``default``.

    A rule fits its host and all subdomains if the path starts with the rule's. Longest means host and path
    together, then more host labels. Of equal rules, ``block`` holds. A rule with a null part fits nothing.

    Keys are the reversed host, an end mark and the path. A page has one key for each number of host labels that
    rules have, so a rule covers an interval of keys, and the intervals are nested or apart. Distinct (host, path)
    are dealt evenly into cells with a copy of the rules each; no host or prefix can make a cell large. In a cell one
    sorted sweep over interval starts, pages and interval ends keeps the height of the stack of open rules, and the top
    of the stack is the last rule that was opened at that height.

    Null urls and urls without ``://`` have an empty host and path. Repeated rows stay. Columns of ``pages`` with
    the names of the results are replaced; an empty table gives no rows.
    """
    spark = pages.sparkSession
    pages = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))}).drop("rule", "verdict")
    rules = (
        rules.where("verdict is not null and host is not null and path is not null")
        .groupBy(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"))
        .agg(F.max("verdict").alias("rule_verdict"))  # block comes after allow
        .withColumn("labels", F.split("rule_host", r"\."))
    )
    depths = sorted(r[0] for r in rules.select(F.size("labels")).distinct().collect())  # at most the labels of a host name
    # Four cells for each shuffle partition: the setting that follows the input.
    cells = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    rule_key = _key(F.col("labels"), F.col("rule_path"))
    opened = rules.select(
        F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), rule_key.alias("start"),
        F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"), F.size("labels").alias("depth"))
    rule = F.struct(
        F.length("rule").alias("length"), "depth", "rule", "verdict")
    no_page = [F.lit(None).cast("string").alias(c) for c in ("host", "path")]
    events = opened.select("cell", F.explode(F.array(
        F.struct(F.col("start").alias("key"), F.lit(START).alias("kind"), rule.alias("rule")),
        F.struct(F.concat("start", F.lit(BEHIND)).alias("key"), F.lit(END).alias("kind"), F.lit(None).alias("rule")))).alias("e"),
        *no_page).select("cell", "e.*", "host", "path")

    labels = F.split("host", r"\.")
    keys = pages.select("host", "path").distinct().withColumn("cell", F.pmod(F.xxhash64("host", "path"), F.lit(cells)).cast("int"))
    keys = keys.withColumn("labels", labels).withColumn("depth", F.explode(F.array(*map(F.lit, depths)) if depths else F.array().cast("array<int>")))
    asked = keys.where(F.size("labels") >= F.col("depth")).select(
        "cell", _key(F.expr("slice(labels, size(labels) - depth + 1, depth)"), F.col("path")).alias("key"),
        F.lit(PAGE).alias("kind"), F.lit(None).cast(events.schema["rule"].dataType).alias("rule"), "host", "path")

    sweep = Window.partitionBy("cell").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = Window.partitionBy("cell", "height").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("kind") == START, 1).when(F.col("kind") == END, -1).otherwise(0)
    swept = events.unionByName(asked).withColumn("height", F.sum(step).over(sweep))
    found = swept.withColumn("top", F.last("rule", ignorenulls=True).over(level)).where((F.col("kind") == PAGE) & (F.col("height") > 0))
    best = found.groupBy("host", "path").agg(F.max("top").alias("top"))

    out = pages.join(best, ["host", "path"], "left")
    kept = [c for c in pages.columns if c not in ("host", "path")]
    return out.select(*kept, "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
