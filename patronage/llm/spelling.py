"""Spelling variants: words at one edit, found by a frontier of states that walks a trie relation level by level.

The vocabulary is a trie whose edges are rows of a table: (node, label, child). Chains without a branch are one edge, so
the number of levels is that of the branches on a path, not the length of a word. A state is (word, position, node, edits). A level
joins all states with the edges of their nodes: a state without an edit follows its own label, and where the edit may lie on
the edge also those at one edit from what follows in the word; a state with an edit follows only equal labels. Terminal states
with one edit are neighbours.

Of two words at one edit, either the first half of the one is a prefix of the other or the second half a suffix, so the trie
is walked forwards and, for the reversed words, backwards, with edits only behind the first half of each walk.
The first three code points stay equal in both, so a walk starts at the node of these and no state ever stands at the root.

The edges come from sorted ranges of the words. Where a range ends inside a prefix, its tree has no node for branches that only the
next range has; every word still has a chain of edges of its own from its start, which is all a walk to it needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, count
from os.path import commonprefix
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, text_or_empty

# The letters of a word.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FORWARD, BACK = ">", "<"  # in front of a path: the word, or the word reversed
START = 4  # the mark and the three code points that a walk starts with; a word of 7 has at least 3 in its first half
HOT = 4096  # words below a node whose states share one row of its edges
KEPT = 128  # words below a node up to which its mask tells their ends apart
MASK_BITS = 256
ANY = "*"  # the step of a state that looks at all edges of its node
EDGES = "node string, label string, below bigint, ends boolean, first bigint, sizes bigint, rests array<bigint>"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, drop: int = 31) -> DataFrame:
    """``word, n``: runs of letters of whole texts, A-Z lower-cased, of ``shortest`` code points that occur ``least`` times.

    Where ``drop`` divides the crc32 of ``<id>:<run>``, the run loses the code point at that crc modulo its length.
    A null id is empty there. Runs are counted in their task before the shuffle.
    """
    lowered = F.translate(text_or_empty(F.col(text_col)), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % drop == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    words = runs.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


class _Node:
    """A prefix of the last word of the sweep, with what was seen below it."""

    def __init__(self, depth: int):
        self.depth, self.below, self.ends = depth, 0, False
        self.first = self.sizes = 0
        self.paths: list[str] | None = []

    def add(self, path: str) -> None:
        self.below += 1
        self.sizes |= 1 << len(path) % 64
        if len(path) == self.depth:
            self.ends = True
        else:
            self.first |= 1 << ord(path[self.depth]) % 64
        if self.paths is not None:
            self.paths.append(path)
            if len(self.paths) > KEPT:
                self.paths = None

    def above(self, depth: int, last: str) -> _Node:
        """The node of a branch on the way to this one."""
        out = _Node(depth)
        out.below, out.sizes, out.first = self.below, self.sizes, 1 << ord(last[depth]) % 64
        out.paths = None if self.paths is None else list(self.paths)
        return out

    def rests(self) -> list[int]:
        """A bit for what is left of each word behind this node; all bits where the words are too many to tell apart."""
        if self.paths is None:
            return [-1] * (MASK_BITS // 64)
        mask = 0
        for path in self.paths:
            mask |= 1 << crc32(path[self.depth:].encode()) % MASK_BITS
        return [_signed(mask >> i & (1 << 64) - 1) for i in range(0, MASK_BITS, 64)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sorted_edges(paths: Iterator[str]) -> Iterator[tuple]:
    """EDGES of the trie of sorted paths, chains without a branch as one edge; only the nodes of the last path are kept."""
    open_nodes: list[_Node] = []
    last = ""

    def closed(above: _Node, node: _Node) -> tuple:
        return last[:above.depth], last[above.depth:node.depth], node.below, node.ends, _signed(node.first), _signed(node.sizes), node.rests()

    for path in chain(paths, [""]):
        common = len(commonprefix((last, path)))
        while len(open_nodes) > 1 and open_nodes[-1].depth > common:
            node = open_nodes.pop()
            if open_nodes[-1].depth < common:
                open_nodes.append(node.above(common, last))
            yield closed(open_nodes[-1], node)
        if not path:
            return
        if common < START:
            open_nodes = [_Node(START)]
        open_nodes.append(_Node(len(path)))
        for node in open_nodes:
            node.add(path)
        last = path


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    names = [x.split()[0] for x in EDGES.split(", ")]
    rows = []

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(types), types)], names)

    for row in sorted_edges(p for batch in batches for p in batch.column(0).to_pylist()):
        rows.append(row)
        if len(rows) == 10_000:
            yield batch_of()
            rows = []
    yield batch_of()


def _parts(below: str) -> Column:
    return F.ceil(F.col(below) / HOT).cast("int")


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges, and the first state of every word in either direction.

    ``node, part, step, label, ends, parts, first, sizes, rests``: each edge stands under its first code point and under ``ANY``; ``ends`` tells whether a
    word ends behind it, ``parts`` is the number of parts of the next node (0 without edges), masks tell what follows. The edges of a
    node with many words below it are copied for each part of its states.
    """
    paths = words.select(F.explode(F.array(F.concat(F.lit(FORWARD), "word"), F.concat(F.lit(BACK), F.reverse("word")))).alias("path"))
    edges = saved(paths.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(_edge_rows, EDGES), "trie-edges")
    nodes = saved(edges.groupBy("node").agg(F.sum("below").alias("words")).select("node", _parts("words").alias("parts")), "trie-nodes")
    below = nodes.select(F.col("node").alias("child"), "parts")
    edges = edges.withColumn("child", F.concat("node", "label")).join(below, "child", "left").withColumn("parts", F.coalesce("parts", F.lit(0)))
    edges = edges.join(nodes.withColumnRenamed("parts", "copies"), "node").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    edges = edges.withColumn("step", F.explode(F.array(F.substring("label", 1, 1), F.lit(ANY))))
    states = paths.withColumn("node", F.substring("path", 1, START)).join(nodes, "node")
    states = states.select("path", F.lit(START).alias("pos"), F.lit(0).alias("edits"), "node", "parts")
    return saved(edges.select("node", "part", "step", "label", "ends", "parts", "first", "sizes", "rests"), "trie"), states


def _leads_on(after: Column) -> Column:
    """Whether a word behind the edge may end in ``after``; the masks can only say yes too often."""
    size = F.length("node") + F.length("label") + F.length(after)
    rest = F.crc32(after.cast("binary")) % MASK_BITS
    inside = (F.getbit("first", F.ascii(after) % 64) == 1) & (F.getbit(F.element_at("rests", (F.floor(rest / 64) + 1).cast("int")), (rest % 64).cast("int")) == 1)
    return (F.getbit("sizes", size % 64) == 1) & F.when(after == "", F.col("ends")).otherwise(inside)


def _from_level(edges: DataFrame, level: int) -> DataFrame:
    """The edges that a state can ask for at a level: each level before went at least one code point down from the start."""
    return edges.where(F.length("node") >= START + level)


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: every pair of ``words`` (word, n) that one inserted, deleted or replaced code point tells apart, both ways.

    A level is one join of the states with the edges on (node, part of the node's states, step), written to the shared folder: a state asks for the edge
    that goes on like its word, and one without an edit also for all edges. States at a node are spread over the copies of its
    edges, so a prefix of many words is not one task. Nothing is capped.
    """
    edges, states = trie(words)
    found = None
    size = F.length("path") - 1
    half = F.when(F.startswith("path", F.lit(BACK)), size - F.floor(size / 2)).otherwise(F.floor(size / 2)) + 1
    used = F.length("label") + F.col("shift")
    after = F.substring("path", F.col("pos") + used + 1, F.length("path"))
    part_of_rest = F.substring("path", F.col("pos") + 1, used)
    same = (F.col("step") != ANY) & (part_of_rest == F.col("label")) & ((F.col("edits") == 0) | _leads_on(after))
    near = ((F.col("step") == ANY) & (F.col("pos") + F.length("label") >= half) & (F.col("pos") + used <= F.length("path"))
            & _leads_on(after) & (F.levenshtein("label", part_of_rest, 1) == 1))
    for level in count():
        own = F.substring("path", F.col("pos") + 1, 1)
        asked = states.withColumns({
            "part": F.pmod(F.xxhash64("path"), "parts").cast("int"),
            "step": F.explode(F.when(F.col("edits") == 0, F.array(own, F.lit(ANY))).otherwise(F.array(own)))}).drop("parts")
        met = asked.where("step <> ''").join(_from_level(edges, level), ["node", "part", "step"])
        shifts = F.when(F.col("step") == ANY, F.array(F.lit(-1), F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        met = met.withColumn("shift", F.explode(shifts)).where(same | near).select(
            "path", (F.col("pos") + used).alias("pos"), F.when(F.col("step") == ANY, 1).otherwise(F.col("edits")).alias("edits"),
            F.concat("node", "label").alias("node"), "parts", "ends")
        ended = (F.col("edits") == 1) & (F.col("pos") == F.length("path"))
        met = saved(met.where(F.when(ended, F.col("ends")).otherwise(F.col("parts") > 0)), "frontier")
        done = met.where(ended).select(*[
            F.when(F.startswith(x, F.lit(BACK)), F.reverse(F.substring(x, F.lit(2), F.length(x)))).otherwise(F.substring(x, F.lit(2), F.length(x))).alias(name)
            for x, name in (("path", "word"), ("node", "near"))])
        found = done if found is None else found.unionByName(done)
        states = met.where(~ended).drop("ends")
        if states.isEmpty():
            break
    # A pair can come from both walks.
    return found.distinct().join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per word: its most frequent near word, if that is ``factor`` times as frequent.

    Ties go to the smallest word in code-point order; ``root`` is the last form on the way, the word itself where it has none. Null and empty
    texts have no words, a text and a word of any length is taken whole, rows with one id or text count each. An empty
    table gives no rows; other columns are not read.
    """
    words = saved(vocabulary(docs, id_col, text_col), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), "near"))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    has = -F.col("best.rank") >= factor * F.col("n")
    out = saved(words.join(near, "word", "left").select(
        "word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(has, -F.col("best.rank")).alias("form_n")), "forms")
    # Counts grow tenfold from form to form, so a way is short; each round doubles the steps taken.
    roots = out.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = saved(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return out.join(roots.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
