"""Line-first cleaning: judge each line, remove those that fail, then reject documents that lost too much."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES

# Phrases of lines that belong to a site, not to its text.
BOILERPLATE = re.compile(
    r"\b(?:all rights reserved|copyright(?:ed|s)?|privacy policy|terms of (?:use|service)|licensed under|spdx-license|"
    r"(?:uses?|using|accept|allow|reject|manage) (?:all |our )?cookies|cookies? (?:policy|settings|notice|preferences|consent)|"
    r"(?:enable|requires?|turn on) javascript|javascript (?:is|must be|to be) (?:disabled|enabled|required)|"
    r"subscribe|sign (?:in|up)|log ?in|share (?:this|on)|click here|read more)\b|©|\(c\) \d{4}", re.I)
SEPARATORS = frozenset(("|", "»", "«", ">", "<", "•", "·", "/", "::", "-", "–", "—"))
SYMBOLS = "#*$%&|<>"
_RUN = re.compile(r"([^\w\s])\1")
_SENTENCE = re.compile(r"[.,;:!?…。、，！？]")

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words
BOILERPLATE_WORDS = 40
MAX_LOST = 30  # percent of the words

DIGEST = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "base_failed boolean, kept boolean, n_lost_words bigint, clean_text string")


def line_fails(line: str) -> str | None:
    """The rule a line fails, if any. A line without a word fails none.

    navigation: three or more stand-alone separators that make up a fifth of its words.
    punctuation: over a third of its words hold a doubled mark, or over 60 words have no sentence mark at all.
    boilerplate: at most 40 words with a phrase of the list.
    """
    words = line.encode().split()
    if not words:
        return None
    plain = line.split()
    separators = sum(w in SEPARATORS for w in plain)
    if separators >= 3 and 5 * separators >= len(plain):
        return "navigation"
    if _RUN.search(line) and 3 * sum(_RUN.search(w) is not None for w in plain) > len(plain):
        return "punctuation"
    if len(words) > 60 and not _SENTENCE.search(line):
        return "punctuation"
    if len(words) <= BOILERPLATE_WORDS and BOILERPLATE.search(line):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three which the text has twice or more, the first included."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), "i8", len(words))
    k = len(known)
    if k < 1 << 21:
        windows = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * k + ids[2:]
    order = np.sort(windows)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    hit = np.isin(windows, again)
    covered = np.zeros(len(words), bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


def judge(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lost_words, clean text."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    every = text.split("\n")
    lines = [x for x in every if x.strip(SPACES)]
    duplicates = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
    bad = {x for x in set(lines) if line_fails(x)}
    lost = sum(len(x.encode().split()) for x in lines if x in bad) if bad else 0
    clean = "\n".join(x for x in every if x not in bad) if bad else text
    return n, chars, symbols, duplicates, repeated, failed, not failed and 100 * lost <= MAX_LOST * n, lost, clean


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, verdict and cleaned text of every document, row by row and without a shuffle.

    A document is kept if it passes the base rules and its failed lines hold at most 30 % of its words.
    A null or empty text has no words and fails the base rules; repeated rows are judged alike; a text of any
    length is judged whole. Other columns are not read.
    """
    names = [x.strip().split()[0] for x in DIGEST.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.string()]
        for batch in batches:
            columns = list(zip(*map(judge, batch.column(1).to_pylist()))) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, DIGEST)


def keep_clean(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The kept documents with all their columns and without the lines that failed; ``chars_col`` follows the text."""
    names = docs.columns
    at = names.index(text_col)
    length = names.index(chars_col) if chars_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t) for t in batch.column(at).to_pylist()]
            keep = pa.array([x[6] for x in found], pa.bool_())
            columns = batch.columns
            columns[at] = pa.array([x[8] for x in found], batch.schema.field(at).type)
            if length is not None:
                columns[length] = pc.cast(pc.utf8_length(columns[at]), batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(keep)

    return docs.mapInArrow(run, docs.schema)
