import os
import sys
import random

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture()
def rnd():
    return random.Random(20)


@pytest.fixture()
def documents(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) rows, with columns whose names operators use inside."""

    def make(rows):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or ""), "extra", 1, None, "x") for r in rows]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, class string, size int, kept string, doc string")

    return make
