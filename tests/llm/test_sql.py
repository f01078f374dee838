"""The corpus queries that have SQL, against it."""

import pytest
from check import SF_DIR, compare, duck_rows, spark_rows

from patronage.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark_rows(queries.QUERIES[name](spark, SF_DIR)), duck_rows(con, queries.ORACLES[name])) is None
