"""The operators' queries that SQL can express, against their SQL on the smallest tables."""

import pytest

from routeloom.llm import queries
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert differences(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF) == ""
