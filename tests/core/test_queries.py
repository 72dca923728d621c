"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import pytest

from routeloom import catalogue
from tests.oracle import differences

SF = os.environ.get("ROUTELOOM_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert differences(catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
