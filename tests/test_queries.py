"""Every registered query of the story engine against its SQL, or at least to its end, on the smallest tables."""

import pytest

from storyloom import plans
from tests.oracle import SF, differences


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_against_sql(spark, name):
    assert differences(spark, plans.QUERIES[name], plans.ORACLE_SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0
