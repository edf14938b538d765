import os

import pytest
from oracle import connect, differences

from inkwell.plans import registry

DATA = os.environ.get("INKWELL_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    assert differences(registry.QUERIES[name](spark, DATA), connect(DATA), registry.ORACLE_SQL[name]) == []
