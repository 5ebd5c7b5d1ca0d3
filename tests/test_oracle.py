"""Every query with SQL, over the smallest tables and the next."""

import os

import pytest

from driftline.queries import ORACLE_SQL, QUERIES
from tests.oracle import difference

SIZES = os.environ.get("TEST_SIZES", "sf0.001").split(",")


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))  # the others: test_walks.py
def test_query(spark, name, size):
    sf_dir = f"/root/testdata/{size}"
    assert difference(spark, sf_dir, QUERIES[name], ORACLE_SQL[name]) == ""
