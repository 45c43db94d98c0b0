"""Every registered query next to its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import TESTDATA, compare, connect

FOLDER = f"{TESTDATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    if name in oracle_sql():
        assert compare(df, duck, oracle_sql()[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0
