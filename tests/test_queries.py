"""Every registered query next to its check SQL, on the smallest tables."""

import os

import pytest

from workload import compare
from workload.registry import ALL

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", list(ALL))
def test_query(spark, con, name):
    query, sql = ALL[name]
    line = compare.check(spark, con, name, query, sql, SF_DIR)
    assert line.startswith(("ok", "rows")), line
