"""Every query outside the llm folder against its SQL on the smallest tables."""

import os

import pytest

from consensio.plans import catalogue
from tests.compare import compare, connect

FOLDER = os.environ.get("CONSENSIO_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    compare(spark, con, FOLDER, name, catalogue.QUERIES[name], catalogue.SQL.get(name))
