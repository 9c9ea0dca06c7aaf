"""Every named query against its SQL in DuckDB; the ones without SQL must run."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from check import compare, connect  # noqa: E402

from tablewarden.plans import registry  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
registry.load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    message = compare(spark, con, SF, name)
    assert not message.startswith("FAIL"), message


def test_every_oracle_belongs_to_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
