"""Every registered query at the smallest scale: equal to its SQL twin, or at least one row."""

import pytest

import __spark_entry__ as entry
from corvane.queries import ORACLES, QUERIES  # those of corvane/llm have their tests in tests/llm
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    # a threshold can leave nothing at this scale; tests.compare reports that at the larger ones
    assert difference(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) in (None, "both empty")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"M07_ablation"}))
def test_has_rows(spark, name):
    assert not QUERIES[name](spark, SF_DIR).isEmpty()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
