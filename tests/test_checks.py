"""Every query with a check agrees with it, and the others run, on the smallest data."""

import os

import pytest

from concord.plans.registry import checks, queries
from tests.compare import connect, differences

DATA = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(checks()))
def test_agrees_with_check(spark, con, name):
    assert differences(spark, con, DATA, name) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(checks())))
def test_runs_without_check(spark, name):
    rows = queries()[name](spark, DATA).limit(5).collect()
    assert rows


def test_every_check_has_a_query():
    assert set(checks()) <= set(queries())
