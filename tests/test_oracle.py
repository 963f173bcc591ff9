"""Every query that SQL can say, beside its SQL."""

import pytest

from conftest import SMALL
from harness import compare, connect

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    status, rows, _, _, message = compare(spark, con, SMALL, name, entry.queries()[name], ORACLES[name])
    assert status == "ok", message


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
