"""Every registered query against its SQL oracle on the small driver tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_module
import compare
from thermaline.plans import catalog, oracle

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables absent")

QUERIES = catalog.registered()
ORACLES = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    difference = compare.differences(QUERIES[name](spark, SF_DIR), con, ORACLES[name])
    assert difference is None, difference


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_entry_registers_all_of_them():
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLES) <= set(entry_module.oracle_sql())
