"""Every registered query beside its SQL on the smallest tables."""

import os
import runpy
import sys

import pytest

from __spark_entry__ import entry
from devident.plans.catalog import QUERIES
from devident.plans.oracles import ORACLES
from tests.oracle_check import connect, difference

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_point_without_the_corpus_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "devident.llm", None)
    monkeypatch.delitem(sys.modules, "devident.llm.catalog", raising=False)
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    alone = runpy.run_path(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py"))
    assert set(alone["queries"]()) == set(QUERIES) and set(alone["oracle_sql"]()) == set(ORACLES)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, con, name):
    problem = difference(QUERIES[name](spark, SF_DIR), con, ORACLES[name])
    assert problem is None, problem
